"""Lexical spaces, facets and regular expressions of XML Schema datatypes, for grammars."""

from __future__ import annotations

from functools import lru_cache

import regex

_START, _NAME = r"\p{L}\p{Nl}:_", r"\p{L}\p{Nl}\p{Nd}\p{Mn}\p{Mc}:_.\-·"
#: Escapes of one letter as members of a set; the capital letter is the complement.
_CLASSES = {"s": r" \t\n\r", "d": r"\p{Nd}", "i": _START, "c": _NAME}
_NCNAME = r"[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Nd}\p{Mn}\p{Mc}_.\-·]*"
_NUMBER, _DATE, _TIME, _ZONE = r"[+-]?(\d+(\.\d*)?|\.\d+)", r"-?\d{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", r"([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?", r"(Z|[+-](0\d|1[0-4]):[0-5]\d)?"
#: Lexical spaces by name; integers are those of `integer` within bounds.
LEXICAL = {
    "string": None, "normalizedString": None, "token": None, "anyURI": None, "NCName": _NCNAME, "ID": _NCNAME, "IDREF": _NCNAME, "ENTITY": _NCNAME, "Name": rf"[{_START}][{_NAME}]*", "NMTOKEN": rf"[{_NAME}]+",
    "QName": rf"({_NCNAME}:)?{_NCNAME}", "IDREFS": rf"{_NCNAME}( {_NCNAME})*", "NMTOKENS": rf"[{_NAME}]+( [{_NAME}]+)*", "language": r"[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*", "boolean": "true|false|1|0", "decimal": _NUMBER,
    "float": rf"{_NUMBER}([eE][+-]?\d+)?|-?INF|NaN", "double": rf"{_NUMBER}([eE][+-]?\d+)?|-?INF|NaN", "date": _DATE + _ZONE, "time": _TIME + _ZONE, "dateTime": f"{_DATE}T{_TIME}{_ZONE}", "gYear": r"-?\d{4,}" + _ZONE,
    "hexBinary": "([0-9a-fA-F]{2})*", "duration": r"-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?",
}
BOUNDS = {"integer": (None, None), "positiveInteger": (1, None), "nonNegativeInteger": (0, None), "negativeInteger": (None, -1), "nonPositiveInteger": (None, 0)}
BOUNDS |= {k: (-(1 << n - 1), (1 << n - 1) - 1) for k, n in (("long", 64), ("int", 32), ("short", 16), ("byte", 8))} | {k: (0, (1 << n) - 1) for k, n in (("unsignedLong", 64), ("unsignedInt", 32), ("unsignedShort", 16), ("unsignedByte", 8))}


def _escape(s: str, i: int) -> tuple[str, int]:
    """The set that an escape at s[i] stands for, without brackets, and where it ends."""
    c = s[i + 1]
    if c in "pP":
        end = s.index("}", i) + 1
        return s[i:end], end
    if c.lower() in _CLASSES:
        inside = _CLASSES[c.lower()]
        return (inside if c.islower() else f"[^{inside}]"), i + 2
    if c in "wW":
        return (r"[^\p{P}\p{Z}\p{C}]" if c == "w" else r"\p{P}\p{Z}\p{C}"), i + 2
    return f"\\{c}", i + 2


def _set(s: str, i: int) -> tuple[str, int]:
    """A class that begins at s[i] as a set expression, and where it ends. A class less a class becomes a difference."""
    i += 1
    sign = ""
    if s[i] == "^":
        sign, i = "^", i + 1
    body, less = "", ""
    while s[i] != "]":
        if s[i] == "\\":
            part, i = _escape(s, i)
            body += part
        elif s[i] == "-" and s[i + 1] == "[":
            less, i = _set(s, i + 1)
        else:
            body += s[i] if s[i] == "-" and body and s[i + 1] != "]" else regex.escape(s[i])
            i += 1
    out = f"[{sign}{body}]"
    return (f"[{out}--{less}]" if less else out), i + 1


@lru_cache(maxsize=4096)
def pattern(source: str) -> regex.Pattern:
    """An XML Schema regular expression, which matches whole values; ^ and $ are plain characters there."""
    out, i = "", 0
    while i < len(source):
        c = source[i]
        if c == "\\":
            part, i = _escape(source, i)
            out += part if len(part) == 2 else f"[{part}]"
        elif c == "[":
            part, i = _set(source, i)
            out += part
        else:
            out += {"^": r"\^", "$": r"\$", ".": r"[^\r\n]"}.get(c, c)
            i += 1
    return regex.compile(f"(?V1)(?:{out})")


@lru_cache(maxsize=64)
def _lexical(name: str) -> regex.Pattern | None:
    return None if LEXICAL[name] is None else regex.compile(f"(?V1)(?:{LEXICAL[name]})")


def normalised(name: str, value: str) -> str:
    """White space as the type reads it: kept, replaced or collapsed."""
    if name == "string":
        return value
    if name == "normalizedString":
        return regex.sub(r"[\t\n\r]", " ", value)
    return " ".join(x for x in regex.split(r"[ \t\n\r]+", value) if x)


def known(name: str) -> bool:
    return name in LEXICAL or name in BOUNDS


def valid(name: str, params: tuple[tuple[str, str], ...], value: str) -> bool:
    """Whether a value is in the lexical space of a type and keeps its facets. Lengths of list types count items."""
    v = normalised(name, value)
    if name in BOUNDS:
        if not regex.fullmatch(r"[+-]?[0-9]+", v):
            return False
        low, high = BOUNDS[name]
        if low is not None and int(v) < low or high is not None and int(v) > high:
            return False
    elif (p := _lexical(name)) and not p.fullmatch(v):
        return False
    size = len(v.split()) if name.endswith("S") else len(v)
    number = name in BOUNDS or name in ("decimal", "float", "double")
    key = (lambda x: float(x.replace("INF", "inf"))) if number else (lambda x: x)
    for facet, limit in params:
        if facet == "pattern":
            ok = pattern(limit).fullmatch(v) is not None
        elif facet in ("length", "minLength", "maxLength"):
            ok = {"length": size == int(limit), "minLength": size >= int(limit), "maxLength": size <= int(limit)}[facet]
        else:
            a, b = key(v), key(limit)
            ok = {"minInclusive": a >= b, "maxInclusive": a <= b, "minExclusive": a > b, "maxExclusive": a < b}[facet]
        if not ok:
            return False
    return True
