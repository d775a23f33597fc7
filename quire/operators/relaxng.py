"""Content models: RELAX NG grammars in compact syntax, matched by derivatives, as a function over documents.

A schema is text; files that it includes come with it by name. Patterns are interned, so equal ones are one
number, and derivatives are remembered by pattern and name. A worker reads a schema once. Matching goes on after
an error: an element that does not fit is skipped with all that it holds, an attribute that does not fit is left
out, and a required part that is missing is taken as given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators import datatypes

DEPTH = 32  # of includes
NAMED = 10  # elements that a message lists
_TOKEN = re.compile(r'''(?P<skip>\s+|\#[^\n]*)|(?P<lit>"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'|"[^"\n]*"|'[^'\n]*')|(?P<name>\\?[^\W\d][\w.\-]*(?::(?:\*|[^\W\d][\w.\-]*))?)|(?P<op>\|=|&=|>>|[=|&,?*+\-(){}\[\]~])''')
_WORDS = frozenset("attribute default datatypes div element empty external grammar include inherit list mixed namespace notAllowed parent start string text token".split())


class GrammarError(ValueError):
    pass


def tokens(source: str) -> list[tuple[str, str]]:
    """(kind, text) of each token; annotations in square brackets are left out."""
    source = re.sub(r"\\x+\{([0-9a-fA-F]+)\}", lambda m: chr(int(m[1], 16)), source)
    out, at, deep = [], 0, 0
    while at < len(source):
        if not (m := _TOKEN.match(source, at)):
            raise GrammarError(f"unexpected {source[at]!r}")
        at = m.end()
        if m.lastgroup == "op" and m[0] in "[]":
            deep += 1 if m[0] == "[" else -1
        elif not deep and m.lastgroup != "skip":
            kind, text = m.lastgroup, m[0]
            if kind == "lit":
                text = text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1]
            elif kind == "name":
                kind, text = ("id", text[1:]) if text[0] == "\\" else ("word" if text in _WORDS else "id", text)
            out.append((kind, text))
    return [*out, ("end", "")]


@dataclass
class Parser:
    """Reads one file: a tree of tuples. A grammar is a list of ("define", name, op, pattern) and ("include", file, block)."""

    source: str
    ns: str = ""
    at: int = 0
    prefixes: dict[str, str] = field(default_factory=lambda: {"xml": "http://www.w3.org/XML/1998/namespace"})

    def __post_init__(self):
        self.toks = tokens(self.source)

    def peek(self, text: str, kind: str = "op") -> bool:
        return self.toks[self.at] == (kind, text)

    def take(self, text: str, kind: str = "op") -> bool:
        self.at += (hit := self.peek(text, kind))
        return hit

    def need(self, text: str, kind: str = "op") -> None:
        if not self.take(text, kind):
            raise GrammarError(f"{text!r} expected, {self.toks[self.at][1]!r} found")

    def next(self, *kinds: str) -> str:
        kind, text = self.toks[self.at]
        if kinds and kind not in kinds:
            raise GrammarError(f"unexpected {text!r}")
        self.at += 1
        return text

    def literal(self) -> str:
        out = self.next("lit")
        while self.take("~"):
            out += self.next("lit")
        return out

    def file(self) -> list[tuple]:
        while self.toks[self.at] in (("word", "namespace"), ("word", "default"), ("word", "datatypes")):
            word = self.next()
            default = word == "default" and self.next() == "namespace"
            name = self.next("id", "word") if not self.peek("=") else ""
            self.need("=")
            uri = self.ns if self.take("inherit", "word") else self.literal()
            if word != "datatypes":
                self.prefixes |= {name: uri} if name else {}
                self.ns = uri if default else self.ns
        begins = self.at
        if self.toks[self.at][0] == "end" or self._component():
            self.at = begins
            return self.grammar("end", "")
        out = [("define", "start", "=", self.pattern())]
        self.need("", "end")
        return out

    def _component(self) -> bool:
        word, after = self.toks[self.at], self.toks[self.at + 1]
        return after[1] in ("=", "|=", "&=") and after[0] == "op" or word in (("word", "include"), ("word", "div"))

    def grammar(self, kind: str, text: str) -> list[tuple]:
        out = []
        while not self.take(text, kind):
            if self.take("div", "word"):
                self.need("{")
                out += self.grammar("op", "}")
            elif self.take("include", "word"):
                file, ns = self.literal(), self.ns
                if self.take("inherit", "word"):
                    self.need("=")
                    ns = self.prefixes[self.next("id")]
                out.append(("include", file, ns, self.grammar("op", "}") if self.take("{") else []))
            else:
                name = self.next("id", "word")
                op = self.next("op")
                if op not in ("=", "|=", "&="):
                    raise GrammarError(f"unexpected {op!r}")
                out.append(("define", name, op, self.pattern()))
        return out

    def pattern(self) -> tuple:
        out = self.particle()
        for op, kind in ((",", "group"), ("|", "choice"), ("&", "interleave")):
            if self.peek(op):
                while self.take(op):
                    out = (kind, out, self.particle())
                if self.toks[self.at][1] in (",", "|", "&") and self.toks[self.at][0] == "op":
                    raise GrammarError("operators of several kinds need parentheses")
                break
        return out

    def particle(self) -> tuple:
        out = self.primary()
        for op, made in (("?", lambda p: ("choice", p, ("empty",))), ("*", lambda p: ("choice", ("oneOrMore", p), ("empty",))), ("+", lambda p: ("oneOrMore", p))):
            if self.take(op):
                return made(out)
        return out

    def primary(self) -> tuple:
        kind, text = self.toks[self.at]
        if self.take("("):
            out = self.pattern()
            self.need(")")
            return out
        if kind == "lit":
            return ("value", "token", self.literal())
        self.at += 1
        if kind == "word":
            if text in ("element", "attribute"):
                name = self.name_class(text == "element")
                self.need("{")
                out = (text, name, self.pattern())
                self.need("}")
                return out
            if text in ("list", "mixed"):
                self.need("{")
                out = (text, self.pattern())
                self.need("}")
                return out
            if text in ("empty", "text", "notAllowed"):
                return (text,)
            if text in ("string", "token"):
                return self.data(text)
            if text == "grammar":
                self.need("{")
                return ("grammar", self.grammar("op", "}"))
            if text == "parent":
                return ("parent", self.next("id"))
            raise GrammarError(f"unexpected {text!r}")
        if kind != "id":
            raise GrammarError(f"unexpected {text!r}")
        return self.data(text.partition(":")[2]) if ":" in text else ("ref", text)

    def data(self, name: str) -> tuple:
        if self.toks[self.at][0] == "lit":
            return ("value", name, self.literal())
        if not datatypes.known(name):
            raise GrammarError(f"unknown datatype {name}")
        params = []
        if self.take("{"):
            while not self.take("}"):
                facet = self.next("id", "word")
                self.need("=")
                params.append((facet, self.literal()))
        return ("data", name, tuple(params), self.primary() if self.take("-") else ("notAllowed",))

    def name_class(self, element: bool) -> tuple:
        out = self._name(element)
        while self.take("|"):
            out = ("either", out, self._name(element))
        return out

    def _name(self, element: bool) -> tuple:
        if self.take("("):
            out = self.name_class(element)
            self.need(")")
            return out
        if self.take("*"):
            return ("any", None, self._name(element) if self.take("-") else None)
        text = self.next("id", "word")
        prefix, colon, local = text.partition(":")
        if local == "*":
            return ("any", self.prefixes[prefix], self._name(element) if self.take("-") else None)
        return ("name", self.prefixes[prefix], local) if colon else ("name", self.ns if element else "", text)


def holds(name_class: tuple, ns: str, local: str) -> bool:
    if name_class[0] == "name":
        return name_class[1:] == (ns, local)
    if name_class[0] == "either":
        return holds(name_class[1], ns, local) or holds(name_class[2], ns, local)
    return name_class[1] in (None, ns) and not (name_class[2] and holds(name_class[2], ns, local))


def flat(components: list[tuple], files: dict[str, str], depth: int = 0) -> list[tuple]:
    """Definitions alone: what is included comes in, and an include's block stands in for definitions of the same names."""
    if depth > DEPTH:
        raise GrammarError("includes are too deep")
    out = []
    for c in components:
        if c[0] == "include":
            if c[1] not in files:
                raise GrammarError(f"no file {c[1]}")
            block = flat(c[3], files, depth + 1)
            own = {d[1] for d in block}
            out += [d for d in flat(Parser(files[c[1]], c[2]).file(), files, depth + 1) if d[1] not in own] + block
        else:
            out.append(c)
    return out


def combined(definitions: list[tuple]) -> dict[str, tuple]:
    """One pattern for each name: several definitions by the one operator they state, which one of them may leave out."""
    out: dict[str, tuple] = {}
    for name in dict.fromkeys(d[1] for d in definitions):
        own = [d for d in definitions if d[1] == name]
        ops = {d[2] for d in own if d[2] != "="}
        if len(ops) > 1 or sum(d[2] == "=" for d in own) > 1:
            raise GrammarError(f"{name} is defined in several ways")
        body = own[0][3]
        for d in own[1:]:
            body = ("choice" if ops == {"|="} else "interleave", body, d[3])
        out[name] = body
    return out


class Schema:
    def __init__(self, source: str, files: dict[str, str] | None = None):
        self.files = files or {}
        self.kinds: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.bodies: list[tuple] = []  # of elements: name class, tree and its grammars
        self.places: dict[tuple[int, int], int] = {}
        self.contents: dict[int, int] = {}
        self.known: dict[tuple, int] = {}
        self.none, self.empty, self.text = (self.made(k) for k in ("notAllowed", "empty", "text"))
        self.start = self.read(("ref", "start"), [combined(flat(Parser(source).file(), self.files))], ())
        i = 0
        while i < len(self.bodies):  # more come up on the way
            self.content(i)
            i += 1

    def content(self, i: int) -> int:
        if i not in self.contents:
            _, tree, scopes = self.bodies[i]
            self.contents[i] = self.read(tree[2], scopes, ())
        return self.contents[i]

    def made(self, *key) -> int:
        if key not in self.numbers:
            self.numbers[key] = len(self.kinds)
            self.kinds.append(key)
        return self.numbers[key]

    # Constructors that keep patterns simple.
    def choice(self, a: int, b: int) -> int:
        parts = {x for p in (a, b) for x in (self.kinds[p][1:] if self.kinds[p][0] == "choice" else (p,))} - {self.none}
        return self.none if not parts else min(parts) if len(parts) == 1 else self.made("choice", *sorted(parts))

    def two(self, kind: str, a: int, b: int) -> int:
        if self.none in (a, b):
            return self.none
        if kind != "after" and self.empty in (a, b):
            return b if a == self.empty else a
        return self.made(kind, *(sorted((a, b)) if kind == "interleave" else (a, b)))

    def some(self, a: int) -> int:
        return a if a in (self.none, self.empty, self.text) else self.made("oneOrMore", a)

    def read(self, tree: tuple, scopes: list[dict], seen: tuple) -> int:
        """A pattern of a parsed tree; contents of elements are left for later, so references may go round through them."""
        kind = tree[0]
        if kind in ("empty", "text", "notAllowed"):
            return self.made(kind)
        if kind in ("ref", "parent"):
            scopes = scopes[:-1] if kind == "parent" else scopes
            if not scopes or tree[1] not in scopes[-1]:
                raise GrammarError(f"{tree[1]} is not defined")
            if (here := (len(scopes), tree[1])) in seen:
                raise GrammarError(f"{tree[1]} refers to itself")
            return self.read(scopes[-1][tree[1]], scopes, (*seen, here))
        if kind == "grammar":
            return self.read(("ref", "start"), [*scopes, combined(flat(tree[1], self.files))], seen)
        if kind == "element":
            if (place := (id(tree), id(scopes))) not in self.places:
                self.places[place] = len(self.bodies)
                self.bodies.append((tree[1], tree, scopes))
            return self.made("element", self.places[place])
        if kind == "attribute":
            return self.made("attribute", tree[1], self.read(tree[2], scopes, seen))
        if kind == "data":
            return self.made("data", tree[1], tree[2], self.read(tree[3], scopes, seen))
        if kind == "value":
            return self.made("value", tree[1], datatypes.normalised(tree[1], tree[2]))
        parts = [self.read(t, scopes, seen) for t in tree[1:]]
        if kind == "choice":
            return self.choice(*parts)
        if kind == "mixed":
            return self.two("interleave", self.text, parts[0])
        if kind == "oneOrMore":
            return self.some(parts[0])
        return self.made("list", parts[0]) if kind == "list" else self.two(kind, *parts)

    def nullable(self, p: int) -> bool:
        kind, *parts = self.kinds[p]
        if kind == "choice":
            return any(map(self.nullable, parts))
        return kind in ("empty", "text") or kind in ("group", "interleave", "oneOrMore") and all(map(self.nullable, parts))

    def derived(self, p: int, event: tuple) -> int:
        """The derivative of p by an event: ("open", ns, local), ("attribute", ns, local, value), ("close", lenient), ("text", value), ("end", lenient)."""
        if event[0] in ("text", "attribute"):  # values are rarely the same
            return self._derived(p, event)
        if (key := (p, event)) not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = self._derived(p, event)
        return self.known[key]

    def _after(self, p: int, done) -> int:
        """Put the rest that follows what is open through done."""
        kind, *parts = self.kinds[p]
        if kind == "after":
            return self.two("after", parts[0], done(parts[1]))
        out = self.none
        for x in parts if kind == "choice" else ():
            out = self.choice(out, self._after(x, done))
        return out

    def _derived(self, p: int, event: tuple) -> int:
        kind, *parts = self.kinds[p]
        what, opens = event[0], event[0] == "open"
        d = lambda x: self.derived(x, event)
        if kind == "choice":
            out = self.none
            for x in parts:
                out = self.choice(out, d(x))
            return out
        if kind == "after":
            if what == "end":
                return parts[1] if event[1] or self.nullable(parts[0]) else self.none
            return self._after(d(parts[0]), lambda x: self.two("after", x, parts[1])) if opens else self.two("after", d(parts[0]), parts[1])
        if what == "end":
            return self.none
        if what == "close":  # attributes that are still open were required
            if kind == "attribute":
                return self.empty if event[1] else self.none
            return self.two(kind, *map(d, parts)) if kind in ("group", "interleave") else self.some(d(parts[0])) if kind == "oneOrMore" else p
        if kind in ("group", "interleave"):
            a, b = parts
            put = lambda left, right: self._after(left, lambda x: self.two(kind, x, right)) if opens else self.two(kind, left, right)
            first = put(d(a), b)
            if kind == "interleave" or what == "attribute" or self.nullable(a):
                second = d(b) if kind == "group" and what != "attribute" else self._after(d(b), lambda x: self.two(kind, a, x)) if opens else self.two(kind, a, d(b))
                return self.choice(first, second)
            return first
        if kind == "oneOrMore":
            rest = self.choice(p, self.empty)
            return self._after(d(parts[0]), lambda x: self.two("group", x, rest)) if opens else self.two("group", d(parts[0]), rest)
        if opens:
            if kind != "element" or not holds(self.bodies[parts[0]][0], *event[1:]):
                return self.none
            return self.two("after", self.content(parts[0]), self.empty)
        if what == "attribute":
            return self.empty if kind == "attribute" and holds(parts[0], *event[1:3]) and self.fits(parts[1], event[3]) else self.none
        if kind == "text":
            return p
        if kind == "value":
            return self.empty if datatypes.normalised(parts[0], event[1]) == parts[1] else self.none
        if kind == "data":
            return self.empty if datatypes.valid(parts[0], parts[1], event[1]) and not self.fits(parts[2], event[1]) else self.none
        if kind == "list":
            rest = parts[0]
            for item in event[1].split():
                rest = self.derived(rest, ("text", item))
            return self.empty if self.nullable(rest) else self.none
        return self.none

    def fits(self, p: int, value: str) -> bool:
        return self.nullable(p) and not value.strip() or self.nullable(self.derived(p, ("text", value)))

    def firsts(self, p: int, kind: str = "element", required: bool = False) -> list[str]:
        """Names of elements (or attributes, or required ones) that may come next, in order."""
        out, todo, seen = set(), [p], set()
        while todo:
            if (q := todo.pop()) in seen or required and self.derived(q, ("close", False)) != self.none:
                continue
            seen.add(q)
            k, *parts = self.kinds[q]
            if k == kind:
                names = [self.bodies[parts[0]][0] if k == "element" else parts[0]]
                while names:
                    n = names.pop()
                    names += n[1:] if n[0] == "either" else ()
                    out |= {n[2] if n[0] == "name" else "any name"} if n[0] != "either" else set()
            elif k in ("choice", "interleave"):
                todo += parts
            elif k == "group":
                todo += parts if kind == "attribute" or self.nullable(parts[0]) else parts[:1]
            elif k in ("oneOrMore", "after"):
                todo.append(parts[0])
        return sorted(out)

    def expected(self, p: int) -> str:
        names = [f'"{n}"' for n in self.firsts(p)]
        listed = ", ".join(names[:NAMED]) + (" (and more)" if len(names) > NAMED else "")
        return f"; expected {listed}" if names else "; nothing is expected"

    def errors(self, data: bytes) -> list[tuple[int, int, str]]:
        """(line, column, message) of everything that does not fit; a document that is not well formed ends at its fault."""
        parser = expat.ParserCreate(namespace_separator=" ")
        out: list[tuple[int, int, str]] = []
        state = {"p": self.start, "skip": 0, "text": "", "children": [0]}
        split = lambda n: tuple(n.rsplit(" ", 1)) if " " in n else ("", n)
        report = lambda why: out.append((parser.CurrentLineNumber, parser.CurrentColumnNumber + 1, why))

        def step(event: tuple, why) -> bool:
            if (q := self.derived(state["p"], event)) == self.none:
                report(why())
                return False
            state["p"] = q
            return True

        def text(last: bool) -> None:
            s, state["text"] = state["text"], ""
            if s.strip():
                step(("text", s), lambda: "text is not allowed here" + self.expected(state["p"]))
            elif last and not state["children"][-1]:  # an element without children may hold an empty value
                state["p"] = self.choice(state["p"], self.derived(state["p"], ("text", s)))

        def start(name: str, attrs: dict) -> None:
            if state["skip"]:
                state["skip"] += 1
                return
            text(False)
            state["children"][-1] += 1
            ns, local = split(name)
            if not step(("open", ns, local), lambda: f'element "{local}" is not allowed here{self.expected(state["p"])}'):
                state["skip"] = 1
                return
            state["children"].append(0)
            for k, v in attrs.items():
                a_ns, a = split(k)
                step(("attribute", a_ns, a, v), lambda a=a, v=v: f'value "{v}" of attribute "{a}" is not allowed' if a in self.firsts(state["p"], "attribute") else f'attribute "{a}" is not allowed here')
            if not step(("close", False), lambda: "missing attributes: " + ", ".join(self.firsts(state["p"], "attribute", True))):
                state["p"] = self.derived(state["p"], ("close", True))

        def end(name: str) -> None:
            if state["skip"]:
                state["skip"] -= 1
                return
            text(True)
            state["children"].pop()
            if not step(("end", False), lambda: f'element "{split(name)[1]}" is incomplete{self.expected(state["p"])}'):
                state["p"] = self.derived(state["p"], ("end", True))

        parser.StartElementHandler, parser.EndElementHandler = start, end
        parser.CharacterDataHandler = lambda s: None if state["skip"] else state.__setitem__("text", state["text"] + s)
        try:
            parser.Parse(data, True)
        except expat.ExpatError as e:
            out.append((e.lineno, e.offset + 1, expat.errors.messages[e.code]))
        except ValueError as e:  # an encoding that Python does not know
            out.append((1, 1, str(e)))
        return out

@lru_cache(maxsize=8)
def compiled(source: str, files: tuple[tuple[str, str], ...] = ()) -> Schema:
    """One per Python worker and schema."""
    return Schema(source, dict(files))


def grammar_findings(docs: DataFrame, source: str, files: dict[str, str] | None = None) -> DataFrame:
    """docs(package_id, doc, content) -> package_id, code, path, line, col, detail of everything that a schema does not allow.

    Null contents count as empty documents, which are not well formed. An empty table gives no rows.
    """
    compiled(source, tuple(sorted((files or {}).items())))  # a schema that cannot be read fails here, not in tasks
    own = tuple(sorted((files or {}).items()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = compiled(source, own)
        for batch in batches:
            rows = [(p.as_py(), "RSC-005", d.as_py(), line, col, why) for p, d, content in zip(*batch.columns, strict=True) for line, col, why in schema.errors(content.as_py() or b"")]
            if rows:
                types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["package_id", "code", "path", "line", "col", "detail"])

    return docs.selectExpr("cast(package_id as string) package_id", "cast(doc as string) doc", "content").mapInArrow(check, "package_id string, code string, path string, line int, col int, detail string")
