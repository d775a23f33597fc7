"""References between documents: resolved paths and URL syntax, as Arrow functions over whole columns."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote_to_bytes, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_ILLEGAL = re.compile(r'[\x00-\x20"<>\\^`{|}\[\]]')


def resolve(base: str, href: str | None) -> str | None:
    """The archive path that href names from document base; null for remote, data and fragment-only references."""
    bare = re.split("[#?]", href or "", maxsplit=1)[0]
    if not bare or ":" in bare or bare.startswith("//"):
        return None
    path = bare if _BAD_ESCAPE.search(bare) else unquote_to_bytes(bare).decode("utf-8", "replace")
    if path.startswith("/"):
        return posixpath.normpath(path).lstrip("/")
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), path))


def preview_path(base: str, href: str | None) -> str:
    """The path of a relative reference for previews; empty for absolute URLs and ones with a host."""
    try:
        parts = urlsplit(href or "")
    except ValueError:
        return ""
    if parts.scheme or parts.netloc:
        return ""
    path = unquote_to_bytes(parts.path).decode("utf-8", "replace")
    return posixpath.normpath("/" + (path if path.startswith("/") else posixpath.join(posixpath.dirname(base), path))).lstrip("/")


def url_error(href: str) -> str:
    """Why href is no URL, an empty string if it is one."""
    fragment = href.partition("#")[2]
    if _BAD_ESCAPE.search(href):
        return "malformed escape"
    if _ILLEGAL.search(href) or "#" in fragment:
        return "illegal character"
    return ""


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def url_errors(href: pd.Series) -> pd.Series:
    return pd.Series([url_error(h or "") for h in href], dtype=object)


_CSS = re.compile(r"/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|(?P<open>/\*|[\"'])|(?P<brace>[{}])|(?P<line>\n)", re.S)


def css_error(data: bytes | None) -> tuple[int, str] | None:
    """Line and reason of the first structural error of a style sheet."""
    text, depth = (data or b"").decode("latin-1"), 0
    line = lambda at: text.count("\n", 0, at) + 1
    for m in _CSS.finditer(text):
        if m["open"]:
            return line(m.start()), "unterminated comment" if m["open"] == "/*" else "unterminated string"
        if m["brace"]:
            depth += 1 if m["brace"] == "{" else -1
            if depth < 0:
                return line(m.start()), "unexpected brace"
    return (line(len(text)), "unterminated block") if depth else None


@F.pandas_udf(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("reason", T.StringType())]))
def css_errors(data: pd.Series) -> pd.DataFrame:
    found = [css_error(bytes(d) if d is not None else None) or (None, None) for d in data]
    return pd.DataFrame({"line": pd.Series([x for x, _ in found], dtype="Int32"), "reason": [y for _, y in found]})
