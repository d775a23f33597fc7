"""Contents trees as adjacency rows: tidied bottom up, counted, and written as nested lists."""

from __future__ import annotations

import re
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CONTROL = re.compile("[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x84\\x86-\\x9f\\ufffe\\uffff]")


def _title(s: str | None) -> str:
    return " ".join(_CONTROL.sub("", s or "").split())


def tidy(entries: DataFrame) -> DataFrame:
    """entries(book_id, entry_id, parent_id, ord, title, page) -> the same, fit for a navigation document.

    An entry without a page (negative or null) takes its first child's, or goes if it has no child left. A
    blank title becomes the page's number. A contents tree belongs to one book and is handled whole.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        below: dict = {}
        for r in pdf.sort_values("ord").itertuples(index=False):
            below.setdefault(None if pd.isna(r.parent_id) else int(r.parent_id), []).append(r)
        out = []
        # Parents before children on the way down, so children are settled first on the way back.
        order, todo = [], [None]
        while todo:
            kids = below.get(todo.pop(), [])
            order += kids
            todo += [int(k.entry_id) for k in kids]
        page: dict[int, int] = {}
        for r in reversed(order):
            first = next((page[int(k.entry_id)] for k in below.get(int(r.entry_id), []) if int(k.entry_id) in page), None)
            own = None if pd.isna(r.page) or r.page < 0 else int(r.page)
            if (p := own if own is not None else first) is not None:
                page[int(r.entry_id)] = p
        for r in order:
            if (p := page.get(int(r.entry_id))) is not None:
                out.append((r.book_id, r.entry_id, r.parent_id, r.ord, _title(r.title) or str(p + 1), p))
        return pd.DataFrame(out, columns=["book_id", "entry_id", "parent_id", "ord", "title", "page"]).astype({"parent_id": "Int64"})

    columns = [F.col(c).cast(t).alias(c) for c, t in (("book_id", "long"), ("entry_id", "long"), ("parent_id", "long"), ("ord", "long"), ("title", "string"), ("page", "long"))]
    return entries.select(*columns).groupBy("book_id").applyInPandas(work, "book_id long, entry_id long, parent_id long, ord long, title string, page long")


def counted(entries: DataFrame) -> DataFrame:
    """Entries of each book at all levels."""
    return entries.groupBy("book_id").agg(F.count("*").alias("entries"))


def nested(entries: DataFrame) -> DataFrame:
    """book_id, markup: the contents as nested lists of links to pages, from tidied entries."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        below: dict = {}
        for r in pdf.sort_values("ord").itertuples(index=False):
            below.setdefault(None if pd.isna(r.parent_id) else int(r.parent_id), []).append(r)

        def listed(parent) -> str:
            rows = below.get(parent, [])
            return "<ol>" + "".join(f'<li><a href="{r.page + 1:03d}.xhtml">{escape(r.title, quote=True)}</a>{listed(int(r.entry_id))}</li>' for r in rows) + "</ol>" if rows else ""

        return pd.DataFrame({"book_id": [pdf["book_id"].iloc[0]], "markup": [listed(None)]})

    return entries.groupBy("book_id").applyInPandas(work, "book_id long, markup string")
