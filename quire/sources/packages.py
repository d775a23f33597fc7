"""Packages as tables: ZIP archives to entries, XML documents to elements, entries back to archives.

Python opens archives and parses XML, batch by batch; everything after that is DataFrame operations.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "package_id string, ord int, name string, method int, flags int, extra_len int, crc32 long, size long, content binary, error string"
ELEMENT = "package_id string, doc string, pre int, post int, parent int, depth int, above array<int>, ns string, local string, attrs map<string,string>, text string, line int, col int, error string"


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """package_id (the file's path) and content of every archive under path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("package_id"), "content")


def entries_of(content: bytes) -> Iterator[tuple]:
    """(ord, name, method, flags, extra_len, crc32, size, content, error) of each entry; one row with an error if it is no archive."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        yield (None, None, None, None, None, None, None, None, str(e) or "not an archive")
        return
    for i, e in enumerate(z.infolist()):
        data = error = None
        try:
            data = z.read(e)
        except Exception as x:  # noqa: BLE001  a damaged entry is a finding, not a failure
            error = f"{type(x).__name__}: {x}"
        yield (i, e.filename, e.compress_type, e.flag_bits, len(e.extra), e.CRC, e.file_size, data, error)


def batched(groups: Iterator[tuple[list[tuple], int]], names: list[str], types: list[pa.DataType], most: int = 2048, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """groups of (rows, bytes behind them) as batches of whole groups: each is given out when it has `most` rows or `size` bytes, as one of a few rows costs a millisecond."""
    rows, held = [], 0
    for group, n in groups:
        rows += group
        held += n
        if len(rows) >= most or held >= size:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def entries(packages: DataFrame) -> DataFrame:
    """packages(package_id, content) -> a row for each entry, duplicates of a name included."""
    names = [c.split()[0] for c in ENTRY.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], int]]:
        for batch in batches:
            for package, content in zip(*batch.columns, strict=True):
                rows = [(package.as_py(), *r) for r in entries_of(content.as_py() or b"")]
                yield rows, sum(len(r[8] or b"") for r in rows)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(read(batches), names, types)

    return packages.select(F.col("package_id").cast("string"), "content").mapInArrow(explode, ENTRY)


def files(found: DataFrame) -> DataFrame:
    """Entries by name: of several with one name the last counts."""
    last = F.max_by(F.struct("ord", "method", "flags", "extra_len", "size", "content"), "ord").alias("e")
    return found.where("name is not null").groupBy("package_id", "name").agg(last).select("package_id", "name", "e.*")


def elements_of(data: bytes, namespaces: bool = True) -> list[tuple]:
    """Elements in document order with pre and post numbers: a descendant has a larger pre and a smaller post.

    (pre, post, parent, depth, pres of the elements above it, ns, local, attrs, text with descendants' text, line,
    col, error). A document that is not well formed gives one row, with pre -1 and the error.
    """
    rows: list[list] = []
    open_: list[int] = []
    count = [0]
    parser = expat.ParserCreate(namespace_separator=" " if namespaces else None)
    split = lambda n: tuple(n.rsplit(" ", 1)) if " " in n else ("", n)

    def start(name: str, attrs: dict) -> None:
        ns, local = split(name)
        named = {(f"{{{a}}}{b}" if a else b): v for (a, b), v in ((split(k), v) for k, v in attrs.items())}
        rows.append([len(rows), 0, open_[-1] if open_ else -1, len(open_), [*open_], ns, local, list(named.items()), [], parser.CurrentLineNumber, parser.CurrentColumnNumber + 1, None])
        open_.append(len(rows) - 1)

    def end(_: str) -> None:
        i = open_.pop()
        rows[i][1] = count[0]
        count[0] += 1
        rows[i][8] = "".join(rows[i][8])
        if open_:
            rows[open_[-1]][8].append(rows[i][8])

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda s: rows[open_[-1]][8].append(s) if open_ else None
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        return [(-1, -1, -1, 0, [], None, None, [], None, e.lineno, e.offset + 1, expat.errors.messages[e.code])]
    except ValueError as e:  # an encoding that Python does not know
        return [(-1, -1, -1, 0, [], None, None, [], None, 1, 1, str(e))]
    return [tuple(r) for r in rows]


def elements(docs: DataFrame) -> DataFrame:
    """docs(package_id, doc, content) -> a row for each element of each document."""
    names = [c.split()[0] for c in ELEMENT.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], int]]:
        for batch in batches:
            for package, doc, content in zip(*batch.columns, strict=True):
                data = content.as_py() or b""
                yield [(package.as_py(), doc.as_py(), *r) for r in elements_of(data)], len(data)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(read(batches), names, types)

    return docs.select("package_id", "doc", "content").mapInArrow(explode, ELEMENT)


def archive(rows: list[tuple[str, bytes, int]], extra: dict[str, bytes] | None = None) -> bytes:
    """An archive of (name, data, method) in order, with extra fields by name; nothing that depends on the clock."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, method in rows:
            info = zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
            info.compress_type = method
            info.extra = (extra or {}).get(name, b"")
            z.writestr(info, data)
    return out.getvalue()


def packed(found: DataFrame) -> DataFrame:
    """entries(package_id, ord, name, content) -> package_id, content: archives with `mimetype` first and stored, images stored, the rest deflated.

    A package is built by one task: an archive is one file, and bounded by what one file may hold.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=pdf["name"] != "mimetype").sort_values(["first", "ord"])
        stored = pdf["name"].str.lower().str.endswith((".jpg", ".jpeg", ".png")) | (pdf["name"] == "mimetype")
        rows = [(n, bytes(c), zipfile.ZIP_STORED if s else zipfile.ZIP_DEFLATED) for n, c, s in zip(pdf["name"], pdf["content"], stored, strict=True)]
        return pd.DataFrame({"package_id": [pdf["package_id"].iloc[0]], "content": [archive(rows)]})

    return found.select("package_id", "ord", "name", "content").groupBy("package_id").applyInPandas(build, "package_id string, content binary")
