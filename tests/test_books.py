"""Images and books that this engine writes, read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import encoder, outlines
from quire.operators.jpegs import read_jpeg
from quire.plans import package_rules
from quire.sources import books


def images():
    r = np.random.default_rng(9)
    y, x = np.mgrid[0:61, 0:83]
    smooth = np.stack([x * 3 % 256, y * 4 % 256, (x + y) % 256], -1).astype(np.uint8)
    return {"flat": np.full((40, 40), 77, np.uint8), "dot": np.full((1, 1, 3), 9, np.uint8), "ramp": (np.arange(256)[None, :] + np.zeros((20, 1))).astype(np.uint8), "noise": r.integers(0, 256, (33, 50), dtype=np.uint8), "colour": smooth, "loud": r.integers(0, 256, (35, 18, 3), dtype=np.uint8)}


def shown(img, quality):
    """What a reader of the quantised terms sees, as planes beside the planes that were written."""
    for i, p in enumerate(encoder.planes(img)):
        steps = encoder.table(encoder.LUMA if not i else encoder.CHROMA, quality)
        terms = np.zeros((*[s // 8 for s in p.shape], 64))
        terms[..., encoder.ZIGZAG] = encoder.blocks(p, steps)
        cells = encoder.BASIS.T @ (terms * steps).reshape(*terms.shape[:2], 8, 8) @ encoder.BASIS + 128
        yield p, np.clip(cells.swapaxes(1, 2).reshape(p.shape), 0, 255)


@pytest.mark.parametrize("name", list(images()))
@pytest.mark.parametrize("quality", [1, 50, 92, 100])
def test_images_decode(name, quality):
    img = images()[name]
    assert read_jpeg(encoder.encoded(img, quality)) == (img.shape[1], img.shape[0], 1 if img.ndim == 2 else 3)
    for before, after in shown(img, quality):
        error = ((before - after) ** 2).mean()
        assert error < {1: 6000, 50: 900, 92: 40, 100: 1}[quality]


def test_zigzag_and_sides():
    assert encoder.ZIGZAG.tolist()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(encoder.ZIGZAG) == list(range(64))
    block = np.zeros(64, int)
    block[[0, 40]] = [5, -3]
    assert list(encoder.symbols(block, 7)) == [(0, 2, 1, 2), (1, 0xF0, 0, 0), (1, 0xF0, 0, 0), (1, 0x72, 0, 2), (1, 0, 0, 0)]
    with pytest.raises(ValueError):
        encoder.encoded(np.zeros((0, 5), np.uint8))


def test_written_books_have_no_findings(spark):
    pixels = [(i, w, h, c, bytearray(np.random.default_rng(i).integers(0, 256, w * h * c, dtype=np.uint8).tobytes())) for i, (w, h, c) in enumerate([(24, 16, 1), (24, 16, 1), (16, 24, 1), (20, 20, 1)])]
    made = encoder.jpegs(spark.createDataFrame(pixels, "image_id long, w int, h int, channels int, data binary"))
    sizes = spark.createDataFrame([(i, w, h) for i, w, h, _, _ in pixels], "image_id long, w int, h int")
    plan = spark.createDataFrame([(1, 5, 0), (1, 9, 1), (2, 1, 2), (2, 2, 0), (2, 3, 3), (4, 1, 0)], "book_id long, page_no int, image_id long")
    pages = plan.join(sizes, "image_id").join(made, "image_id")
    known = spark.createDataFrame([(1, "urn:q:1", "A & <B>", "en", False), (2, "urn:q:2", "C", "ar", True), (3, "urn:q:3", "none", "en", False)], "book_id long, identifier string, title string, language string, rtl boolean").withColumn("modified", F.expr("timestamp'2025-01-02 03:04:05'"))
    contents = outlines.nested(outlines.tidy(spark.createDataFrame([(2, 1, None, 0, "All & more", 1)], "book_id long, entry_id long, parent_id long, ord long, title string, page long")))
    found = books.written(known, pages, contents).cache()
    assert {r.package_id for r in found.collect()} == {"1", "2"}
    assert package_rules.check(found).collect() == []
    expected = spark.createDataFrame([("1", 2, 24, 16, True), ("2", 3, 16, 24, True)], "package_id string, pages int, canvas_w int, canvas_h int, grayscale boolean")
    assert {(r.package_id, r.code) for r in package_rules.strict(found, expected).collect()} == {("2", "LB-012")}  # a mixed book has pages beside its first page's size
    opf = {r.package_id: r.content.decode() for r in package_rules.tables(found).files.where("name = 'EPUB/package.opf'").collect()}
    assert "A &amp; &lt;B&gt;" in opf["1"] and "rtl" not in opf["1"] and "2025-01-02T03:04:05Z" in opf["1"] and ">landscape<" in opf["1"]
    assert 'direction="rtl"' in opf["2"] and "horizontal-rl" in opf["2"] and [opf["2"].index(f"orientation-{x}") for x in ("portrait", "landscape", "auto")] == sorted(opf["2"].index(f"orientation-{x}") for x in ("portrait", "landscape", "auto"))


def test_contents_that_lead_nowhere_go_with_what_they_hold(spark):
    from quire.operators import preview
    from quire.plans import corpus
    from quire.sources import packages as P

    toc = '<nav epub:type="toc"><ol><li><a href="pages/a.xhtml#x"> A  <b>one</b></a><ol><li><a href="pages/b.xhtml">B</a></li></ol></li><li><a href="none.xhtml">gone</a><ol><li><a href="pages/a.xhtml">lost</a></li></ol></li><li><span>no link</span></li></ol></nav>'
    labels = '<nav epub:type="page-list"><ol><li><a href="pages/b.xhtml">ii</a></li><li><a href="pages/b.xhtml">iii</a></li></ol></nav>'
    data = P.archive([(n, d, 0) for n, d in corpus.parts(toc=toc + labels, view='<meta name="viewport" content="width=5"/>', body='<svg xmlns="http://www.w3.org/2000/svg"><image xmlns:l="http://www.w3.org/1999/xlink" l:href="../art/one.png"/></svg>')])
    t = package_rules.tables(spark.createDataFrame([("p", bytearray(data))], "package_id string, content binary"))
    assert [(r.place, r.depth, r.title, r.page) for r in preview.contents(t).orderBy("place").collect()] == [(1, 0, "A one", 0), (2, 1, "B", 1)]
    assert [(r.page, r.w, r.h, r.image, r.label) for r in preview.pages(t).orderBy("page").collect()] == [(0, 120, 90, corpus.ART, "1"), (1, 5, 0, corpus.ART, "iii")]


def test_reports_and_messages(spark):
    from quire.functions import scalars as S
    from quire.operators import findings

    rows = [("p", i, "é" * (100 + i)) for i in range(3)] + [("p", 5, "x" * 199 + "é")] + [("q", i, "short") for i in range(7)]
    got = findings.first_lines(spark.createDataFrame(rows, "p string, i int, line string"), "p", "i", "line", n=4).collect()
    assert {(r.p, r.i): r.line for r in got} == {("p", 0): "é" * 100, ("p", 1): "é" * 100 + "...", ("p", 2): "é" * 100 + "...", ("p", 5): "x" * 199 + "..."} | {("q", i): "short" for i in range(4)}
    df = spark.createDataFrame([("%1$s %2$s", "%2$s", None), ("%3$s|%1$s%1$s", "a", "b"), (None, "a", "b")], "t string, a string, b string")
    assert [r[0] for r in df.select(S.message(F.col("t"), [F.col("a"), F.col("b")])).collect()] == ["%2$s ", "|aa", None]
