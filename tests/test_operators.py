import itertools
import math
import random
import re
import time
from collections import Counter
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire import session
from quire.functions import paths
from quire.functions import scalars as S
from quire.operators import blocks, entropy, geometry, links
from quire.streaming import jobs

def plain_canvas(pages, edge):
    """The modal size, grown at its shape until every page fits, capped and made even, in whole numbers."""
    counts = Counter(pages)
    mw, mh = max(counts, key=lambda s: (counts[s], s[0] * s[1], s[0]))
    w = max(max(x, -(-y * mw // mh)) for x, y in pages)
    h = -(-w * mh // mw)
    if 0 < edge < max(w, h):
        w, h = w * edge // max(w, h), h * edge // max(w, h)
    return max(2, w - w % 2), max(2, h - h % 2)


def test_canvas(spark):
    r = random.Random(11)
    books = {i: [(r.choice((700, 701, 1900)) + r.randint(0, 2), r.choice((900, 1203, 40)) + r.randint(0, 1)) for _ in range(r.randint(1, 30))] for i in range(40)}
    books[40] = [(70, 90)] * 3 + [(90, 70)] * 3  # a tie of equal areas goes to the wider
    pages = spark.createDataFrame([(i, w, h) for i, p in books.items() for w, h in p], "b int, w long, h long")
    for edge in (0, 800, 5000):
        assert {x.b: (x.canvas_w, x.canvas_h) for x in geometry.canvas(pages, "b", edge).collect()} == {i: plain_canvas(p, edge) for i, p in books.items()}


def one(spark, *columns, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(*columns).first()


def plain_range(spec, total):
    """(error, pages) of a page range, read part by part."""
    out, late, parts = set(), False, [p for p in re.split("[,; ]", spec) if p]
    for p in parts:
        m = re.fullmatch(r"(\d+)|(\d*)-(\d*)", p, re.ASCII)
        if not m or p == "-":
            return "syntax", []
        first, last = (int(p), int(p)) if m[1] else (int(m[2] or 1), int(m[3] or total))
        if first < 1 or m[3] and (last < 1 or last < first):
            return "syntax", []
        late |= first > total or last > total
        out |= set(range(first - 1, last))
    return ("out of range", []) if late else ("", sorted(out) if parts else list(range(total)))


def test_page_ranges(spark):
    r = random.Random(12)
    specs = {"".join(r.choice(["1", "4", "12", "07", "-", "-", ",", ";", " ", "x", "0"]) for _ in range(r.randint(0, 7))) for _ in range(400)} | {"", "6-", "-6", "9,2-4;3 1", "13", "12-13"}
    df = spark.createDataFrame([(s, 12) for s in specs], "spec string, total int").withColumn("k", F.col("spec"))
    got = {r.k: (r.error, r.pages) for r in geometry.select_pages(df, "k").collect()}
    assert got == {s: plain_range(s, 12) for s in specs} and {e for e, _ in got.values()} == {"", "syntax", "out of range"}


def test_scalars(spark):
    r = random.Random(13)
    colours = {tuple(r.randint(0, 255) for _ in range(3)) for _ in range(200)} | {(0, 0, 0), (255, 255, 255)}
    df = spark.createDataFrame(list(colours), "r int, g int, b int")
    assert {(x.r, x.g, x.b): x.y for x in df.withColumn("y", S.luma(F.col("r"), F.col("g"), F.col("b"))).collect()} == {c: round(sum(a * b for a, b in zip(c, (2126, 7152, 722), strict=True)) / 10_000 + 1e-9) for c in colours}
    sides = [tuple(r.randint(1, 4000) for _ in range(4)) for _ in range(200)]
    w, h = S.fit(*[F.col(c) for c in ("w", "h", "bw", "bh")])
    for x in spark.createDataFrame(sides, "w int, h int, bw int, bh int").select("*", w.alias("fw"), h.alias("fh")).collect():
        s = min(x.bw / x.w, x.bh / x.h)
        assert (x.fw, x.fh) == (max(1, min(x.bw, math.floor(x.w * s + 0.5))), max(1, min(x.bh, math.floor(x.h * s + 0.5))))
    sizes = {7: "7 B", 1000: "1000 B", 2048: "2.0 KiB", 99_000: "96.7 KiB", 7 << 20: "7.0 MiB", 9 << 29: "4.5 GiB"}
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert {r.n: r.s for r in df.withColumn("s", S.human_bytes(F.col("n"))).collect()} == sizes


def test_chains_of_fallbacks_end_after_32_hops(spark):
    rows = [(n, i, "core" if i == n else "other", i + 1) for n in (0, 1, 31, 32, 33, 34, 40, 60, 63, 64, 70) for i in range(n + 1)] + [(-1, 0, "other", 1), (-1, 1, "other", 0)]
    got = {(r.package, r.id): r.end for r in links.fallback_end(spark.createDataFrame(rows, "package int, id int, media_type string, fallback int"), ["core"]).collect()}
    assert got == {(n, i): n if n >= 0 and n - i <= 32 else None for n, i, _, _ in rows}


def test_contents_of_a_page(spark):
    r = random.Random(14)
    entries = [(b, i, r.choice([None, *range(9)]), f"t{b}.{i}") for b in range(6) for i in range(r.randint(0, 12))]
    pages = [(b, c) for b in range(8) for c in (None, *range(-1, 10))]
    got = {(x.b, x.cur): (x.ord, x.title) for x in links.contents_at(spark.createDataFrame(pages, "b int, cur int"), spark.createDataFrame(entries, "b int, ord int, page int, title string"), "b").collect()}
    assert got == {(b, c): max(((o, t) for k, o, p, t in entries if k == b and p is not None and c is not None and p <= c), default=(None, None)) for b, c in pages}


def test_byte_histogram(spark):
    rows = [("a", "xyx"), ("a", None), ("b", ""), (None, "é"), ("a", "x")]
    got = {(r.k, r.symbol): r.n for r in entropy.byte_histogram(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()}
    assert got == {("a", 120): 3, ("a", 121): 1, (None, 0xC3): 1, (None, 0xA9): 1}


def test_language_tags(spark):
    good, bad = ["sw", "de-Latn-CH", "es-419", "sl-rozaj-biske", "x-whatever", "zh-min-nan", "i-klingon", "fr-u-ca-x-a", "en-a-bb-b-cc"], ["", "e", "no spaces", "de_CH", "-de", "de-", "de-a", "fr-u-ca-u-co", "x", "de-x", "de--CH", "toolonglanguage"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = {r.t: r.e for r in df.withColumn("e", S.language_tag_error(F.col("t"))).collect()}
    assert all(got[t] == "" for t in good) and all(got[t] for t in bad)


def test_paths():
    assert paths.resolve("OEBPS/a/b.xhtml", "../c%20d.jpg?x#y") == "OEBPS/c d.jpg" and paths.resolve("a/b", "#x") is None and paths.resolve("a/b", "http://x/y") is None
    assert paths.resolve("a/b", "/c/../d") == "d" and paths.resolve("a/b", "c%zz") == "a/c%zz" and paths.preview_path("a/b", "/c") == "c" and paths.preview_path("a/b", "//h/c") == ""
    assert paths.url_error("a b") and paths.url_error("a%2") and paths.url_error("a#b#c") and not paths.url_error("a?b#c%20é")
    assert paths.css_error(b"a { b: 'x' } /* } */") is None and paths.css_error(b"a {\n b") == (2, "unterminated block") and paths.css_error(b'a\n"x') == (2, "unterminated string") and paths.css_error(b"}")[1] == "unexpected brace" and paths.css_error(b"/* x")[1] == "unterminated comment"


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 10**9), min_size=1, max_size=120))
def test_code_lengths(freq):
    lengths = entropy.code_lengths(freq)
    codes = entropy.canonical_codes(lengths)
    assert set(lengths) == set(freq) and max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1
    words = [f"{codes[s]:0{n}b}" for s, n in lengths.items()]
    assert not any(a != b and b.startswith(a) for a, b in itertools.permutations(words[:25], 2)) and all(len(w) <= 16 and "0" in w for w in words)


def test_fibonacci_code_is_limited():
    f = [1, 1]
    while len(f) < 40:
        f.append(f[-1] + f[-2])
    assert max(entropy.code_lengths(dict(enumerate(f))).values()) == 16
    assert entropy.code_lengths({7: 9}) == {7: 1} and entropy.stuffed([(255, 8), (1, 1)]) == b"\xff\x00\xff\x00"


def test_blocks(spark):
    flat = spark.createDataFrame([([8.0] * 64,)], "b array<double>")
    r = blocks.quantised(blocks.cosine_terms(flat, "b"), "terms", [16] * 64).first()
    assert r.terms[0] == pytest.approx(64) and max(map(abs, r.terms[1:])) < 1e-9 and r.quantised == [4] + [0] * 63


def test_job_stream(spark, tmp_path):
    ts = "timestamp'2024-01-01 00:00:00'"
    rows = [(1, 1, "inspecting", 0), (1, 2, "ready", 10), (1, 4, "converting", 20), (1, 5, "queued", 30), (1, 6, "converting", 200), (1, 7, "converting", 210), (1, 8, "converting", 400), (1, 3, "ready", 500), (2, 1, "inspecting", 0)]
    df = spark.createDataFrame(rows, "job_id long, seq long, state string, ms long").withColumn("ts", F.expr(f"{ts} + make_dt_interval(0, 0, 0, ms / 1000.0)")).drop("ms")
    df.where("seq <> 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    time.sleep(1.1)  # files are taken by their time
    df.where("seq = 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = jobs.follow(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.table("followed").collect())
    assert got == [(1, 1, "inspecting"), (1, 2, "ready"), (1, 5, "queued"), (1, 6, "converting"), (1, 8, "converting"), (2, 1, "inspecting")]
    assert {(r.job_id, r.seq, r.state) for r in jobs.latest(df, ["state"]).collect()} == {(1, 8, "converting"), (2, 1, "inspecting")}


@pytest.mark.parametrize("master", ["spark://a:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    conf = {}
    session_ = SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(session_, "x")
    conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert session.shared_dir(session_, "x").startswith("hdfs:///shared/quire-app/x-")
