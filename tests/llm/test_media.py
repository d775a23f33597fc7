import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import transport, warc
from tests.llm.fixtures import documents, empty, rows


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 900))
def test_mux_round_trip(n):
    x = random.Random(n).randbytes(64 * n)
    stream = transport.mux(x)
    found = transport.demux(stream)
    assert found["payload"] == x and not any(found["errors"].values()) and len(stream) % 188 == 0
    assert found["programs"] == {1: transport.PMT_PID} and found["streams"] == {transport.DATA_PID: transport.STREAM_TYPE}
    assert len(found["random_access"]) == len(found["pts"]) == -(-len(x) // transport.UNIT) and found["pts"] == sorted(found["pts"])


def test_lost_and_damaged_packets_are_seen():
    stream = transport.mux(bytes(range(256)) * 300)
    lost = transport.demux(stream[: 188 * 10] + stream[188 * 11 :])
    assert lost["errors"]["continuity"] == 1 and lost["errors"]["unit"] == 1 and len(lost["pts"]) == -(-76_800 // transport.UNIT) - 1
    damaged = bytearray(stream)
    damaged[10] ^= 1  # in the first PAT
    assert transport.demux(bytes(damaged))["errors"]["crc"] == 1
    assert transport.demux(b"\0" * 188)["errors"]["sync"] == 1


def test_media_columns(spark):
    want = sorted((str(r[0]), hashlib.sha256(transport.padded(r[1])[1]).hexdigest(), zlib.crc32(transport.padded(r[1])[1][-64:]), len((r[1] or "").encode())) for r in rows())
    got = transport.media_columns(documents(spark)).collect()
    assert sorted((str(r.doc_id), r.payload_sha256, r.tail_crc32, r.n_bytes) for r in got) == want
    same = {}
    for r in got:
        assert r.payload_bytes >= 64 and r.payload_bytes % 64 == 0
        assert same.setdefault(r.payload_sha256, (r.feature, r.media_sha256, r.media_bytes)) == (r.feature, r.media_sha256, r.media_bytes)
    assert transport.media_columns(empty(spark)).count() == 0


PAGES = [(i, f"http://h{i % 4}.example.com/p{i % 7}?q={i}", f"<p>{i % 5}</p>" * (1 + 20 * (i % 3))) for i in range(60)]
PAGES += [(100, None, None), (101, "", ""), (102, "http://[bad", "x" * 100), (103, "http://a.b/ü\r\n", "y" * 99), (104, "u", "y" * 99), (None, "n", "x" * 100), (50, PAGES[50][1], PAGES[50][2]), (106, "v", "x" * 200_000)]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", transport.F.lit("clash"))
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        to = first[h] if len(b) >= 100 and i is not None and first[h] != i else None
        want.append(str((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to)))
    got = warc.capture_histories(spark, pages).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(want) and any("revisit" in w for w in want)
    keys = [(r.url_key, r.timestamp) for r in got]
    assert keys == sorted(keys)
    assert warc.capture_histories(spark, pages.limit(0)).count() == 0


def test_merge_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_BLOCK", 3)
    monkeypatch.setattr(warc, "MERGE_ROWS", 5)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(5)
    got = warc.capture_histories(spark, pages).collect()
    keys = [(r.url_key, r.timestamp) for r in got]
    assert len(got) == len(PAGES) and keys == sorted(keys)


def test_many_runs_are_merged_in_passes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    want = sorted(map(str, warc.capture_histories(spark, pages).drop("archive", "offset", "length").collect()))
    monkeypatch.setattr(warc, "FAN", 3)
    runs = warc.write_runs(warc.write_archives(pages, f"file://{tmp_path}/a"), f"file://{tmp_path}/r")
    assert runs.select("run").distinct().count() > 9
    few = warc.longer_runs(runs, f"file://{tmp_path}/m")
    assert few.select("run").distinct().count() <= 3 and few.agg({"rows": "sum"}).first()[0] == len(PAGES)
    got = warc.merged(few).collect()
    assert sorted(str(r) for r in warc.merged(few).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp").collect()) == want
    assert [(r.url_key, r.timestamp) for r in got] == sorted((r.url_key, r.timestamp) for r in got)


def test_empty_payloads_close_archives(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4096)
    pages = spark.createDataFrame([(i, f"u{i}", None) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    assert warc.write_archives(pages, f"file://{tmp_path}/a").count() > 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    merged = [x for x, _ in warc.LoserTree(iter([(v, i) for v in sorted(r)]) for i, r in enumerate(runs))]
    assert merged == sorted(x for r in runs for x in r)
