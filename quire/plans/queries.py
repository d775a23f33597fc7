"""Registered queries over the engine's own operators, each with its SQL twin.

The driver's tables hold no books, so inputs are derived from them: `books` from lineitem (a supplier's
lines are its pages), findings from events, packages from orders and customers. A query's inputs are the
whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.operators import blocks, colours, encoder, entropy, findings, geometry, links, preview, relaxng
from quire.plans import package_rules, validation
from quire.session import table, written
from quire.sources import packages
from quire.sources.books import written as books_written

QUERIES: dict = dict(validation.QUERIES)
ORACLES: dict[str, str] = dict(validation.ORACLES)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Pages of books: the line's number orders them.
_BOOKS = """books AS (SELECT l_suppkey AS book_id, l_orderkey * 10 + l_linenumber AS page_no,
  600 + (l_partkey % 5) * 100 + l_orderkey % 3 AS w, 800 + (l_linenumber % 3) * 50 + l_orderkey % 2 AS h FROM lineitem)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("book_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page_no"),
        (600 + F.col("l_partkey") % 5 * 100 + F.col("l_orderkey") % 3).alias("w"), (800 + F.col("l_linenumber") % 3 * 50 + F.col("l_orderkey") % 2).alias("h"),
    )


_CANVAS = f"""WITH {_BOOKS}, sizes AS (SELECT book_id, w, h, count(*) AS n FROM books GROUP BY ALL),
mode AS (SELECT book_id, w AS mw, h AS mh FROM sizes QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY n DESC, w * h DESC, w DESC) = 1),
grown AS (SELECT book_id, max(greatest(w, (h * mw + mh - 1) // mh)) AS cw, any_value(mw) AS mw, any_value(mh) AS mh FROM sizes JOIN mode USING (book_id) GROUP BY book_id),
tall AS (SELECT book_id, cw, (cw * mh + mw - 1) // mw AS ch FROM grown),
capped AS (SELECT book_id, CASE WHEN greatest(cw, ch) > 900 THEN cw * 900 // greatest(cw, ch) ELSE cw END AS cw,
                  CASE WHEN greatest(cw, ch) > 900 THEN ch * 900 // greatest(cw, ch) ELSE ch END AS ch FROM tall),
canvas AS (SELECT book_id, CAST(greatest(2, cw - cw % 2) AS BIGINT) AS canvas_w, CAST(greatest(2, ch - ch % 2) AS BIGINT) AS canvas_h FROM capped)"""


@query(_CANVAS + """ SELECT book_id, canvas_w, canvas_h, CASE WHEN canvas_w > canvas_h THEN 'landscape' WHEN canvas_h > canvas_w THEN 'portrait' ELSE 'auto' END AS rendition,
 CASE WHEN canvas_w > canvas_h THEN 'landscape' WHEN canvas_h > canvas_w THEN 'portrait' ELSE 'none' END AS lock FROM canvas""")
def canvas_per_book(spark, sf_dir):
    """A1 A2 M2 M4 M6: the canvas of every book and its orientation."""
    found = geometry.canvas(books(spark, sf_dir), "book_id", 900)
    turn = S.book_orientation(F.col("canvas_w"), F.col("canvas_h"), F.lit(""), F.lit(False))
    return found.select("book_id", "canvas_w", "canvas_h", turn["rendition"].alias("rendition"), turn["lock"].alias("lock"))


@query(f"""WITH {_BOOKS}, turned AS (SELECT book_id, CASE WHEN page_no % 4 = 0 THEN h ELSE w END AS w, CASE WHEN page_no % 4 = 0 THEN w ELSE h END AS h FROM books)
SELECT book_id, count(*) FILTER (w > h) AS landscape, count(*) FILTER (h > w) AS portrait, count(*) FILTER (w = h) AS square,
 (max(CAST(w > h AS INT)) + max(CAST(h > w AS INT)) + max(CAST(w = h AS INT))) > 1 AS mixed FROM turned GROUP BY book_id""")
def orientation_tally(spark, sf_dir):
    """A3 M5: pages by orientation."""
    turned = F.col("page_no") % 4 == 0
    pages = books(spark, sf_dir).select("book_id", F.when(turned, F.col("h")).otherwise(F.col("w")).alias("w"), F.when(turned, F.col("w")).otherwise(F.col("h")).alias("h"))
    return geometry.orientation_tally(pages, "book_id")


_SPECS = """specs AS (SELECT o_orderkey, 10 AS total, CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN CAST(o_custkey % 10 + 1 AS VARCHAR)
 WHEN 2 THEN CAST(o_custkey % 5 + 1 AS VARCHAR) || '-' || CAST(o_custkey % 5 + 3 AS VARCHAR) || ', ' || CAST(o_custkey % 12 + 1 AS VARCHAR)
 WHEN 3 THEN CAST(o_custkey % 10 + 1 AS VARCHAR) || '-' WHEN 4 THEN '-' || CAST(o_custkey % 10 + 1 AS VARCHAR)
 WHEN 5 THEN '5,1-2;5 ' || CAST(o_custkey % 10 + 1 AS VARCHAR) WHEN 6 THEN CAST(o_custkey % 6 AS VARCHAR) || '-' || CAST(o_orderkey % 5 AS VARCHAR) ELSE '1-x, 2' END AS spec FROM orders)"""


def specs(spark, sf_dir):
    text = lambda c: c.cast("string")
    k, c = F.col("o_orderkey") % 8, F.col("o_custkey")
    spec = (
        F.when(k == 0, "").when(k == 1, text(c % 10 + 1)).when(k == 2, F.concat(text(c % 5 + 1), F.lit("-"), text(c % 5 + 3), F.lit(", "), text(c % 12 + 1)))
        .when(k == 3, F.concat(text(c % 10 + 1), F.lit("-"))).when(k == 4, F.concat(F.lit("-"), text(c % 10 + 1))).when(k == 5, F.concat(F.lit("5,1-2;5 "), text(c % 10 + 1)))
        .when(k == 6, F.concat(text(c % 6), F.lit("-"), text(F.col("o_orderkey") % 5))).otherwise("1-x, 2")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lit(10).alias("total"), spec.alias("spec"))


_SELECT = _SPECS + """, parts AS (SELECT *, list_filter(regexp_split_to_array(spec, '[,; ]'), lambda p: p <> '') AS parts FROM specs),
spans AS (SELECT o_orderkey, total, parts,
 list_bool_or(list_transform(parts, lambda p: NOT regexp_full_match(p, '[0-9]*-?[0-9]*') OR p = '-' OR coalesce(try_cast(regexp_extract(p, '^([0-9]*)(-?)([0-9]*)$', 1) AS BIGINT) < 1, false)
  OR coalesce(try_cast(regexp_extract(p, '^([0-9]*)(-?)([0-9]*)$', 3) AS BIGINT) < 1, false)
  OR coalesce(try_cast(regexp_extract(p, '^([0-9]*)(-?)([0-9]*)$', 3) AS BIGINT) < try_cast(regexp_extract(p, '^([0-9]*)(-?)([0-9]*)$', 1) AS BIGINT), false))) AS bad,
 CASE WHEN len(parts) = 0 THEN [[1, total]] ELSE list_transform(parts, lambda p: [coalesce(try_cast(regexp_extract(p, '^([0-9]*)(-?)([0-9]*)$', 1) AS BIGINT), 1),
  CASE WHEN contains(p, '-') THEN coalesce(try_cast(regexp_extract(p, '^([0-9]*)(-?)([0-9]*)$', 3) AS BIGINT), total) ELSE try_cast(p AS BIGINT) END]) END AS spans FROM parts),
chosen AS (SELECT o_orderkey, CASE WHEN coalesce(bad, false) THEN 'syntax' WHEN len(parts) > 0 AND len(list_filter(spans, lambda s: s[1] > total OR s[2] > total)) > 0 THEN 'out of range' ELSE '' END AS error, spans FROM spans),
selected AS (SELECT o_orderkey, error, CASE WHEN error = '' THEN list_sort(list_distinct(flatten(list_transform(spans, lambda s: range(s[1] - 1, s[2]))))) ELSE [] END AS pages FROM chosen)"""


@query(f"WITH {_SELECT} SELECT o_orderkey, error, array_to_string(pages, ',') AS pages FROM selected")
def page_range_select(spark, sf_dir):
    """Page ranges and the pages that they select."""
    found = geometry.select_pages(specs(spark, sf_dir), "o_orderkey")
    return found.select("o_orderkey", "error", F.concat_ws(",", F.col("pages").cast("array<string>")).alias("pages"))


@query(f"WITH {_SELECT} SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey % 12 AS page, CAST(coalesce(list_position(s.pages, l_partkey % 12), 0) - 1 AS BIGINT) AS slot FROM lineitem LEFT JOIN selected s ON l_orderkey = s.o_orderkey")
def book_slots(spark, sf_dir):
    """bookmarks' pages mapped to places in the book, -1 for pages left out."""
    selected = geometry.select_pages(specs(spark, sf_dir), "o_orderkey")
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", (F.col("l_partkey") % 12).alias("page"))
    return geometry.slot_of(marks, selected, "o_orderkey")


@query("""WITH scans AS (SELECT l_suppkey AS book_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS page_no, l_partkey % 997 <> 3 AS scan,
  1000 + l_partkey % 700 AS pw, 1400 + l_orderkey % 300 AS ph, 360.0 + l_linenumber AS w, 500.0 + l_linenumber AS h FROM lineitem),
ppi AS (SELECT book_id, page_no, scan, CASE WHEN abs(pw / (w / 72.0) - ph / (h / 72.0)) <= abs(pw / (h / 72.0) - ph / (w / 72.0))
  THEN (pw / (w / 72.0) + ph / (h / 72.0)) / 2 ELSE (pw / (h / 72.0) + ph / (w / 72.0)) / 2 END AS ppi FROM (SELECT book_id, page_no, scan, CAST(pw AS DOUBLE) AS pw, CAST(ph AS DOUBLE) AS ph, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM scans)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_no) - 1 AS pos, count(*) OVER (PARTITION BY book_id) AS n FROM ppi),
seen AS (SELECT * FROM ranked WHERE n <= 9 OR list_contains(list_transform(range(0, 9), lambda k: k * (n - 1) // 8), pos))
SELECT book_id, CASE WHEN bool_and(scan) THEN CAST(round(least(greatest(list_sort(list(ppi))[count(*) // 2 + 1], 72.0), 600.0)) AS BIGINT) END AS ppi FROM seen GROUP BY book_id""")
def scan_ppi_median(spark, sf_dir):
    """A scanned book's resolution from nine of its pages."""
    lines = table(spark, sf_dir, "lineitem")
    ppi = S.pixels_per_inch((1000 + F.col("l_partkey") % 700).cast("double"), (1400 + F.col("l_orderkey") % 300).cast("double"), (F.col("l_linenumber") + 360).cast("double"), (F.col("l_linenumber") + 500).cast("double"))
    pages = lines.select(F.col("l_suppkey").alias("book_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("page_no"), ppi.alias("ppi"), (F.col("l_partkey") % 997 != 3).alias("scan"))
    return geometry.scan_resolution(pages, "book_id", "page_no")


_PIXELS = """pixels AS (SELECT l_suppkey AS image_id, CAST(200 + l_linenumber % 3 * 20 AS BIGINT) AS r, CAST(190 + l_partkey % 2 * 40 AS BIGINT) AS g, CAST(180 + l_orderkey % 2 * 50 AS BIGINT) AS b FROM lineitem),
colours AS (SELECT image_id, r, g, b, count(*) AS n FROM pixels GROUP BY ALL),
best AS (SELECT image_id, r, g, b, n, sum(n) OVER (PARTITION BY image_id) AS all_n, (r * 2126 + g * 7152 + b * 722 + 5000) // 10000 AS grey FROM colours
 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, (r * 2126 + g * 7152 + b * 722 + 5000) // 10000 DESC, r DESC, g DESC, b DESC) = 1)"""


def pixels(spark, sf_dir):
    c = {"r": 200 + F.col("l_linenumber") % 3 * 20, "g": 190 + F.col("l_partkey") % 2 * 40, "b": 180 + F.col("l_orderkey") % 2 * 50}
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image_id"), *[v.cast("long").alias(k) for k, v in c.items()])


@query(f"WITH {_PIXELS} SELECT image_id, r, g, b, n, CAST(all_n AS BIGINT) AS pixels FROM best")
def luma_mode(spark, sf_dir):
    """The modal colour of each image."""
    return colours.modal_colour(pixels(spark, sf_dir), "image_id").withColumnRenamed("all", "pixels")


@query(f"""WITH {_PIXELS} SELECT image_id, printf('#%02X%02X%02X', r, g, b) AS colour, grey, CAST(n * 100 // all_n AS BIGINT) AS cover, (grey - 8) * 100 // 255 AS white_point,
 n * 100 // all_n >= 25 AND grey BETWEEN 120 AND 250 AS active FROM best""")
def flatten_detect(spark, sf_dir):
    """Backgrounds that flattening would whiten."""
    return colours.background(pixels(spark, sf_dir), "image_id")


_LINES = """lines AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN event_type || ': note' ELSE
 (CASE event_id % 4 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'FATAL' ELSE 'USAGE' END) || '(' || (CASE user_id % 3 WHEN 0 THEN 'RSC' WHEN 1 THEN 'OPF' ELSE 'HTM' END) || '-' ||
 lpad(CAST(user_id % 7 AS VARCHAR), 3, '0') || '): ' || event_type END AS line FROM events)"""


def finding_lines(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    label = F.concat(F.element_at(F.array(*map(F.lit, ("ERROR", "WARNING", "FATAL", "USAGE"))), (e % 4 + 1).cast("int")), F.lit("("), F.element_at(F.array(*map(F.lit, ("RSC", "OPF", "HTM"))), (u % 3 + 1).cast("int")), F.lit("-"), F.lpad((u % 7).cast("string"), 3, "0"), F.lit("): "), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.when(e % 11 == 0, F.concat("event_type", F.lit(": note"))).otherwise(label).alias("line"))


@query(f"""WITH {_LINES}, codes AS (SELECT CASE WHEN regexp_matches(line, '^[A-Z]+\\([A-Z]{{2,3}}[-_][0-9]{{3}}[a-z]?\\)') THEN regexp_extract(line, '^[A-Z]+\\([A-Z]{{2,3}}[-_][0-9]{{3}}[a-z]?\\)') ELSE split_part(line, ':', 1) END AS code FROM lines)
SELECT code, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, code) AS INT) AS rank FROM codes GROUP BY code""")
def problem_tally(spark, sf_dir):
    """Findings by code, most frequent first."""
    return findings.tally(finding_lines(spark, sf_dir).select(S.finding_code(F.col("line")).alias("code")), "code")


_FINDINGS = """findings AS (SELECT user_id AS package_id, event_id AS emit_seq, CAST(event_id % 6 AS INT) AS severity, event_type AS path, CAST(event_id % 5 AS INT) AS line, CAST(event_id % 3 AS INT) AS col FROM events)"""


def finding_rows(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("package_id"), e.alias("emit_seq"), (e % 6).cast("int").alias("severity"), F.col("event_type").alias("path"), (e % 5).cast("int").alias("line"), (e % 3).cast("int").alias("col"))


@query(f"WITH {_FINDINGS} SELECT *, CAST(row_number() OVER (PARTITION BY package_id ORDER BY path, line, col, emit_seq) AS INT) AS place FROM findings WHERE severity > 0")
def finding_order(spark, sf_dir):
    """O1 F1: findings of each package in reporting order."""
    return findings.ordered(findings.shown(finding_rows(spark, sf_dir)), "package_id")


@query(f"""WITH {_FINDINGS} SELECT package_id, count(*) FILTER (severity = 1) AS usage, count(*) FILTER (severity = 2) AS info, count(*) FILTER (severity = 3) AS warning,
 count(*) FILTER (severity = 4) AS error, count(*) FILTER (severity = 5) AS fatal, max(CAST(severity >= 4 AS INT)) AS status FROM findings GROUP BY package_id""")
def exit_status(spark, sf_dir):
    """Counts by severity, and the status of each package."""
    return findings.exit_status(finding_rows(spark, sf_dir), "package_id")


@query("""WITH f AS (SELECT DISTINCT user_id AS package_id, event_type AS code, CAST(event_id % 6 AS INT) AS severity, CAST(event_id % 3 AS VARCHAR) AS path FROM events),
got AS (SELECT * FROM f WHERE severity >= 3), wanted AS (SELECT DISTINCT package_id, code, severity, CASE WHEN package_id % 5 = 0 THEN 'x' ELSE path END AS path FROM got WHERE package_id % 7 <> 0)
SELECT *, 'extra' AS side FROM (SELECT * FROM got EXCEPT SELECT * FROM wanted) UNION ALL SELECT *, 'missing' AS side FROM (SELECT * FROM wanted EXCEPT SELECT * FROM got)""")
def golden_differences(spark, sf_dir):
    """Normalised findings against recorded ones, both ways."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("package_id"), F.col("event_type").alias("code"), (F.col("event_id") % 6).cast("int").alias("severity"), (F.col("event_id") % 3).cast("string").alias("path"))
    got = findings.normalised(rows, "package_id")
    wanted = got.where("package_id % 7 <> 0").withColumn("path", F.when(F.col("package_id") % 5 == 0, "x").otherwise(F.col("path"))).distinct()
    return findings.compared(got, wanted)


@query("""SELECT 'orders' AS side, o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey < 15)
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def undeclared_refs(spark, sf_dir):
    """Orders as manifest rows without an archive entry (customer), and entries that no row names."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    missing = links.undeclared(orders, people.where("c_nationkey < 15"), ["k"]).select(F.lit("orders").alias("side"), F.col("o_orderkey").alias("key"))
    return missing.union(links.undeclared(people, orders, ["k"]).select(F.lit("customer"), "k"))


@query("""WITH refs AS (SELECT l_suppkey % 10 AS package_id, l_orderkey, l_linenumber, 'p' || CAST(l_partkey % 60 AS VARCHAR) AS target, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'img' END AS element FROM lineitem),
entries AS (SELECT DISTINCT s_suppkey % 10 AS package_id, 'p' || CAST(s_suppkey % 50 AS VARCHAR) AS path FROM supplier),
manifest AS (SELECT package_id, path, arg_max(media_type, ord) AS media_type FROM (SELECT s_suppkey % 10 AS package_id, 'p' || CAST(s_suppkey % 45 + 5 AS VARCHAR) AS path,
  CASE WHEN s_suppkey % 3 = 0 THEN 'image/png' ELSE 'application/xhtml+xml' END AS media_type, s_suppkey AS ord FROM supplier) GROUP BY ALL),
spine AS (SELECT DISTINCT s_suppkey % 10 AS package_id, 'p' || CAST(s_suppkey % 30 AS VARCHAR) AS path FROM supplier)
SELECT r.*, CASE WHEN e.path IS NULL AND m.path IS NOT NULL THEN 'declared_only' WHEN e.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'undeclared'
 WHEN r.element = 'a' AND m.media_type = 'application/xhtml+xml' AND s.path IS NULL THEN 'not_in_spine' ELSE 'ok' END AS status
FROM refs r LEFT JOIN entries e ON r.package_id = e.package_id AND r.target = e.path LEFT JOIN manifest m ON r.package_id = m.package_id AND r.target = m.path LEFT JOIN spine s ON r.package_id = s.package_id AND r.target = s.path""")
def reference_status(spark, sf_dir):
    """Where each reference's target is found, in the order that decides its code."""
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    refs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("package_id"), "l_orderkey", "l_linenumber", name(F.col("l_partkey") % 60).alias("target"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("img").alias("element"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 10).alias("package_id"), F.col("s_suppkey").alias("k"))
    kind = F.when(F.col("k") % 3 == 0, "image/png").otherwise("application/xhtml+xml")
    return links.reference_status(
        refs, s.select("package_id", name(F.col("k") % 50).alias("path")), s.select("package_id", name(F.col("k") % 45 + 5).alias("path"), kind.alias("media_type"), F.col("k").alias("ord")),
        s.select("package_id", name(F.col("k") % 30).alias("path")), "package_id",
    )


# Package 0 has chains of up to 69 hops.
_ITEMS = """items AS (SELECT p_size AS package_id, p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN 'application/xhtml+xml' ELSE 'application/pdf' END AS media_type,
 CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN p_partkey - 50 ELSE p_partkey + 50 END AS fallback FROM part
 UNION ALL SELECT 0, p_partkey, CASE WHEN p_partkey % 70 = 0 THEN 'application/xhtml+xml' ELSE 'application/pdf' END, p_partkey + 1 FROM part)"""


@query(f"""WITH RECURSIVE {_ITEMS}, walk AS (SELECT package_id, id AS start, id, media_type, fallback, 0 AS hops FROM items
 UNION ALL SELECT w.package_id, w.start, i.id, i.media_type, i.fallback, w.hops + 1 FROM walk w JOIN items i ON i.package_id = w.package_id AND i.id = w.fallback WHERE w.media_type <> 'application/xhtml+xml' AND w.hops < 32)
SELECT i.package_id, i.id, w.id AS "end" FROM items i LEFT JOIN (SELECT package_id, start, any_value(id) AS id FROM walk WHERE media_type = 'application/xhtml+xml' GROUP BY ALL) w ON w.package_id = i.package_id AND w.start = i.id""")
def fallback_chain(spark, sf_dir):
    """Where each item's chain of fallbacks ends, with cycles cut at 32 hops."""
    k = F.col("p_partkey")
    kind = lambda n: F.when(k % n == 0, "application/xhtml+xml").otherwise("application/pdf").alias("media_type")
    parts = table(spark, sf_dir, "part")
    items = parts.select(F.col("p_size").alias("package"), k.alias("id"), kind(9), F.when(k % 5 == 0, None).when(k % 13 == 0, k - 50).otherwise(k + 50).alias("fallback"))
    items = items.union(parts.select(F.lit(0), k, kind(70), k + 1))
    return links.fallback_end(items, ["application/xhtml+xml"]).withColumnRenamed("package", "package_id")


@query("""SELECT doc_id, source, CAST(nth AS INT) AS nth FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS nth FROM documents) WHERE nth > 1""")
def duplicate_ids(spark, sf_dir):
    """Rows after the first of their key."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    return links.repeated(rows, ["source", "h"], ["doc_id"]).select("doc_id", "source", F.col("nth").cast("int"))


@query("""WITH entries AS (SELECT conv_id, turn AS ord, (turn * 7) % 5 AS page, role || CAST(turn AS VARCHAR) AS title FROM conversations),
pages AS (SELECT DISTINCT conv_id, turn % 6 AS cur FROM conversations)
SELECT p.conv_id, p.cur, arg_max(e.title, e.ord) FILTER (e.page <= p.cur) AS title, max(e.ord) FILTER (e.page <= p.cur) AS ord FROM pages p LEFT JOIN entries e ON e.conv_id = p.conv_id GROUP BY ALL""")
def toc_asof(spark, sf_dir):
    """The contents entry that a page belongs to, by document order."""
    c = table(spark, sf_dir, "conversations")
    entries = c.select("conv_id", F.col("turn").alias("ord"), (F.col("turn") * 7 % 5).alias("page"), F.concat("role", F.col("turn").cast("string")).alias("title"))
    return links.contents_at(c.select("conv_id", (F.col("turn") % 6).alias("cur")).distinct(), entries, "conv_id")


@query("""WITH names AS (SELECT conv_id, turn, role || '.epub' AS name FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY conv_id, turn) AS nth FROM names)
SELECT conv_id, turn, name, CAST(nth AS INT) AS nth, CASE WHEN nth = 1 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || ' (' || CAST(nth AS VARCHAR) || ')' || regexp_extract(name, '\\.[^.]*$') END AS unique_name FROM n""")
def download_names(spark, sf_dir):
    """Names of books in one bundle."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(".epub")).alias("name"))
    return links.numbered_names(rows, "name", ["conv_id", "turn"])


_TAG = S.LANGUAGE_TAG.replace("'", "''")
_OLD = ", ".join(f"'{t}'" for t in S.GRANDFATHERED)


@query(f"""WITH tags AS (SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN lang || '-Latn' WHEN 1 THEN lang || '_PK' WHEN 2 THEN 'x-' || lang WHEN 3 THEN '-' || lang WHEN 4 THEN lang || '-' WHEN 5 THEN 'zh-Hant-TW'
 WHEN 6 THEN lang || '-a-bb-a-cc' WHEN 7 THEN 'i-klingon' WHEN 8 THEN 'u' WHEN 9 THEN '' WHEN 10 THEN lang || '-GB-1996-x-' || source ELSE lang END AS tag FROM documents),
parts AS (SELECT *, string_split(lower(tag), '-') AS parts, list_filter(string_split(regexp_replace(lower(tag), '(^|-)x-.*$', ''), '-'), lambda p: length(p) = 1) AS single FROM tags)
SELECT doc_id, tag, CASE WHEN tag IS NULL OR tag = '' THEN 'empty tag' WHEN lower(tag) IN ({_OLD}) THEN '' WHEN list_contains(parts, '') THEN 'empty subtag'
 WHEN len(list_filter(parts, lambda p: NOT regexp_full_match(p, '[a-z0-9]{{1,8}}'))) > 0 THEN 'bad subtag' WHEN NOT regexp_matches(lower(tag), '{_TAG}') THEN 'bad order of subtags'
 WHEN len(single) <> len(list_distinct(single)) THEN 'repeated singleton' ELSE '' END AS error FROM parts""")
def lang_tags(spark, sf_dir):
    """Well-formed language tags."""
    k, lang = F.col("doc_id") % 12, F.col("lang")
    tag = (
        F.when(k == 0, F.concat(lang, F.lit("-Latn"))).when(k == 1, F.concat(lang, F.lit("_PK"))).when(k == 2, F.concat(F.lit("x-"), lang)).when(k == 3, F.concat(F.lit("-"), lang))
        .when(k == 4, F.concat(lang, F.lit("-"))).when(k == 5, "zh-Hant-TW").when(k == 6, F.concat(lang, F.lit("-a-bb-a-cc"))).when(k == 7, "i-klingon").when(k == 8, "u").when(k == 9, "")
        .when(k == 10, F.concat(lang, F.lit("-GB-1996-x-"), F.col("source"))).otherwise(lang)
    )
    return table(spark, sf_dir, "documents").select("doc_id", tag.alias("tag")).withColumn("error", S.language_tag_error(F.col("tag")))


@query("""WITH t AS (SELECT doc_id, chr(9) || regexp_extract(text, '^[^\\n]*') || chr(7) || '  ' || chr(160) AS raw FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(raw, '[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x{84}\\x{86}-\\x{9f}\\x{fffe}\\x{ffff}]', '', 'g'),
 '[\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS title FROM t""")
def clean_titles(spark, sf_dir):
    """Titles without control characters, white space normalised."""
    raw = F.concat(F.lit("\t"), F.regexp_extract("text", "^[^\n]*", 0), F.lit("\x07  \xa0"))
    return table(spark, sf_dir, "documents").select("doc_id", S.clean_title(raw).alias("title"))


@query("""WITH b AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, 64)) AS i FROM embeddings),
c AS (SELECT u, x, cos((2 * x + 1) * u * pi() / 16) * sqrt((CASE WHEN u = 0 THEN 1.0 ELSE 2.0 END) / 8) AS w FROM range(0, 8) a(u), range(0, 8) b(x)),
r AS (SELECT vec_id, i // 8 AS y, u, sum(CAST(v AS DOUBLE) * w) AS s FROM b JOIN c ON c.x = i % 8 GROUP BY ALL)
SELECT vec_id, CAST(8 * c.u + r.u AS INT) AS term, round(sum(s * w), 4) + 0.0 AS value FROM r JOIN c ON c.x = r.y GROUP BY ALL""")
def dct_blocks(spark, sf_dir):
    """Each vector of 64 numbers as one block, transformed."""
    terms = blocks.cosine_terms(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return terms.select("vec_id", F.posexplode("terms").alias("term", "v")).select("vec_id", "term", (F.round("v", 4) + 0.0).alias("value"))


@query("""WITH s AS (SELECT lang AS table_id, unnest(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ',')) AS pair FROM documents)
SELECT table_id, CAST(('0x' || pair) AS INT) AS symbol, count(*) AS n FROM s WHERE pair <> '' GROUP BY ALL""")
def symbol_histogram(spark, sf_dir):
    """Byte frequencies by language."""
    return entropy.byte_histogram(table(spark, sf_dir, "documents").select(F.col("lang").alias("table_id"), "text"), "table_id", "text")


@query()
def huffman_lengths(spark, sf_dir):
    """An optimal code of at most 16 bits for each table; several codes are optimal, so SQL has their totals (code_totals)."""
    return entropy.huffman(symbol_histogram(spark, sf_dir), "table_id", "symbol")


@query("""WITH RECURSIVE s AS (SELECT lang AS table_id, unnest(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ',')) AS pair FROM documents),
c AS (SELECT table_id, pair, count(*) AS n FROM s WHERE pair <> '' GROUP BY ALL),
leaves AS (SELECT table_id, list_sort(list_append(list(CAST(n AS BIGINT)), 0)) AS leaf, count(*) AS symbols FROM c GROUP BY table_id),
merged AS (SELECT table_id, leaf, symbols, leaf AS level, 1 AS k FROM leaves
 UNION ALL SELECT table_id, leaf, symbols, list_sort(list_concat(leaf, list_transform(range(1, len(level) // 2 + 1), lambda i: level[2 * i - 1] + level[2 * i]))), k + 1 FROM merged WHERE k < 16)
SELECT table_id, symbols, CAST(list_sum(level[1:2 * symbols]) AS BIGINT) AS bits, true AS short, true AS free FROM merged WHERE k = 16""")
def code_totals(spark, sf_dir):
    """The bits that each table's code spends, against package-merge in SQL; a reserved symbol of frequency 0 keeps a code free."""
    counts = symbol_histogram(spark, sf_dir)
    return entropy.code_totals(counts, entropy.huffman(counts, "table_id", "symbol"), "table_id", "symbol")


@query("""WITH d AS (SELECT l_suppkey AS scan_id, l_linenumber AS comp, l_orderkey * 1000000 + l_partkey AS blk, CAST(l_partkey % 2048 - 1024 AS BIGINT) AS dc FROM lineitem),
x AS (SELECT *, dc - coalesce(lag(dc) OVER (PARTITION BY scan_id, comp ORDER BY blk), 0) AS diff FROM d)
SELECT *, CAST(CASE WHEN diff = 0 THEN 0 ELSE length(ltrim(bin(abs(diff)), '0')) END AS INT) AS category FROM x""")
def dc_differences(spark, sf_dir):
    """Differences of first terms along a scan."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scan_id"), F.col("l_linenumber").alias("comp"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("blk"), (F.col("l_partkey") % 2048 - 1024).cast("long").alias("dc"))
    return entropy.dc_differences(rows, ["scan_id", "comp"], "blk", "dc")


@query("""WITH t AS (SELECT vec_id, unnest(range(1, 65)) AS k, CAST(trunc(unnest(embedding) * 8) AS INT) AS v FROM embeddings), n AS (SELECT * FROM t WHERE v <> 0),
x AS (SELECT *, CAST(k - coalesce(lag(k) OVER (PARTITION BY vec_id ORDER BY k), 0) - 1 AS INT) AS run FROM n)
SELECT vec_id, CAST(k AS INT) AS k, v, run, CAST(length(ltrim(bin(abs(v)), '0')) AS INT) AS category FROM x""")
def zero_runs(spark, sf_dir):
    """Zeros before each non-zero term of a block."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "x")).select("vec_id", (F.col("p") + 1).alias("k"), (F.col("x") * 8).cast("int").alias("v"))
    return entropy.zero_runs(rows, ["vec_id"], "k", "v")


@query("""SELECT user_id AS job_id, max(event_id) AS seq, arg_max(event_type, event_id) AS state, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def job_latest_state(spark, sf_dir):
    """§2.18: the newest view of each job; a smaller sequence number never wins."""
    from quire.streaming import jobs

    return jobs.latest(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), "value"), ["state", "value"])


@query(r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, count(*) AS n FROM m GROUP BY ALL""")
def page_entities(spark, sf_dir):
    """References in page markup, with their counts."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return found.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, 400 + l_partkey % 3000 AS w, 300 + l_suppkey % 2500 AS h FROM lineitem),
f AS (SELECT *, least(2560.0 / CAST(w AS DOUBLE), 1366.0 / CAST(h AS DOUBLE)) AS s FROM (SELECT l_orderkey, l_linenumber, w, h FROM s))
SELECT l_orderkey, l_linenumber, CAST(greatest(1, least(2560, floor(w * s + 0.5))) AS BIGINT) AS fit_w, CAST(greatest(1, least(1366, floor(h * s + 0.5))) AS BIGINT) AS fit_h FROM f""")
def fit_sizes(spark, sf_dir):
    """M3: sizes fitted into a box."""
    w, h = S.fit(400 + F.col("l_partkey") % 3000, 300 + F.col("l_suppkey") % 2500, F.lit(2560), F.lit(1366))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.alias("fit_w"), h.alias("fit_h"))


@query("""SELECT o_orderkey, lpad(CAST(o_orderkey % 2000 + 1 AS VARCHAR), 4, '0') AS page_name, greatest(8, least(150, 25920 // greatest(1, o_custkey % 4000))) AS dpi,
 greatest(1, least(255, ((16 + o_orderkey % 90) * (CASE WHEN o_custkey % 100 + 1 < 50 THEN 5000 // (o_custkey % 100 + 1) ELSE 200 - 2 * (o_custkey % 100 + 1) END) + 50) // 100)) AS quant FROM orders""")
def page_scalars(spark, sf_dir):
    """Page names, cover resolution, scaled quantisation."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.page_name(k % 2000, F.lit(2000)).alias("page_name"), S.cover_dpi(c % 4000).alias("dpi"), S.quant_scale(16 + k % 90, c % 100 + 1).alias("quant"))


@query("""SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || ' KiB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0) || ' MiB' ELSE printf('%.1f', n / 1073741824.0) || ' GiB' END AS size
FROM (SELECT o_orderkey, o_orderkey * o_custkey % 7000000000 // (CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 10 END) AS n FROM orders)""")
def human_sizes(spark, sf_dir):
    """Byte counts for people."""
    k = F.col("o_orderkey")
    step = F.when(k % 4 == 0, 1).when(k % 4 == 1, 1000).when(k % 4 == 2, 1_000_000).otherwise(10)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.human_bytes(S.whole(k * F.col("o_custkey") % 7_000_000_000, step)).alias("size"))


@query("""SELECT event_id, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS box,
 last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS first, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS earlier FROM events""")
def window_idioms(spark, sf_dir):
    """Box mean, value carried forward, first of its group, an earlier sibling already has it."""
    over = W.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.avg("value").over(over.rowsBetween(-2, 2)).alias("box"),
        F.last(F.when(F.col("event_id") % 3 == 0, F.col("value")), ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, 0)).alias("carried"),
        (F.row_number().over(over) == 1).alias("first"), (F.count_if(F.col("event_type") == "click").over(over.rowsBetween(W.unboundedPreceding, -1)) > 0).alias("earlier"),
    )


@query("""WITH t AS (SELECT event_id, event_type, user_id, CASE event_id % 3 WHEN 0 THEN 'measuring' WHEN 1 THEN 'rendering' ELSE 'queued' END AS stage, event_id % 50 AS done, event_id % 7 * 10 AS total,
 '<' || event_type || ' a="' || CAST(user_id AS VARCHAR) || '">&' || chr(39) || props AS markup, event_type || '.' || (CASE event_id % 5 WHEN 0 THEN 'PNG' WHEN 1 THEN 'gif' WHEN 2 THEN 'webp' WHEN 3 THEN 'svg' ELSE 'jpg' END) AS name FROM events),
p AS (SELECT *, CASE WHEN total > 0 THEN CAST(done AS DOUBLE) / total ELSE 0.0 END AS part FROM t)
SELECT event_id, CASE stage WHEN 'measuring' THEN 0.1 * part WHEN 'rendering' THEN 0.1 + 0.9 * part ELSE 0.0 END AS progress,
 replace(replace(replace(replace(replace(markup, '&', '&amp;'), chr(39), '&#39;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;') AS escaped, event_type = 'click' AS clicked,
 'ERROR(RSC-' || lpad(CAST(user_id % 7 AS VARCHAR), 3, '0') || '): ' || CASE WHEN event_id % 4 > 0 THEN name || CASE WHEN event_id % 6 > 0 THEN '(' || CAST(event_id % 6 AS VARCHAR) || ',' || CAST(event_id % 3 AS VARCHAR) || ')' ELSE '' END || ': ' ELSE '' END || event_type AS line,
 CASE event_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'image/svg+xml' ELSE 'image/jpeg' END AS kind FROM p""")
def text_scalars(spark, sf_dir):
    """A job's progress, escaped markup, tokens, findings as lines, image types by name."""
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    stage = F.when(e % 3 == 0, "measuring").when(e % 3 == 1, "rendering").otherwise("queued")
    name = F.concat(kind, F.lit("."), F.element_at(F.array(*map(F.lit, ("PNG", "gif", "webp", "svg", "jpg"))), (e % 5 + 1).cast("int")))
    code = F.concat(F.lit("RSC-"), F.lpad((u % 7).cast("string"), 3, "0"))
    return table(spark, sf_dir, "events").select(
        "event_id", S.progress(stage, e % 50, e % 7 * 10).alias("progress"), S.xml_escaped(F.concat(F.lit("<"), kind, F.lit(' a="'), u.cast("string"), F.lit("\">&'"), "props")).alias("escaped"),
        S.has_token(F.concat(F.lit(" a  "), kind, F.lit(" b")), "click").alias("clicked"),
        S.finding_text(F.lit("ERROR"), code, F.when(e % 4 > 0, name).otherwise(""), (e % 6).cast("int"), (e % 3).cast("int"), kind).alias("line"), S.image_type(name).alias("kind"),
    )


@query("""SELECT s_suppkey AS image_id, (2 * i.x + 1) * (300 + s_suppkey) // 40 AS x, (2 * j.y + 1) * (200 + s_nationkey) // 40 AS y FROM supplier, range(0, 20) i(x), range(0, 20) j(y)""")
def grid_samples(spark, sf_dir):
    """The places at which an image's background is sampled."""
    images = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") + 300).alias("w"), (F.col("s_nationkey") + 200).cast("long").alias("h"))
    return colours.grid(images, "image_id", 20)


ORDER_MODEL = """
default namespace = "urn:order"
datatypes xsd = "http://www.w3.org/2001/XMLSchema-datatypes"
start = element order { attribute id { xsd:nonNegativeInteger }, attribute status { "O" | "F" }, element date { xsd:date }, total, element gift { empty }? }
total = element total { xsd:decimal { maxInclusive = "200000" } }
"""


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(15, 2)) > 200000 AS big, o_orderkey % 7 = 0 AS gift, o_orderkey % 11 = 0 AS undated, o_orderkey % 13 = 0 AS odd, o_orderkey % 17 = 0 AS extra FROM orders),
f AS (SELECT o_orderkey, unnest([CASE WHEN s NOT IN ('O', 'F') THEN 'value "' || s || '" of attribute "status" is not allowed' END, CASE WHEN s NOT IN ('O', 'F') THEN 'missing attributes: status' END, CASE WHEN odd THEN 'attribute "odd" is not allowed here' END,
 CASE WHEN undated THEN 'element "total" is not allowed here; expected "date"' END, CASE WHEN undated AND gift THEN 'element "gift" is not allowed here; expected "date"' END, CASE WHEN undated THEN 'element "order" is incomplete; expected "date"' END,
 CASE WHEN big AND NOT undated THEN 'text is not allowed here; nothing is expected' END, CASE WHEN big AND NOT undated THEN 'element "total" is incomplete; nothing is expected' END,
 CASE WHEN extra THEN 'element "extra" is not allowed here; ' || CASE WHEN undated THEN 'expected "date"' WHEN gift THEN 'nothing is expected' ELSE 'expected "gift"' END END]) AS detail FROM o)
SELECT CAST(o_orderkey AS VARCHAR) AS doc, 'RSC-005' AS code, detail FROM f WHERE detail IS NOT NULL""")
def content_models(spark, sf_dir):
    """Every order as a document, against a grammar that some of them break."""
    o, k, none = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.lit("")
    date = F.when(k % 11 != 0, F.concat(F.lit("<date>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</date>"))).otherwise(none)
    head = F.concat(F.lit('<order xmlns="urn:order" id="'), k.cast("string"), F.lit('" status="'), "o_orderstatus", F.when(k % 13 == 0, '" odd="1">').otherwise('">'))
    total = F.concat(F.lit("<total>"), F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.lit("</total>"))
    text = F.concat(head, date, total, F.when(k % 7 == 0, "<gift/>").otherwise(none), F.when(k % 17 == 0, "<extra><gift/></extra>").otherwise(none), F.lit("</order>"))
    docs = o.select(F.lit("orders").alias("package_id"), k.cast("string").alias("doc"), text.cast("binary").alias("content"))
    return relaxng.grammar_findings(docs, ORDER_MODEL).select(F.col("path").alias("doc"), "code", "detail")


def _books_of_customers(spark, sf_dir):
    """package_id, content: each customer's orders as the pages of a book."""
    sizes = spark.range(6).select((F.col("id") % 3 * 8 + 16).alias("w"), (F.col("id") % 2 * 8 + 16).alias("h"), F.col("id").alias("image_id"))
    pixels = F.transform(F.sequence(F.lit(1).cast("long"), F.col("w") * F.col("h")), lambda i: F.lpad(F.hex(i * 5 % 256), 2, "0"))
    images = encoder.jpegs(sizes.select("image_id", "w", "h", F.lit(1).alias("channels"), F.unhex(F.array_join(pixels, "")).alias("data")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("page_no"), (F.col("o_orderkey") % 3 * 8 + 16).alias("w"), (F.col("o_orderkey") % 2 * 8 + 16).alias("h"), (F.col("o_orderkey") % 6).alias("image_id"))
    c = F.col("c_custkey")
    known = table(spark, sf_dir, "customer").select(c.alias("book_id"), F.concat(F.lit("urn:book:"), c.cast("string")).alias("identifier"), F.concat("c_name", F.lit(" & more")).alias("title"), F.lit("en").alias("language"), F.expr("timestamp'2025-01-02 03:04:05'").alias("modified"), (c % 2 == 1).alias("rtl"))
    return books_written(known, orders.join(F.broadcast(images), "image_id"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, 16 + o_orderkey % 3 * 8 AS w, 16 + o_orderkey % 2 * 8 AS h FROM orders),
s AS (SELECT *, CASE WHEN w > h THEN 'landscape' WHEN h > w THEN 'portrait' ELSE 'auto' END AS shape FROM p)
SELECT CAST(c_custkey AS VARCHAR) AS package_id, 5 + 2 * count(*) AS entries, 1 + count(*) AS stored, count(*) AS refs, 2 + 2 * count(*) AS items, any_value(c_name) || ' & more' AS title,
 CASE WHEN count(DISTINCT shape) > 1 THEN count(*) ELSE 0 END AS turned, CASE WHEN count(DISTINCT shape) > 1 THEN 'auto' ELSE min(shape) END AS orientation,
 CAST(arg_min(w, o_orderkey) AS VARCHAR) || 'x' || CAST(arg_min(h, o_orderkey) AS VARCHAR) AS resolution, c_custkey % 2 = 1 AS rtl
FROM customer JOIN s ON o_custkey = c_custkey GROUP BY c_custkey""")
def written_books(spark, sf_dir):
    """Each customer's orders as the pages of a book, written and read back."""
    found = written(packages.entries(_books_of_customers(spark, sf_dir)), "books")
    opf = packages.elements(found.where("name = 'EPUB/package.opf'").select("package_id", F.col("name").alias("doc"), "content"))
    attr = lambda name: F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))
    meta = lambda key, name, value: F.max(F.when((F.col("local") == "meta") & (attr(key) == name), value))
    read = opf.groupBy("package_id").agg(
        F.count_if(F.col("local") == "itemref").alias("refs"), F.count_if(F.col("local") == "item").alias("items"), F.max(F.when(F.col("local") == "title", F.col("text"))).alias("title"), F.count_if((F.col("local") == "itemref") & attr("properties").startswith("rendition:orientation-")).alias("turned"),
        meta("property", "rendition:orientation", F.col("text")).alias("orientation"), meta("name", "original-resolution", attr("content")).alias("resolution"), F.max((F.col("local") == "spine") & (attr("page-progression-direction") == "rtl")).alias("rtl"),
    )
    counts = found.groupBy("package_id").agg(F.count("*").alias("entries"), F.count_if(F.col("method") == 0).alias("stored"))
    return counts.join(read, "package_id")


def _model_books(spark, sf_dir):
    """Books of written_books, as tables."""
    return package_rules.tables(_books_of_customers(spark, sf_dir))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, 16 + o_orderkey % 3 * 8 AS w, 16 + o_orderkey % 2 * 8 AS h FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT CAST(o_custkey AS VARCHAR) AS package_id, n - 1 AS page, 'EPUB/pages/' || lpad(CAST(n AS VARCHAR), 3, '0') || '.xhtml' AS doc, w, h, 'EPUB/images/' || lpad(CAST(n AS VARCHAR), 3, '0') || '.jpg' AS image, CAST(n AS VARCHAR) AS label FROM p""")
def book_previews(spark, sf_dir):
    """Pages of written books with their images, sizes and labels."""
    return preview.pages(_model_books(spark, sf_dir))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS package_id, CAST(n AS INT) AS place, 0 AS depth, CAST(n AS VARCHAR) AS title, n - 1 AS page
FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey)""")
def preview_contents(spark, sf_dir):
    """Contents entries of written books and the pages that they lead to."""
    return preview.contents(_model_books(spark, sf_dir))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey WHEN 1 THEN 0 WHEN 2 THEN 7 WHEN 3 THEN 0 ELSE o_custkey END AS w, CASE o_orderkey % 5 WHEN 0 THEN 20 WHEN 1 THEN o_custkey WHEN 2 THEN 9 WHEN 3 THEN 0 ELSE -5 END AS h FROM orders""")
def viewport_sizes(spark, sf_dir):
    """Sizes that viewports state, read leniently."""
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    content = F.when(k == 0, F.concat(F.lit("width="), c, F.lit(", height=20"))).when(k == 1, F.concat(F.lit(" height = "), c, F.lit(" ; width=wide"))).when(k == 2, "width=1,width=7;height=9,x=3").when(k == 3, "Width=4, height").otherwise(F.concat(F.lit("height=-5,, width=\t"), c))
    size = S.viewport_size(F.regexp_replace(content, "\t", " "))
    return table(spark, sf_dir, "orders").select("o_orderkey", size["w"].alias("w"), size["h"].alias("h"))


@query("""WITH l AS (SELECT source, doc_id, 'line ' || repeat(CAST(doc_id % 10 AS VARCHAR), CAST(150 + doc_id % 100 AS INT)) AS line FROM documents)
SELECT source, doc_id, CASE WHEN strlen(line) > 200 THEN line[1:200] || '...' ELSE line END AS line, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM l) WHERE place <= 5""")
def report_lines(spark, sf_dir):
    """The first lines of each report, cut at 200 bytes."""
    line = F.concat(F.lit("line "), F.expr("repeat(cast(doc_id % 10 as string), cast(150 + doc_id % 100 as int))"))
    return findings.first_lines(table(spark, sf_dir, "documents").select("source", "doc_id", line.alias("line")), "source", "doc_id", "line")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'the ' || event_type || ' of ' || CAST(user_id AS VARCHAR) || ', ' || event_type WHEN 1 THEN CAST(user_id AS VARCHAR) || ' before ' || event_type || ' and ' ELSE 'none' END AS line,
 event_type || '.v' || CAST(user_id AS VARCHAR) || '.epub' AS book FROM events""")
def message_texts(spark, sf_dir):
    """Messages filled in, file names of books."""
    k, u = F.col("event_id") % 3, F.col("user_id")
    template = F.when(k == 0, "the %1$s of %2$s, %1$s").when(k == 1, "%2$s before %1$s and %3$s").otherwise("none")
    name = F.concat("event_type", F.lit(".v"), u.cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "events").select("event_id", S.message(template, [F.col("event_type"), u]).alias("line"), S.book_file(name).alias("book"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(400 + l_partkey % 900 AS DOUBLE) AS w, CAST(300 + l_suppkey * 37 % 1200 AS DOUBLE) AS h FROM lineitem), k AS (SELECT *, least(1072.0::DOUBLE / w, 1448.0::DOUBLE / h) AS k FROM p),
f AS (SELECT *, CAST(floor(100 * (w * k) * (h * k) / (1072.0::DOUBLE * 1448) + 0.5) AS INT) AS fill FROM k) SELECT l_orderkey, l_linenumber, fill, fill < 70 AND w > h AS turn FROM f""")
def screen_fills(spark, sf_dir):
    """How much of an upright screen each page fills, and whether to turn it."""
    fill = S.screen_fill(400 + F.col("l_partkey") % 900, 300 + F.col("l_suppkey") * 37 % 1200, F.lit(1072), F.lit(1448))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fill["fill"].alias("fill"), fill["turn"].alias("turn"))


@query("""WITH o AS (SELECT l_orderkey, CASE WHEN l_partkey % 9 = 0 THEN 'text' ELSE 'image' END AS kind, CAST(60 + l_suppkey % 60 AS DOUBLE) AS area FROM lineitem WHERE l_linenumber <= 1 + l_orderkey % 3)
SELECT l_orderkey AS page_no, count(*) FILTER (kind = 'image') = 1 AND count(*) FILTER (kind = 'text') = 0 AND coalesce(sum(area) FILTER (kind = 'image'), 0) >= 0.9::DOUBLE * 100 AS scan FROM o GROUP BY l_orderkey""")
def scan_pages(spark, sf_dir):
    """pages that are one image."""
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 1 + l_orderkey % 3")
    objects = rows.select(F.col("l_orderkey").alias("page_no"), F.when(F.col("l_partkey") % 9 == 0, "text").otherwise("image").alias("kind"), (F.col("l_suppkey") % 60 + 60).cast("double").alias("area"), F.lit(100.0).alias("page_area"))
    return geometry.scanned(objects, ["page_no"])


@query("""SELECT state, count(*) AS n FROM (SELECT arg_max(event_type, event_id) AS state FROM events GROUP BY user_id) GROUP BY state""")
def job_state_counts(spark, sf_dir):
    """Jobs by their newest state."""
    from quire.streaming import jobs

    return jobs.state_counts(jobs.latest(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state")), ["state"]))


@query("""SELECT event_id, 'event: job' || chr(10) || 'data: {"id":' || CAST(user_id AS VARCHAR) || ',"state":"' || event_type || '","range":"1-' || CAST(event_id % 9 AS VARCHAR) || '"}' || chr(10) || chr(10) AS text,
 event_id % 3 = 0 OR event_id % 4 = 1 AS taken FROM events""")
def job_events_text(spark, sf_dir):
    """Views as server-sent events, uploads that are taken."""
    from quire.streaming import jobs

    e = F.col("event_id")
    view = F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("state"), F.concat(F.lit("1-"), (e % 9).cast("string")).alias("range"))
    name, kind = F.when(e % 3 == 0, "a.b.PDF").when(e % 3 == 1, "pdf").otherwise(None), F.when(e % 4 == 1, "application/pdf").when(e % 4 == 2, "text/plain")
    return table(spark, sf_dir, "events").select("event_id", jobs.event_text("job", view).alias("text"), S.is_document(name, kind).alias("taken"))
