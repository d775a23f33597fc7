"""Packages as tables, the order of findings, archives written back, and pages against their images.

The rules themselves are held against their conditions by the registered queries (test_queries).
"""

import struct

import pyarrow as pa

from quire import session
from quire.operators import links
from quire.plans import corpus, package_rules, validation
from quire.sources import packages as P


def frame(spark, cases):
    return spark.createDataFrame([(n, bytearray(d)) for n, d in cases.items()], "package_id string, content binary")


def zipped(methods=None, **case):
    return P.archive([(n, d, (methods or {}).get(n, 0 if n == "mimetype" else 8)) for n, d in corpus.parts(**case)])


def test_every_family_begins_with_a_package_without_findings():
    assert all(found == [] and case == {} for (case, found), *_ in corpus.FAMILIES.values())
    assert {code for rows in corpus.FAMILIES.values() for _, found in rows for code, _, _ in found} | {"LB-002", *(f"LB-01{i}" for i in range(6)), "OPF-092"} >= {c for codes in package_rules.CODES.values() for c in codes}


def test_findings_are_in_order_with_severities(spark):
    several = zipped(opf_end="", body="<p>", css="}")
    odd = zipped(title="", language="", modified="", spine=' page-progression-direction="down"')
    rows = package_rules.check(frame(spark, {"several": several, "odd": odd, "good": zipped(), "none": b""})).collect()
    by = {n: sorted((r for r in rows if r.package_id == n), key=lambda r: r.place) for n in ("several", "odd", "good", "none")}
    assert not by["good"] and {r.code for r in by["none"]} == {"PKG-003", "PKG-008"} and [r.code for r in by["several"]] == ["RSC-016"] and len(by["odd"]) == 4
    for found in by.values():
        assert [(r.path, r.line, r.col) for r in found] == sorted((r.path, r.line, r.col) for r in found)
    assert [r.detail for r in by["odd"]] == ["title missing", "language missing", "modified must occur once", "direction"]  # on one line: as the rules stand
    assert {r.severity_name for r in rows if r.code in ("RSC-016", "PKG-008")} == {"FATAL"}


def test_content_models_by_media_type(spark):
    model = 'default namespace = "http://www.w3.org/1999/xhtml"\nstart = element html { element head { any }, element body { element p { text }* } }\nany = (attribute * { text } | text | element * { any })*'
    rows = package_rules.check(frame(spark, {"a": zipped(), "b": zipped(body="<ul/>")}), {"application/xhtml+xml": model}).collect()
    assert {(r.package_id, r.code, r.path) for r in rows} == {(p, "RSC-005", d) for p, d in (("a", corpus.NAV), ("a", corpus.A), ("b", corpus.NAV), ("b", corpus.A), ("b", corpus.B))}


def test_elements_know_what_is_above_them():
    rows = P.elements_of(b"<a><b><c/>x</b><d>y</d></a>")
    assert [(r[6], r[4], r[8]) for r in rows] == [("a", [], "xy"), ("b", [0], "x"), ("c", [0, 1], ""), ("d", [0], "y")]
    assert all((i in r[4]) == (rows[i][0] < r[0] and rows[i][1] > r[1]) for r in rows for i in range(len(rows)))
    assert P.elements_of(b"<a>")[0][0] == -1


def test_archives_are_written_back(spark):
    packages = frame(spark, {"a": zipped({"mimetype": 8}, files={"EPUB/spare.txt": b"x"})})
    again = P.packed(P.entries(packages)).first()
    rows = list(P.entries_of(bytes(again.content)))
    assert rows[0][1] == "mimetype" and rows[0][2] == 0 and struct.unpack_from("<H", again.content, 28)[0] == 0
    assert {r[1]: r[7] for r in rows} == dict(corpus.parts(files={"EPUB/spare.txt": b"x"}))


def jpeg(w, h, channels=1, cut=0):
    """A sequential image of equal blocks, each two bits; without the last cut bytes of its scan."""
    table = lambda kind: b"\xff\xc4\x00\x14" + bytes([kind, 1, *[0] * 15, 0])
    frame = struct.pack(">BHHB", 8, h, w, channels) + b"".join(bytes([i, 0x11, 0]) for i in range(channels))
    scan = bytes([channels]) + b"".join(bytes([i, 0]) for i in range(channels)) + b"\x00\x3f\x00"
    data = bytes(-(-(-(-w // 8) * -(-h // 8) * channels) // 4))
    segment = lambda m, d: bytes([255, m]) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + segment(0xC0, frame) + table(0) + table(16) + segment(0xDA, scan) + data[: len(data) - cut] + b"\xff\xd9"


B_IMAGE = "EPUB/art/b.jpg"


def pictured(image=None, size="120x90", **case):
    """Two pages, each with one image."""
    items = '<item id="ib" href="art/b.jpg" media-type="image/jpeg"/>'
    files = {"EPUB/pages/a.xhtml": corpus.parts(body='<img src="../art/b.jpg" alt=""/>')[5][1], B_IMAGE: image or jpeg(120, 90)}
    return zipped(**{"items": items, "files": files, "body": '<img src="../art/b.jpg" alt=""/>', "meta": f'<meta name="original-resolution" content="{size}"/>'} | case)


HEADER = b"\xff\xd8\xff\xe0\x00\x04JF\xff\xd9"
STRICT = {
    "valid": (pictured(), set()),
    "spine": (pictured(refs='<itemref idref="b"/>'), {("LB-010", corpus.OPF)}),
    "resolution": (pictured(size="120x91"), {("LB-011", corpus.OPF)}),
    "viewport": (pictured(view='<meta name="viewport" content="width=121, height=90"/>', refs='<itemref idref="b"/><itemref idref="b"/>', image=jpeg(121, 90)), {("LB-012", corpus.B)}),
    "size": (pictured(jpeg(120, 88)), {("LB-013", B_IMAGE)}),
    "colour": (pictured(jpeg(120, 90, 3)), {("LB-014", B_IMAGE)}),
    "header-only": (pictured(HEADER), {("LB-015", B_IMAGE)}),
    "cut-short": (pictured(jpeg(120, 90, cut=1)), {("LB-015", B_IMAGE)}),
    "unnamed": (pictured(jpeg(120, 80, 3), size="1x1"), {("LB-013", B_IMAGE)}),
}


def test_strict_page_rules(spark):
    expected = spark.createDataFrame([(n, 2, 120, 90, True) for n in STRICT if n != "unnamed"], "package_id string, pages int, canvas_w int, canvas_h int, grayscale boolean")
    got = {n: set() for n in STRICT}
    for r in package_rules.strict(frame(spark, {n: d for n, (d, _) in STRICT.items()}), expected).collect():
        if r.code != "LB-004":  # the first page's picture is not what this looks at
            got[r.package_id].add((r.code, r.path))
    assert got == {n: want for n, (_, want) in STRICT.items()}


#: The families of rules that join by shuffle only.
SHUFFLED = ("content", "elements", "manifest", "metadata", "own", "resources")


def test_no_rule_broadcasts_a_table(spark, monkeypatch):
    plans = []

    def noted(df, name, *more):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return session.written(df, name, *more)

    monkeypatch.setattr(package_rules, "written", noted)
    monkeypatch.setattr(links, "written", noted)
    t = package_rules.tables(frame(spark, {"good": zipped(), "odd": zipped(title="", body="<p>")}))
    for family in SHUFFLED:
        found = package_rules.reported(validation.RULES[family](t))
        plans.append((family, found._jdf.queryExecution().executedPlan().toString()))
    assert [name for name, plan in plans if "Broadcast" in plan] == [] and sum("SortMergeJoin" in plan for _, plan in plans) >= 6


def test_small_documents_share_a_batch():
    groups = [([(str(i), k) for k in range(3)], 10) for i in range(1000)]
    got = list(P.batched(iter(groups), ["a", "b"], [pa.string(), pa.int32()]))
    assert [len(b) for b in got] == [2049, 951] and [r for b in got for r in zip(*(c.to_pylist() for c in b.columns))] == [r for g, _ in groups for r in g]
    assert [len(b) for b in P.batched(iter([([("x", 1)], 1 << 20), ([], 0), ([("y", 2)], 5)]), ["a", "b"], [pa.string(), pa.int32()])] == [1, 1] and not list(P.batched(iter([([], 0)]), ["a"], [pa.string()]))
