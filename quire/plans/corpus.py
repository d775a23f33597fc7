"""Model packages, one for each condition of the validation rules, and what the rules must say of them.

A package is a template with named slots; a case fills some of them anew. `FAMILIES` holds, by group of rules,
the cases and their findings as (code, path, count). The registered queries give every customer one package of
each family, by customer number, so the findings of the whole table follow in SQL.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

OPF, A, B, CSS, ART, NAV, BOX = "EPUB/book.opf", "EPUB/pages/a.xhtml", "EPUB/pages/b.xhtml", "EPUB/style/base.css", "EPUB/art/one.png", "EPUB/contents.xhtml", "META-INF/container.xml"
_HTML = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head>{0}</head><body>{1}</body></html>'


def png(w: int, h: int) -> bytes:
    """A grey image."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(bytes(h * (w + 1)))) + part(b"IEND", b"")


#: What stands in each slot unless a case says otherwise.
SLOTS = {
    "mimetype": "application/epub+zip", "rootfile": '<rootfile full-path="EPUB/book.opf" media-type="application/oebps-package+xml"/>', "box_end": "</container>", "more_roots": "",
    "version": ' version="3.0" unique-identifier="key"', "prefix": "", "key": '<dc:identifier id="key">urn:quire:atlas</dc:identifier>', "title": "<dc:title>Atlas</dc:title>", "language": "<dc:language>fr</dc:language>",
    "modified": '<meta property="dcterms:modified">2025-05-05T05:05:05Z</meta>', "layout": '<meta property="rendition:layout">pre-paginated</meta>', "meta": "", "after": "", "opf_end": "</package>",
    "nav": ' properties="nav"', "css_item": '<item id="css" href="style/base.css" media-type="text/css"/>', "b_item": '<item id="b" href="pages/b.xhtml" media-type="application/xhtml+xml"{b_props}/>', "b_props": "",
    "art_item": '<item id="one" href="art/one.png" media-type="image/png"/>', "items": "", "spine": "", "refs": '<itemref idref="a"/><itemref idref="b"/>',
    "toc": '<nav epub:type="toc"><ol><li><a href="pages/a.xhtml">A</a></li></ol></nav>', "b_title": "<title>B</title>", "view": '<meta name="viewport" content="width=120, height=90"/>', "head": "", "body": "<p>b</p>", "css": "p { color: #123 }",
}


def parts(files: dict[str, bytes | None] | None = None, first: str | None = None, **slots: str) -> list[tuple[str, bytes]]:
    """Names and contents of a package's files; `files` adds, replaces or (None) leaves out, `first` goes before the others."""
    s = SLOTS | slots
    s["b_item"] = s["b_item"].format(**s)
    page = lambda title, view, head, body: _HTML.format(title + view + head, body).encode()
    out = {
        "mimetype": s["mimetype"].encode(),
        BOX: f'<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container" xmlns:rendition="http://www.idpf.org/2013/rendition"><rootfiles>{s["rootfile"]}{s["more_roots"]}</rootfiles>{s["box_end"]}'.encode(),
        OPF: f'''<package xmlns="http://www.idpf.org/2007/opf"{s["version"]}{s["prefix"]}><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{s["key"]}{s["title"]}{s["language"]}{s["modified"]}{s["layout"]}{s["meta"]}</metadata><manifest><item id="nav" href="contents.xhtml" media-type="application/xhtml+xml"{s["nav"]}/>{s["css_item"]}<item id="a" href="pages/a.xhtml" media-type="application/xhtml+xml"/>{s["b_item"]}{s["art_item"]}{s["items"]}</manifest><spine{s["spine"]}>{s["refs"]}</spine>{s["after"]}{s["opf_end"]}'''.encode(),
        NAV: page("<title>Contents</title>", "", "", s["toc"]), A: page("<title>A</title>", SLOTS["view"], '<link rel="stylesheet" href="../style/base.css"/>', '<img src="../art/one.png" alt=""/>'),
        B: page(s["b_title"], s["view"], s["head"], s["body"]), CSS: s["css"].encode(), ART: png(120, 90),
    }
    out = {k: v for k, v in (out | (files or {})).items() if v is not None}
    return sorted(out.items(), key=lambda x: x[0] != first) if first else list(out.items())


def bodies(*rows: tuple[str, list[tuple[str, int]]]) -> list[tuple[dict, list]]:
    return [({"body": body}, [(code, B, n) for code, n in found]) for body, found in rows]


_R = [("RSC-005", 1)]
FAMILIES: dict[str, list[tuple[dict, list[tuple[str, str, int]]]]] = {
    "container": [
        ({}, []), ({"archive": b"no archive"}, [("PKG-003", "", 1), ("PKG-008", "", 1)]), ({"first": BOX}, [("PKG-006", "", 1)]), ({"mimetype": "application/zip"}, [("PKG-007", "", 1)]), ({"extra": b"\x01\x02\x00\x00"}, [("PKG-005", "", 1)]),
        ({"files": {"EPUB/a?.txt": b"", "EPUB/<b>": b""}}, [("PKG-009", "", 2)]), ({"files": {"EPUB/end.": b""}}, [("PKG-011", "", 1)]), ({"files": {"EPUB/two words": b""}}, [("PKG-010", "", 1)]), ({"files": {"EPUB/été": b""}}, [("PKG-012", "", 1)]),
        ({"files": {BOX: None}}, [("RSC-002", "", 1)]), ({"box_end": ""}, [("RSC-016", BOX, 1)]), ({"rootfile": '<rootfile full-path="x" media-type="text/plain"/>'}, [("RSC-003", BOX, 1)]),
        ({"rootfile": '<rootfile full-path="EPUB/none.opf" media-type="application/oebps-package+xml"/>'}, [("OPF-002", BOX, 1)]),
        ({"more_roots": SLOTS["rootfile"]}, [("RSC-017", BOX, 1), ("RSC-019", "", 1)]),
        ({"more_roots": SLOTS["rootfile"].replace("/>", ' rendition:layout="reflowable"/>'), "files": {"META-INF/metadata.xml": b"<m/>"}}, []),
    ],
    "metadata": [
        ({}, []), ({"opf_end": ""}, [("RSC-016", OPF, 1)]), ({"title": ""}, [("RSC-005", OPF, 1)]), ({"title": "<dc:title> </dc:title>"}, [("RSC-005", OPF, 1)]), ({"key": ""}, [("RSC-005", OPF, 1), ("OPF-030", OPF, 1)]),
        ({"version": ' version="3.0" unique-identifier="other"'}, [("OPF-030", OPF, 1), ("RSC-005", OPF, 1)]), ({"language": "<dc:language>fr_FR</dc:language>"}, [("OPF-092", OPF, 1)]),
        ({"modified": '<meta property="dcterms:modified">2025-05-05</meta>'}, [("RSC-005", OPF, 1)]), ({"modified": ""}, [("RSC-005", OPF, 1)]), ({"modified": SLOTS["modified"] * 2}, [("RSC-005", OPF, 1)]),
        ({"meta": '<meta property="house:size">1</meta>'}, [("OPF-028", OPF, 1)]), ({"meta": '<meta property="house:size">1</meta>', "prefix": ' prefix="house: http://q/"'}, []),
        ({"prefix": f' prefix="{" ".join(f"k{i}: http://q/{i}" for i in range(40))}"', "meta": '<meta property="k39:size">1</meta>'}, []),
        ({"prefix": f' prefix="{" ".join(f"k{i}: http://q/{i}" for i in range(40))} dc: http://purl.org/dc/elements/1.1/"'}, [("OPF-007c", OPF, 1)]), ({"layout": '<meta property="rendition:layout">scrolled</meta>'}, [("RSC-005", OPF, 1)]), ({"layout": SLOTS["layout"] * 2}, [("RSC-005", OPF, 1)]),
        ({"meta": '<meta property="rendition:spread">odd</meta><meta property="rendition:orientation">up</meta>'}, [("RSC-005", OPF, 2)]), ({"after": "<bindings/>"}, [("RSC-017", OPF, 1)]),
        ({"meta": '<meta property="dcterms:extent" datatype="xsd:int">3</meta>'}, [("OPF-086c", OPF, 1)]),
    ],
    "manifest": [
        ({}, []), ({"files": {ART: None}}, [("RSC-001", ART, 1)]), ({"items": '<item id="css2" href="style/base.css" media-type="text/css"/>'}, [("OPF-074", OPF, 1)]), ({"items": '<item id="css" href="style/base.css" media-type="text/css"/>'}, [("RSC-005", OPF, 1), ("OPF-074", OPF, 1)]),
        ({"b_props": ' properties="shiny svg"'}, [("OPF-027", OPF, 1)]), ({"nav": ""}, [("RSC-005", OPF, 1)]), ({"b_props": ' properties="nav"'}, [("RSC-005", OPF, 1)]), ({"b_props": ' properties="cover-image"'}, [("OPF-012", OPF, 1)]),
        ({"art_item": '<item id="one" href="art/one.png" media-type="image/png" properties="cover-image"/><item id="two" href="art/two.png" media-type="image/png" properties="cover-image"/>', "files": {"EPUB/art/two.png": png(4, 4)}}, [("RSC-005", OPF, 1)]),
        ({"refs": '<itemref idref="a"/><itemref idref="gone"/>'}, [("OPF-049", OPF, 1), ("RSC-005", OPF, 1)]), ({"refs": '<itemref idref="a"/><itemref idref="b"/><itemref idref="a"/>'}, [("RSC-005", OPF, 1)]), ({"refs": ""}, [("RSC-005", OPF, 1)]),
        ({"spine": ' page-progression-direction="down"'}, [("RSC-005", OPF, 1)]), ({"spine": ' page-progression-direction="rtl"'}, []), ({"refs": '<itemref idref="a"/><itemref idref="one"/>'}, [("OPF-043", OPF, 1)]),
        ({"refs": '<itemref idref="a"/><itemref idref="one"/>', "art_item": '<item id="one" href="art/one.png" media-type="image/png" fallback="b"/>'}, []),
        ({"refs": '<itemref idref="x0"/>', "items": "".join(f'<item id="x{i}" href="x{i}" media-type="a/b" fallback="{f"x{i + 1}" if i < 31 else "b"}"/>' for i in range(32)), "files": {f"EPUB/x{i}": b"" for i in range(32)}}, []),
        ({"refs": '<itemref idref="x0"/>', "items": "".join(f'<item id="x{i}" href="x{i}" media-type="a/b" fallback="{f"x{i + 1}" if i < 32 else "b"}"/>' for i in range(33)), "files": {f"EPUB/x{i}": b"" for i in range(33)}}, [("OPF-043", OPF, 1)]),
    ],
    "content": [
        ({}, []), ({"body": "<p>"}, [("RSC-016", B, 1)]), ({"b_title": ""}, [("RSC-017", B, 1)]), ({"toc": '<nav epub:type="landmarks"/>'}, [("RSC-005", NAV, 1)]), ({"body": '<epub:switch id="s"/>', "b_props": ' properties="switch"'}, [("RSC-017", B, 1)]),
        *bodies(("<form/>", [("OPF-014", 1)]), ('<svg xmlns="http://www.w3.org/2000/svg"/><math xmlns="http://www.w3.org/1998/Math/MathML"/>', [("OPF-014", 2)]), ('<script type="text/plain">x</script>', []), ('<p onclick="x">y</p>', [("OPF-014", 1)])),
        ({"b_props": ' properties="scripted svg"'}, [("OPF-015", B, 2)]),
        *bodies(('<a href="un deux">x</a>', [("RSC-020", 1)]), ('<a href="/EPUB/pages/a.xhtml">x</a>', [("RSC-026", 1)]), ('<img src="none.png" alt=""/>', [("RSC-007", 1)]), ('<a href="../contents.xhtml#t">x</a>', [("RSC-011", 1)]), ('<a href="a.xhtml">x</a><a href="http://q/">y</a><a href="#z">z</a>', [])),
        ({"body": '<img src="../art/spare.png" alt=""/><img src="../art/spare.png" alt=""/>', "files": {"EPUB/art/spare.png": png(1, 1)}}, [("RSC-008", B, 2)]),
        ({"view": ""}, [("HTM-046", B, 1)]), ({"view": '<meta name="viewport" content="width, height=90"/>'}, [("HTM-047", B, 1)]), ({"view": '<meta name="viewport" content="height=90"/>'}, [("HTM_056", B, 1)]), ({"view": '<meta name="viewport" content="width=1, width=2, height=x"/>'}, [("HTM_059", B, 1), ("HTM_057", B, 1)]),
        ({"view": '<meta name="viewport" content="width=device-width, height=device-height"/>'}, []), ({"view": "", "layout": ""}, []),
    ],
    "elements": [
        ({}, []), ({"b_title": "<title> </title>"}, [("RSC-005", B, 1)]), ({"head": '<link rel="next" href="a.xhtml" sizes="8x8"/>'}, [("RSC-005", B, 1)]), ({"head": '<meta charset="utf-8"/><meta charset="utf-8"/>'}, [("RSC-005", B, 1)]),
        ({"head": '<meta http-equiv="Content-Type" content="text/html; charset=latin-1"/>'}, [("RSC-005", B, 1)]), ({"head": '<meta http-equiv="content-type" content="text/html;  charset=UTF-8"/><meta charset="utf-8"/>'}, [("RSC-005", B, 1)]),
        *bodies(
            ('<area alt="x"/>', _R), ('<map name="m"><area alt="x"/></map>', []), ('<img ismap="" src="x" alt=""/>', _R), ('<a href="x"><img ismap="" src="x" alt=""/></a>', []), ("<bdo>x</bdo>", _R),
            ('<label for="k">x</label>', _R), ('<label for="k">x</label><meter id="k"/>', []), ('<label for="k">x</label><input id="k" type="hidden"/>', _R), ('<output for="k l">x</output><i id="k">y</i>', _R),
            ('<input list="k"/><i id="k">x</i>', _R), ('<map name="m"/><map name="m"/>', [("RSC-005", 2)]), ('<map id="k" name="m"/>', _R),
            ('<select><option selected="">x</option><optgroup><option selected="">y</option></optgroup></select>', _R), ('<select multiple=""><option selected="">x</option><option selected="">y</option></select>', []),
            ('<video><track label=" " src="x"/></video>', _R), ('<video><track default="" src="x"/><track default="" src="y"/></video>', _R), ('<script src="x" type="text/plain"/>', _R), ('<script src="x" type="module"/>', []),
            ('<a itemprop="k">x</a>', _R), ("<dfn>x<b><dfn>y</dfn></b></dfn>", _R), ("<header><p><footer>x</footer></p></header>", _R), ('<a href="x"><button>y</button></a>', _R), ("<button><label>x</label></button>", _R), ('<b form="k">x</b>', _R),
            ('<p lang="fr" xml:lang="de">x</p>', _R), ('<p lang="FR" xml:lang="fr">x</p>', []), ('<p role="doc-endnote note">x</p>', [("RSC-017", 1)]), ('<p role="doc-pagefooter" aria-label="k">x</p>', _R),
            ('<p aria-describedby="k l" aria-owns="m">x</p><i id="k">y</i>', [("RSC-005", 2)]), ('<p aria-activedescendant="k"><i id="l">x</i></p><i id="k">y</i>', _R), ('<p aria-activedescendant="k"><b><i id="k">x</i></b></p>', []),
            ('<i id="k">x</i><i id="k">y</i><i id="k">z</i>', [("RSC-005", 3)]), ('<table><tr><th id="k">x</th><td headers="k l">y</td></tr></table><table><tr><th id="l">x</th></tr></table>', _R), ('<table><tr><th id="k">x</th><td headers="k">y</td></tr></table>', []),
            ('<math xmlns="http://www.w3.org/1998/Math/MathML"><mi xref="k">x</mi><mo indenttarget="l">y</mo></math>', [("RSC-005", 2)]),
            ('<epub:trigger xmlns:ev="http://www.w3.org/2001/xml-events" ev:observer="k" ref="l"/>', [("RSC-005", 2)]), ('<p xmlns:s="http://www.w3.org/2001/10/synthesis" s:ph="x"><b><i s:ph="y">z</i></b></p>', _R),
        ),
    ],
    "resources": [
        ({}, []), ({"css": "p { color: red"}, [("CSS-008", CSS, 1)]), ({"css": "p } /* { */"}, [("CSS-008", CSS, 1)]), ({"css": "/* } */ p { content: '}' }"}, []), ({"files": {ART: b"GIF89a" + bytes(7)}}, [("OPF-029", ART, 1), ("PKG-022", ART, 1)]),
        ({"files": {ART: b"plain"}}, [("OPF-029", ART, 1), ("PKG-021", ART, 1)]), ({"files": {ART: png(2, 2)[:30]}}, [("PKG-021", ART, 1)]), ({"files": {ART: png(0, 2)}}, [("PKG-021", ART, 1)]),
        ({"art_item": '<item id="one" href="art/one.gif" media-type="image/png"/>', "files": {"EPUB/art/one.gif": png(2, 2)}}, [("PKG-022", "EPUB/art/one.gif", 1)]),
    ],
    "own": [
        ({}, []), ({"deflated": "mimetype"}, [("LB-001", "", 1)]), ({"layout": '<meta property="rendition:layout"> pre-paginated</meta>'}, [("LB-003", OPF, 1)]), ({"title": "<dc:title> Atlas </dc:title>"}, []), ({"files": {"EPUB/spare.txt": b"", "EPUB/art/spare.png": b""}}, [("LB-004", "EPUB/spare.txt", 1), ("LB-004", "EPUB/art/spare.png", 1)]),
    ],
}


@lru_cache(maxsize=1024)
def package(family: str, i: int) -> bytes:
    """The archive of a case."""
    from quire.sources.packages import archive

    case = dict(FAMILIES[family][i][0])
    if "archive" in case:
        return case["archive"]
    extra, deflated = case.pop("extra", b""), case.pop("deflated", None)
    return archive([(n, d, 0 if n == "mimetype" and n != deflated else 8) for n, d in parts(**case)], {"mimetype": extra})


def expected(family: str) -> str:
    """SQL rows (k, code, path, n) of a family's findings."""
    rows = [(k, code, path, n) for k, (_, found) in enumerate(FAMILIES[family]) for code, path, n in found]
    return ", ".join(f"({k}, '{code}', '{path}', {n})" for k, code, path, n in rows)
