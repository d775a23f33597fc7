"""Validation of packages as DataFrame rules: every rule is a frame of findings, and all are put together and ordered.

`check` takes packages(package_id, content) and returns findings(package_id, code, severity, severity_name, path,
line, col, detail, place). Archives and XML are opened by Python once per document and kept in the tables of
Tables; rules are joins, anti-joins and aggregates over them. Where two manifest items claim one path, the
last in document order owns it. Content models are checked where their grammars are given.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.paths import css_errors, resolved, url_errors
from quire.functions.scalars import language_tag_error, normal_space, sniffed_type
from quire.operators.findings import SEVERITIES, ordered
from quire.operators.jpegs import image_header, jpeg_of
from quire.operators.links import fallback_end, reference_status
from quire.operators.relaxng import grammar_findings
from quire.session import shuffled, written
from quire.sources import packages as P

#: Codes by severity.
CODES = {
    "FATAL": ("PKG-008", "RSC-002", "RSC-016", "OPF-002"),
    "WARNING": ("PKG-010", "PKG-022", "RSC-017", "RSC-019", "OPF-086c"),
    "USAGE": ("PKG-012",),
    "ERROR": (
        "PKG-003", "PKG-005", "PKG-006", "PKG-007", "PKG-009", "PKG-011", "PKG-021", "RSC-001", "RSC-003", "RSC-005", "RSC-007", "RSC-008", "RSC-011", "RSC-020", "RSC-026",
        "OPF-007c", "OPF-012", "OPF-014", "OPF-015", "OPF-027", "OPF-028", "OPF-029", "OPF-030", "OPF-043", "OPF-049", "OPF-074", "OPF-092",
        "HTM-046", "HTM-047", "HTM_056", "HTM_057", "HTM_059", "CSS-008", "LB-001", "LB-002", "LB-003", "LB-004",
        "LB-010", "LB-011", "LB-012", "LB-013", "LB-014", "LB-015",
    ),
}
#: Namespaces, vocabularies, media types, and where references stand.
DC, OPS, XHTML, SVG, MATHML = "http://purl.org/dc/elements/1.1/", "http://www.idpf.org/2007/ops", "http://www.w3.org/1999/xhtml", "http://www.w3.org/2000/svg", "http://www.w3.org/1998/Math/MathML"
RENDITION, XML = "http://www.idpf.org/2013/rendition", "http://www.w3.org/XML/1998/namespace"
EVENTS, SSML = "http://www.w3.org/2001/xml-events", "http://www.w3.org/2001/10/synthesis"
PREFIXES = ("a11y", "dcterms", "marc", "media", "onix", "rendition", "schema", "xsd")
PROPERTIES = ("cover-image", "mathml", "nav", "remote-resources", "scripted", "svg", "switch", "data-nav", "dictionary", "glossary", "index", "search-key-map")
VALUES = {"rendition:layout": ("reflowable", "pre-paginated"), "rendition:orientation": ("landscape", "portrait", "auto"), "rendition:spread": ("none", "landscape", "portrait", "both", "auto")}
CONTENT = ("application/xhtml+xml", "image/svg+xml")
REFERENCES = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "audio": "src", "video": "src poster", "source": "src", "track": "src", "iframe": "src", "embed": "src", "object": "data"}
EXTENSIONS = {"image/jpeg": (".jpg", ".jpeg", ".jpe"), "image/png": (".png",), "image/gif": (".gif",), "image/webp": (".webp",), "image/svg+xml": (".svg",)}
INSIDE = {
    "audio": ("audio", "video"), "video": ("video", "audio"), "address": ("address",), "header": ("address", "header", "footer"), "footer": ("address", "header", "footer"),
    "form": ("form",), "progress": ("progress",), "meter": ("meter",), "dfn": ("dfn",), "table": ("caption",), "label": ("label",),
}
DOC = ["package_id", "doc"]


def attr(name: str) -> Column:
    """An attribute, null if absent."""
    return F.try_element_at("attrs", F.lit(name))


def filled(name: str) -> Column:
    return F.coalesce(attr(name), F.lit(""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normal_space(F.coalesce(c, F.lit(""))), " "), lambda x: x != "")


def found(rows: DataFrame, code: str | Column, path: Column | str | None = None, detail: Column | str = "", line: bool = True) -> DataFrame:
    """rows as findings: at their own line and column unless line is false."""
    where = F.lit("") if path is None else F.col(path) if isinstance(path, str) else path
    at = [F.col(c) if line else F.lit(0) for c in ("line", "col")]
    return rows.select("package_id", (F.lit(code) if isinstance(code, str) else code).alias("code"), where.alias("path"), at[0].cast("int").alias("line"), at[1].cast("int").alias("col"), (F.lit(detail) if isinstance(detail, str) else detail.cast("string")).alias("detail"))


def children(elements: DataFrame, parents: DataFrame, local: str | None = None, ns: str | None = None) -> DataFrame:
    """Elements whose parent is among parents, of that name."""
    keys = parents.select(*DOC, F.col("pre").alias("parent")).distinct()
    out = elements.join(shuffled(keys), [*DOC, "parent"])
    out = out.where(F.col("local") == local) if local else out
    return out.where(F.col("ns") == ns) if ns else out


def beneath(elements: DataFrame, name: str = "a_pre") -> DataFrame:
    """elements, a row for each element above one: its pre under that name."""
    return elements.withColumn(name, F.explode("above"))


def within(elements: DataFrame, ancestors: DataFrame, how: str = "left_semi") -> DataFrame:
    """Elements that have (left_semi) or lack (left_anti) one of ancestors above them."""
    met = beneath(elements.select(*DOC, "pre", "above")).join(shuffled(ancestors.select(*DOC, F.col("pre").alias("a_pre"))), [*DOC, "a_pre"], "left_semi")
    return elements.join(shuffled(met.select(*DOC, "pre").distinct()), [*DOC, "pre"], how)


@dataclass
class Tables:
    packages: DataFrame
    entries: DataFrame
    files: DataFrame
    container: DataFrame
    rootfiles: DataFrame
    opf: DataFrame  # elements of package documents
    items: DataFrame
    owners: DataFrame  # package_id, path: the item that declares it
    spine: DataFrame
    html: DataFrame  # elements of content documents
    fixed: DataFrame  # package_id, doc: documents with a fixed layout


def tables(packages: DataFrame) -> Tables:
    packages = packages.select("package_id", "content")
    entries = written(P.entries(packages), "entries")
    files = written(P.files(entries), "files")
    doc = lambda keys: files.join(shuffled(keys), (files["package_id"] == keys["k_package"]) & (files["name"] == keys["doc"])).select("package_id", "doc", "content")
    container = written(P.elements(files.where("name = 'META-INF/container.xml'").select("package_id", F.col("name").alias("doc"), "content")), "container")
    roots = container.where("local = 'rootfile'").where(filled("media-type") == "application/oebps-package+xml")
    rootfiles = roots.select("package_id", filled("full-path").alias("path"), "pre", "line", "col", "attrs", "doc")
    opf = written(P.elements(doc(rootfiles.select(F.col("package_id").alias("k_package"), F.col("path").alias("doc")).distinct())), "opf")
    with_meta = opf.join(shuffled(children(opf, opf.where("depth = 0"), "metadata").select(*DOC).distinct()), DOC, "left_semi")
    manifest = children(with_meta, with_meta.where("depth = 0"), "manifest")
    item = children(with_meta, manifest, "item")
    items = written(item.select(*DOC, F.col("pre").alias("ord"), "line", "col", "parent", filled("id").alias("id"), filled("media-type").alias("media_type"), filled("fallback").alias("fallback"), tokens(attr("properties")).alias("props"), F.coalesce(resolved("doc", attr("href")), F.lit("")).alias("path")), "items")
    latest = items.groupBy(*DOC, "id").agg(F.max_by(F.struct("ord", "media_type", "fallback", "props", "path"), "ord").alias("i")).select(*DOC, "id", "i.*")
    owners = written(latest.groupBy("package_id", "path").agg(F.max_by(F.struct("media_type", "props", "ord"), "ord").alias("i")).select("package_id", "path", "i.*"), "owners")
    refs = children(with_meta, children(with_meta, with_meta.where("depth = 0"), "spine"), "itemref").select(*DOC, F.col("pre").alias("at"), "line", "col", filled("idref").alias("idref"), tokens(attr("properties")).alias("over"))
    ends = fallback_end(latest.select(F.concat_ws("\0", *DOC).alias("package"), "id", "media_type", "fallback"), list(CONTENT)).select(F.col("package").alias("e_key"), F.col("id").alias("e_id"), "end")
    spine = refs.join(shuffled(latest.select(*DOC, F.col("id").alias("idref"), "ord", "media_type", "path")), [*DOC, "idref"], "left").withColumn("key", F.concat_ws("\0", *DOC))
    spine = written(spine.join(shuffled(ends), (F.col("key") == F.col("e_key")) & (F.col("idref") == F.col("e_id")), "left").drop("key", "e_key", "e_id"), "spine")
    keys = owners.where("media_type = 'application/xhtml+xml'").select(F.col("package_id").alias("k_package"), F.col("path").alias("doc"))
    html = written(P.elements(doc(keys)), "html")
    meta = children(with_meta, children(with_meta, with_meta.where("depth = 0"), "metadata"), "meta")
    layout = meta.where((attr("property") == "rendition:layout") & (filled("refines") == "") & (F.trim("text") == "pre-paginated")).select(*DOC).distinct().withColumn("whole", F.lit(True))
    placed = spine.where("path is not null").join(shuffled(layout), DOC, "left")
    last = F.element_at(F.filter("over", lambda x: x.isin("rendition:layout-pre-paginated", "rendition:layout-reflowable")), -1)
    last = F.when(F.exists("over", lambda x: x.isin("rendition:layout-pre-paginated", "rendition:layout-reflowable")), last == "rendition:layout-pre-paginated")
    laid = placed.where(F.col("end").isNotNull() & F.coalesce(last, F.col("whole"), F.lit(False)))
    fixed = written(laid.select(*DOC, F.col("end").alias("id")).join(shuffled(latest.select(*DOC, "id", F.col("path").alias("p"))), [*DOC, "id"]).select("package_id", F.col("p").alias("doc")).distinct(), "fixed")
    return Tables(packages, entries, files, container, rootfiles, opf, items, owners, spine, html, fixed)


def container_rules(t: Tables) -> list[DataFrame]:
    bad, good = t.entries.where("ord is null"), t.packages.join(t.entries.where("ord is null"), "package_id", "left_anti")
    first = t.entries.where("ord = 0 and name = 'mimetype'")
    content = t.files.where("name = 'mimetype'").where(F.coalesce(F.col("content").cast("string") != "application/epub+zip", F.lit(True)))
    forbidden = "[\\x00-\\x1f\"*:<>?\\\\|\\x7f\\ue000-\\uf8ff\\ufffd]"
    names = t.entries.where("name is not null")
    whole, parsed = t.container.where("pre >= 0"), t.container.where("pre < 0")
    has = t.files.where("name = 'META-INF/container.xml'")
    later = t.rootfiles.withColumn("nth", F.row_number().over(F_window(["package_id"], ["pre"]))).where("nth > 1")
    chosen = reduce(lambda a, b: a | b, [attr(f"{{{RENDITION}}}{a}").isNotNull() for a in ("media", "layout", "language", "accessMode", "label")])
    several = later.select("package_id").distinct()
    return [
        found(bad, "PKG-003", line=False), found(bad, "PKG-008", line=False),
        found(good.join(first, "package_id", "left_anti"), "PKG-006", line=False),
        found(first.where("extra_len > 0"), "PKG-005", line=False, detail=F.col("extra_len")),
        found(content.join(first, "package_id", "left_semi"), "PKG-007", line=False),
        found(names.where(F.col("name").rlike(forbidden)), "PKG-009", line=False, detail=F.col("name")),
        found(names.where(F.col("name").endswith(".")), "PKG-011", line=False, detail=F.col("name")),
        found(names.where(F.col("name").rlike("[ \t]")), "PKG-010", line=False, detail=F.col("name")),
        found(names.where(F.col("name").rlike("[^\\x00-\\x7e]")), "PKG-012", line=False, detail=F.col("name")),
        found(good.join(has, "package_id", "left_anti"), "RSC-002", line=False),
        found(parsed, "RSC-016", "doc", F.col("error")),
        found(whole.select("package_id", "doc").distinct().join(t.rootfiles, "package_id", "left_anti"), "RSC-003", "doc", line=False),
        found(later.where(~chosen), "RSC-017", "doc", "rendition selection"),
        found(several.join(t.files.where("name = 'META-INF/metadata.xml'"), "package_id", "left_anti"), "RSC-019", line=False),
        found(t.rootfiles.join(t.files.select("package_id", F.col("name").alias("path")), ["package_id", "path"], "left_anti"), "OPF-002", "doc", F.col("path"), line=False),
    ]


def F_window(by: list[str], order: list[str]):
    from pyspark.sql import Window as W

    return W.partitionBy(*by).orderBy(*order)


def metadata_rules(t: Tables) -> list[DataFrame]:
    x = t.opf.where("pre >= 0")
    root = x.where("depth = 0")
    meta = children(x, root, "metadata")
    part = {n: children(x, meta, n, DC) for n in ("identifier", "title", "language")}
    blank = F.trim("text") == ""
    fields = root.select(*DOC, "line", "col", F.split(F.trim(F.regexp_replace(filled("prefix"), r"\s+", " ")), " ").alias("fields"))
    pairs = fields.select(*DOC, "line", "col", F.explode(F.expr("transform(sequence(0, cast((size(fields) - 1) div 2 as int)), i -> struct(get(fields, 2 * i) as name, get(fields, 2 * i + 1) as uri))")).alias("p")).where("p.uri is not null and p.name like '%:'")
    declared = pairs.where(F.col("p.uri") != DC).select(*DOC, F.regexp_replace("p.name", ":$", "").alias("prefix")).distinct()
    used = x.select(*DOC, "line", "col", F.explode(F.flatten(F.array(*[tokens(attr(a)) for a in ("property", "rel", "properties", "scheme")]))).alias("v")).where("v like '%:%'").withColumn("prefix", F.substring_index("v", ":", 1))
    uid = root.withColumn("uid", filled("unique-identifier"))
    unresolved = uid.join(shuffled(part["identifier"].select(*DOC, filled("id").alias("uid")).distinct()), [*DOC, "uid"], "left_anti")
    metas = children(x, meta, "meta").where(filled("property") != "").withColumn("property", attr("property")).withColumn("v", F.trim("text"))
    main = metas.where(filled("refines") == "")
    counts = main.groupBy(*DOC, "property").agg(F.count("*").alias("n"))
    once = meta.join(shuffled(counts.where("property = 'dcterms:modified' and n = 1")), DOC, "left_anti")
    lang = part["language"].where(~blank).withColumn("why", language_tag_error(F.trim("text")))
    rules = [
        found(t.opf.where("pre < 0"), "RSC-016", "doc", F.col("error")),
        found(root.join(shuffled(meta), DOC, "left_anti"), "RSC-005", "doc", "metadata missing"),
        found(pairs.where(F.col("p.uri") == DC), "OPF-007c", "doc"),
        found(used.join(shuffled(declared), [*DOC, "prefix"], "left_anti").where(~F.col("prefix").isin(*PREFIXES)), "OPF-028", "doc", F.col("prefix")),
        *[found(meta.join(shuffled(part[n]), DOC, "left_anti"), "RSC-005", "doc", f"{n} missing") for n in part],
        *[found(part[n].where(blank), "RSC-005", "doc", f"{n} empty") for n in part],
        found(unresolved.join(shuffled(meta), DOC, "left_semi"), "OPF-030", "doc", F.col("uid")),
        found(unresolved.join(shuffled(part["identifier"]), DOC, "left_semi"), "RSC-005", "doc", "unique-identifier"),
        found(lang.where("why <> ''"), "OPF-092", "doc", F.col("why")),
        found(main.where((F.col("property") == "dcterms:modified") & ~F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")), "RSC-005", "doc", "modified syntax"),
        found(once, "RSC-005", "doc", "modified must occur once"),
        found(children(x, root, "bindings").join(shuffled(meta), DOC, "left_semi"), "RSC-017", "doc", "bindings"),
        found(children(x, meta).withColumn("a", F.explode(F.array(*[filled(a) for a in ("scheme", "datatype", "property", "rel")]))).where("a like 'xsd:%'"), "OPF-086c", "doc"),
        found(main.where(reduce(lambda a, b: a | b, [(F.col("property") == k) & ~F.col("v").isin(*v) for k, v in VALUES.items()])), "RSC-005", "doc", F.col("property")),
        found(meta.join(shuffled(counts.where(F.col("property").isin(*VALUES) & (F.col("n") > 1)).select(*DOC, "property")), DOC), "RSC-005", "doc", F.col("property")),
    ]
    return rules


def manifest_rules(t: Tables) -> list[DataFrame]:
    x = t.opf.where("pre >= 0")
    root = x.where("depth = 0")
    root = root.join(shuffled(children(x, root, "metadata")), DOC, "left_semi")
    man, spine = children(x, root, "manifest"), children(x, root, "spine")
    props = t.items.select("*", F.explode("props").alias("p")).where("p not like '%:%'")
    count = lambda p: F.count_if(F.col("p") == p)
    totals = man.select(*DOC, "line", "col").join(shuffled(props.groupBy(*DOC).agg(count("nav").alias("navs"), count("cover-image").alias("covers"))), DOC, "left")
    names = t.files.select("package_id", F.col("name").alias("path"))
    twice = t.items.groupBy(*DOC, "path").agg(F.count("*").alias("n")).where("n > 1")
    direction = filled("page-progression-direction")
    again = t.spine.where("path is not null").withColumn("nth", F.row_number().over(F_window([*DOC, "idref"], ["at"]))).where("nth > 1")
    repeated = t.items.withColumn("nth", F.row_number().over(F_window([*DOC, "id"], ["ord"]))).where("nth > 1")
    return [
        found(root.join(shuffled(man), DOC, "left_anti"), "RSC-005", "doc", "manifest missing"),
        found(repeated, "RSC-005", "doc", "duplicate id"),
        found(props.where(~F.col("p").isin(*PROPERTIES)), "OPF-027", "doc", F.col("p")),
        found(props.where("p = 'cover-image' and media_type not like 'image/%'"), "OPF-012", "doc"),
        found(man.select(*DOC, "line", "col").join(shuffled(twice), DOC), "OPF-074", "doc", F.col("path")),
        found(totals.where("coalesce(navs, 0) <> 1"), "RSC-005", "doc", "one nav item"),
        found(totals.where("covers > 1"), "RSC-005", "doc", "one cover-image"),
        found(t.items.join(shuffled(names), ["package_id", "path"], "left_anti"), "RSC-001", "path", line=False),
        found(root.join(shuffled(spine), DOC, "left_anti"), "RSC-005", "doc", "spine missing"),
        found(spine.where(~direction.isin("", "ltr", "rtl", "default")), "RSC-005", "doc", "direction"),
        found(spine.join(shuffled(t.spine), DOC, "left_anti"), "RSC-005", "doc", "spine empty"),
        found(t.spine.where("path is null"), "OPF-049", "doc", F.col("idref")), found(t.spine.where("path is null"), "RSC-005", "doc", "itemref"),
        found(again, "RSC-005", "doc", "itemref repeated"),
        found(t.spine.where(F.col("path").isNotNull() & F.col("end").isNull()), "OPF-043", "doc", F.col("media_type")),
    ]


def content_rules(t: Tables) -> list[DataFrame]:
    x = t.html.where("pre >= 0")
    root = x.where("depth = 0")
    head = children(x, root, "head")
    owner = t.owners.select("package_id", F.col("path").alias("doc"), "props")
    kind = F.lower(filled("type"))
    script = (F.col("local") == "script") & (F.col("ns") == XHTML) & ((kind == "") | kind.contains("javascript") | kind.isin("module", "text/ecmascript"))
    handler = F.exists(F.map_keys("attrs"), lambda k: k.rlike("^on.+"))
    uses = {"switch": (F.col("ns") == OPS) & (F.col("local") == "switch"), "mathml": (F.col("ns") == MATHML) & (F.col("local") == "math"), "svg": (F.col("ns") == SVG) & (F.col("local") == "svg"), "scripted": script | handler | ((F.col("ns") == XHTML) & (F.col("local") == "form"))}
    used = x.groupBy(*DOC).agg(*[F.bool_or(c).alias(n) for n, c in uses.items()]).join(shuffled(owner), DOC)
    each_use = used.select("package_id", "doc", "props", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("used")) for n in uses])).alias("u"))
    toc = x.where(F.col("local") == "nav").where(F.array_contains(tokens(attr(f"{{{OPS}}}type")), "toc"))
    refs = x.where(F.col("local").isin(*REFERENCES)).select(*DOC, "line", "col", F.col("local").alias("element"), F.explode(F.array(*[F.when(F.array_contains(F.split(F.create_map(*[F.lit(v) for kv in REFERENCES.items() for v in kv])[F.col("local")], " "), a), attr(a)) for a in ("href", "src", "poster", "data")])).alias("href")).where("href <> ''")
    refs = refs.withColumn("why", url_errors("href"))
    remote = children(x, head, "base").where(filled("href").contains(":")).select(*DOC)
    plain = refs.where("why = ''").join(shuffled(remote), DOC, "left_anti").withColumn("target", resolved("doc", "href"))
    names = t.files.select("package_id", F.col("name").alias("path"))
    status = reference_status(plain.where("target is not null"), names, t.owners, t.spine.where("path is not null").select("package_id", "path"), "package_id")
    view = children(x, head, "meta").where(attr("name") == "viewport").join(shuffled(t.fixed), DOC, "left_semi")
    first = view.withColumn("nth", F.row_number().over(F_window(DOC, ["pre"]))).where("nth = 1").withColumn("parts", F.filter(F.split(filled("content"), "[,;]"), lambda p: p != ""))
    wrong = F.exists("parts", lambda p: ~p.contains("=") | (F.trim(F.substring_index(p, "=", 1)) == ""))
    sizes = first.where(~wrong).select(*DOC, "line", "col", F.explode(F.array(F.lit("width"), F.lit("height"))).alias("dim"), "parts")
    sizes = sizes.withColumn("v", F.expr("transform(filter(parts, p -> lower(trim(substring_index(p, '=', 1))) = dim), p -> trim(substr(p, instr(p, '=') + 1)))"))
    value = F.try_element_at("v", F.lit(1))
    unsized = root.join(shuffled(t.fixed), DOC, "left_semi").join(shuffled(view), DOC, "left_anti").select(*DOC, "line", "col").join(shuffled(head.select(*DOC, F.col("line").alias("h_line"), F.col("col").alias("h_col"))), DOC, "left")
    return [
        found(t.html.where("pre < 0"), "RSC-016", "doc", F.col("error")),
        found(x.where((F.col("ns") == OPS) & F.col("local").isin("switch", "trigger")), "RSC-017", "doc", "deprecated element"),
        found(head.join(shuffled(children(x, head, "title").select(*DOC)), DOC, "left_anti"), "RSC-017", "doc", "title"),
        found(root.join(shuffled(owner.where(F.array_contains("props", "nav"))), DOC, "left_semi").join(shuffled(toc), DOC, "left_anti"), "RSC-005", "doc", "toc"),
        found(each_use.where("u.used and not array_contains(props, u.name)"), "OPF-014", "doc", F.col("u.name"), line=False),
        found(each_use.where("not u.used and array_contains(props, u.name)"), "OPF-015", "doc", F.col("u.name"), line=False),
        found(refs.where("why <> ''"), "RSC-020", "doc", F.col("why")),
        found(plain.where("href like '/%' and href not like '//%'"), "RSC-026", "doc", F.col("href")),
        found(status.where("status in ('missing', 'undeclared', 'not_in_spine')"), F.when(F.col("status") == "missing", "RSC-007").when(F.col("status") == "undeclared", "RSC-008").otherwise("RSC-011"), "doc", F.col("target")),
        found(unsized.select(*DOC, F.coalesce("h_line", "line").alias("line"), F.coalesce("h_col", "col").alias("col")), "HTM-046", "doc"),
        found(first.where(wrong), "HTM-047", "doc"),
        found(sizes.where("size(v) = 0"), "HTM_056", "doc", F.col("dim")), found(sizes.where("size(v) > 1"), "HTM_059", "doc", F.col("dim")),
        found(sizes.where((F.size("v") == 1) & (value != F.concat(F.lit("device-"), F.col("dim"))) & ~F.coalesce(F.expr("try_cast(try_element_at(v, 1) as double) > 0"), F.lit(False))), "HTM_057", "doc", F.col("dim")),
    ]


def structure_rules(t: Tables) -> list[DataFrame]:
    """Rules on elements and their ancestors, ids and attributes: all are schema-class errors but for deprecated roles."""
    x = t.html.where("pre >= 0")
    h = x.where(F.col("ns") == XHTML)
    named = lambda *n: h.where(F.col("local").isin(*n))
    has = lambda a: attr(a).isNotNull()
    ids = x.where(has("id")).select(*DOC, attr("id").alias("ref"), "pre", "above", "local", "ns", filled("type").alias("type"))
    lacking = lambda rows, targets: rows.join(shuffled(targets.select(*DOC, "ref").distinct()), [*DOC, "ref"], "left_anti")
    ref = lambda rows, a: rows.where(has(a)).withColumn("ref", attr(a))
    each = lambda rows, a: rows.where(has(a)).withColumn("ref", F.explode(tokens(attr(a))))
    error = lambda rows, why: found(rows, "RSC-005", "doc", why)
    labelled = ids.where(F.col("local").isin("button", "input", "meter", "output", "progress", "select", "textarea") & ~((F.col("local") == "input") & (F.col("type") == "hidden")))
    twice = ids.groupBy(*DOC, "ref").agg(F.count("*").alias("n")).where("n > 1")
    maps = named("map").where(has("name")).withColumn("ref", attr("name"))
    several = maps.groupBy(*DOC, "ref").agg(F.count("*").alias("n")).where("n > 1")
    options = beneath(named("option").where(has("selected")).select(*DOC, "above"), "pre")
    chosen = named("select").where(~has("multiple")).join(shuffled(options), [*DOC, "pre"]).groupBy(*DOC, "pre", "line", "col").agg(F.count("*").alias("n")).where("n > 1")
    tracks = named("track").where(has("default")).withColumn("nth", F.row_number().over(F_window([*DOC, "parent"], ["pre"]))).where("nth > 1")
    active = ref(x, "aria-activedescendant")
    below = beneath(ids.select(*DOC, "above", "ref"), "pre").drop("above").distinct()
    interactive = h.where(F.col("local").isin("button", "details", "embed", "iframe", "label", "select", "textarea") | ((F.col("local") == "a") & has("href")) | (F.col("local").isin("audio", "video") & has("controls")) | (F.col("local").isin("img", "object") & has("usemap")) | ((F.col("local") == "input") & (filled("type") != "hidden")))
    # What is looked for above an element stands in a list; the names of the elements above it are joined by their place.
    forbidden = h.where(F.col("local").isin(*INSIDE)).select(*DOC, "pre", "above", "line", "col", F.col("local").alias("inside"), F.explode(F.create_map(*[v for k, a in INSIDE.items() for v in (F.lit(k), F.array(*map(F.lit, a)))])[F.col("local")]).alias("a_local"))
    forbidden = forbidden.union(interactive.select(*DOC, "pre", "above", "line", "col", "local", F.explode(F.array(F.lit("a"), F.lit("button"))))).distinct()
    misplaced = beneath(forbidden).join(shuffled(h.select(*DOC, F.col("pre").alias("a_pre"), F.col("local").alias("a_local"))), [*DOC, "a_pre", "a_local"], "left_semi").dropDuplicates([*DOC, "pre", "inside", "a_local"])
    metas = named("meta")
    declared = metas.where(F.lower(filled("http-equiv")) == "content-type")
    charsets = metas.where(has("charset"))
    heads = charsets.groupBy(*DOC, "parent").agg(F.min("pre").alias("first"))
    cells = h.where(has("headers"))
    tables_above = beneath(cells.select(*DOC, "pre", "above")).join(shuffled(named("table").select(*DOC, F.col("pre").alias("a_pre"))), [*DOC, "a_pre"])
    titles = beneath(ids.where((F.col("local") == "th") & (F.col("ns") == XHTML)).select(*DOC, "above", "ref")).drop("above")
    allowed = tables_above.join(shuffled(titles), [*DOC, "a_pre"]).select(*DOC, "pre", "ref").distinct()
    spoken = x.where(has(f"{{{SSML}}}ph"))
    relations = x.select(*DOC, "pre", "line", "col", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), attr(a).alias("v")) for a in ("aria-describedby", "aria-flowto", "aria-labelledby", "aria-owns", "aria-controls")])).alias("r")).where("r.v is not null")
    relations = relations.select(*DOC, "pre", "line", "col", F.col("r.a").alias("a"), F.explode(tokens(F.col("r.v"))).alias("ref"))
    roles = h.where(has("role")).withColumn("roles", tokens(attr("role")))
    kind = filled("type")
    scripts = kind.rlike("^(module|(application|text)/(x-)?(java|ecma)script|text/(javascript1\\.[0-5]|jscript|livescript))$")
    return [
        error(named("title").where(normal_space(F.col("text")) == ""), "empty title"),
        error(within(named("area"), named("map"), "left_anti"), "area outside map"),
        error(within(named("img").where(has("ismap")), named("a").where(has("href")), "left_anti"), "ismap outside link"),
        error(named("bdo").where(~has("dir")), "bdo without dir"),
        error(lacking(ref(named("label"), "for"), labelled), "label target"),
        error(lacking(each(named("output"), "for"), ids), "output target"),
        error(lacking(ref(named("input"), "list"), ids.where((F.col("local") == "datalist") & (F.col("ns") == XHTML))), "list target"),
        error(maps.join(shuffled(several), [*DOC, "ref"], "left_semi"), "duplicate map name"),
        error(maps.where(has("id") & (attr("id") != F.col("ref"))), "map id"),
        error(chosen, "several selected options"),
        error(named("track").where(has("label") & (normal_space(filled("label")) == "")), "empty track label"), error(tracks, "several default tracks"),
        error(named("link").where(has("sizes") & (filled("rel") != "icon")), "sizes"),
        error(named("script").where(has("src") & has("type") & ~scripts), "data script with src"),
        error(h.where(has("itemprop") & ((F.col("local").isin("a", "area") & ~has("href")) | (F.col("local").isin("iframe", "embed", "object") & ~has("data")) | (F.col("local").isin("audio", "video") & ~has("src")))), "itemprop"),
        found(misplaced, "RSC-005", "doc", F.concat("inside", F.lit(" in "), "a_local")),
        error(lacking(ref(h, "form"), ids.where((F.col("local") == "form") & (F.col("ns") == XHTML))), "form target"),
        error(h.where(has("lang") & (F.lower(attr("lang")) != F.lower(attr(f"{{{XML}}}lang")))), "lang"),
        found(roles.withColumn("r", F.explode(F.array_intersect("roles", F.array(F.lit("doc-endnote"), F.lit("doc-biblioentry"))))), "RSC-017", "doc", F.col("r")),
        found(roles.where(has("aria-label") | has("aria-labelledby")).withColumn("r", F.explode(F.array_intersect("roles", F.array(F.lit("doc-pagefooter"), F.lit("doc-pageheader"))))), "RSC-005", "doc", F.col("r")),
        found(lacking(relations, ids).dropDuplicates([*DOC, "pre", "a"]), "RSC-005", "doc", F.col("a")),
        error(active.join(shuffled(below), [*DOC, "pre", "ref"], "left_anti"), "active descendant"),
        error(declared.where(~normal_space(filled("content")).rlike(r"(?i)text/html;\s*charset=utf-8")), "encoding declaration"),
        error(declared.join(shuffled(heads), [*DOC, "parent"], "left_semi"), "two kinds of encoding declaration"),
        error(charsets.join(shuffled(heads), [*DOC, "parent"]).where("pre > first"), "several charsets"),
        error(each(cells, "headers").join(shuffled(allowed), [*DOC, "pre", "ref"], "left_anti").dropDuplicates([*DOC, "pre"]), "headers"),
        *[error(lacking(ref(x.where(F.col("ns") == MATHML), a), ids), a) for a in ("xref", "indenttarget")],
        *[error(lacking(ref(x.where((F.col("ns") == OPS) & (F.col("local") == "trigger")), a), ids), a) for a in (f"{{{EVENTS}}}observer", "ref")],
        error(within(spoken, spoken), "ssml:ph"),
        error(ref(x, "id").join(shuffled(twice), [*DOC, "ref"], "left_semi"), "duplicate id"),
    ]


def resource_rules(t: Tables) -> list[DataFrame]:
    data = t.owners.join(shuffled(t.files.select("package_id", F.col("name").alias("path"), "content")), ["package_id", "path"])
    css = data.where("media_type = 'text/css'").select("package_id", "path", css_errors("content").alias("e")).where("e.line is not null").select("package_id", "path", F.col("e.line").alias("line"), F.lit(0).alias("col"), F.col("e.reason").alias("reason"))
    images = data.where("media_type like 'image/%'").select("package_id", "path", "media_type", sniffed_type(F.col("content")).alias("got"), image_header("content").alias("header"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    fits = reduce(lambda a, b: a | b, [(F.col("got") == k) & ext.isin(*v) for k, v in EXTENSIONS.items()])
    return [
        found(css, "CSS-008", "path", F.col("reason")), found(images.where("got <> media_type"), "OPF-029", "path", line=False),
        found(images.where("got = '' or not header"), "PKG-021", "path", line=False), found(images.where("got <> '' and coalesce(header, true)").where(~fits), "PKG-022", "path", line=False),
    ]


def model_rules(t: Tables, models: dict[str, str]) -> list[DataFrame]:
    """Well-formed documents against the grammar of their media type; package documents have application/oebps-package+xml."""
    owned = t.owners.select("package_id", F.col("path").alias("doc"), "media_type").union(t.rootfiles.select("package_id", "path", F.lit("application/oebps-package+xml"))).distinct()
    parsed = t.html.where("pre = 0").select(*DOC).union(t.opf.where("pre = 0").select(*DOC))
    docs = owned.join(parsed, DOC, "left_semi").join(t.files.select("package_id", F.col("name").alias("doc"), "content"), DOC)
    return [grammar_findings(docs.where(F.col("media_type") == kind), source) for kind, source in sorted(models.items())]


def check(packages: DataFrame, models: dict[str, str] | None = None) -> DataFrame:
    """All findings of packages(package_id, content), with severities, in order. models: grammars (RELAX NG, compact) by media type."""
    t = tables(packages)
    return reported([*container_rules(t), *metadata_rules(t), *manifest_rules(t), *content_rules(t), *structure_rules(t), *resource_rules(t), *model_rules(t, models or {})])


def reported(rules: list[DataFrame]) -> DataFrame:
    """Findings of rules with severities, in order: by place, then as the rules stand in the list."""
    severity = F.create_map(*[F.lit(v) for name, codes in CODES.items() for c in codes for v in (c, SEVERITIES.index(name))])
    rows = reduce(DataFrame.unionByName, [r.withColumn("emit_seq", F.struct(F.lit(i).alias("rule"), "detail")) for i, r in enumerate(rules)])
    rows = rows.withColumn("severity", severity[F.col("code")])
    rows = rows.withColumn("severity_name", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("severity") + 1))
    return ordered(rows, "package_id").drop("emit_seq")


def page_rules(t: Tables, expected: DataFrame) -> list[DataFrame]:
    """Pages against expected(package_id, pages, canvas_w, canvas_h, grayscale) and against their images; a null expects nothing.

    LB-013 and LB-015 also hold for packages that expected does not name. Of several viewports or images of a page the last counts.
    """
    want = expected.select(F.col("package_id").cast("string").alias("package_id"), "pages", "canvas_w", "canvas_h", "grayscale")
    x = t.opf.where("pre >= 0")
    root = x.where("depth = 0")
    meta = children(x, children(x, root, "metadata"), "meta").where(attr("name") == "original-resolution")
    books = root.select(*DOC, "line", "col").join(want, "package_id")
    books = books.join(t.spine.groupBy(*DOC).agg(F.count("*").alias("n")), DOC, "left").join(meta.groupBy(*DOC).agg(F.min_by(filled("content"), "pre").alias("resolution")), DOC, "left")
    size = r"^\s*width\s*=\s*(\d+)\s*,\s*height\s*=\s*(\d+)\s*$"
    h = t.html.where("pre >= 0")
    views = h.where((F.col("local") == "meta") & (attr("name") == "viewport")).groupBy("package_id", F.col("doc").alias("path")).agg(F.max_by(filled("content"), "pre").alias("view"), F.bool_and(filled("content").rlike(size)).alias("whole")).where("whole")
    shown = h.where("local = 'img'").groupBy("package_id", F.col("doc").alias("path")).agg(F.max_by(filled("src"), "pre").alias("src"))
    side = lambda i: F.regexp_extract("view", size, i).try_cast("long")
    pages = t.spine.where("path is not null").select("package_id", "path", "line", "col").join(views, ["package_id", "path"]).withColumn("w", side(1)).withColumn("h", side(2)).join(want, "package_id", "left")
    images = pages.join(shown, ["package_id", "path"]).withColumn("image", resolved("path", F.col("src"))).join(t.files.select("package_id", F.col("name").alias("image"), "content"), ["package_id", "image"])
    read = images.withColumn("got", jpeg_of("content")).drop("content")
    decoded = read.where("got.error is null")
    return [
        found(books.where("pages > 0 and coalesce(n, 0) <> pages"), "LB-010", "doc", F.coalesce("n", F.lit(0)), line=False),
        found(books.where("coalesce(resolution, '') <> concat(canvas_w, 'x', canvas_h)"), "LB-011", "doc", F.coalesce("resolution", F.lit("")), line=False),
        found(pages.where("w is distinct from canvas_w or h is distinct from canvas_h").where("canvas_w is not null and canvas_h is not null"), "LB-012", "path", F.col("view"), line=False),
        found(decoded.where("got.width is distinct from w or got.height is distinct from h"), "LB-013", "image", F.concat_ws("x", "got.width", "got.height"), line=False),
        found(decoded.where("grayscale and got.channels <> 1"), "LB-014", "image", F.col("got.channels"), line=False),
        found(read.where("got.error is not null"), "LB-015", "image", F.col("got.error"), line=False),
    ]


def own_rules(t: Tables) -> list[DataFrame]:
    """Storage of `mimetype`, values that every parser reads alike, nothing unlisted in the archive."""
    first = t.entries.where("ord = 0 and name = 'mimetype'")
    listed = t.owners.select("package_id", F.col("path").alias("name"))
    spare = t.files.where("name <> 'mimetype' and name not like 'META-INF/%' and name not like '%/'").join(shuffled(t.rootfiles.select("package_id", F.col("path").alias("name"))), ["package_id", "name"], "left_anti")
    x = t.opf.where("pre >= 0")
    texts = children(x, children(x, x.where("depth = 0"), "metadata"), "meta").where(filled("property").isin(*VALUES, "dcterms:modified") & F.col("text").rlike(r"^\s|\s$"))
    return [found(first.where("method <> 0"), "LB-001", line=False), found(first.where("flags & 8 <> 0"), "LB-002", line=False), found(texts, "LB-003", "doc"), found(spare.join(shuffled(listed), ["package_id", "name"], "left_anti"), "LB-004", "name", line=False)]


def strict(packages: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Rules for packages that this engine writes (own_rules). With expected, which may have no rows, also page_rules."""
    t = tables(packages)
    return reduce(DataFrame.unionByName, own_rules(t) + (page_rules(t, expected) if expected is not None else []))
