"""Scalar functions over columns: integer geometry, colour, names, text and tags. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_div(a: Column, b: Column) -> Column:
    """Quotient of positive integers, rounded up."""
    return F.call_function("div", a + b - 1, b)


def whole(a: Column, b: Column | int) -> Column:
    """Integer quotient without a guard, for divisors known to be positive."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Rounded brightness, 0 to 255."""
    return whole(r * 2126 + g * 7152 + b * 722 + 5000, 10_000)


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)])


def orientation(w: Column, h: Column) -> Column:
    return F.when(w > h, "landscape").when(h > w, "portrait").otherwise("square")


def book_orientation(w: Column, h: Column, override: Column, mixed: Column) -> Column:
    """struct(book, rendition, lock): the neutral value is `auto` for a rendition and `none` for a lock."""
    shape = F.when(mixed, "auto").when(w > h, "landscape").when(h > w, "portrait").otherwise("auto")
    book = F.coalesce(F.when(override != "", override), shape)
    return F.struct(book.alias("book"), F.when(book == "none", "auto").otherwise(book).alias("rendition"), F.when(book == "auto", "none").otherwise(book).alias("lock"))


def fit(w: Column, h: Column, box_w: Column, box_h: Column) -> tuple[Column, Column]:
    """The largest size of the same shape inside a box, to the nearest pixel, at least 1."""
    scale = F.least(box_w.cast("double") / w, box_h.cast("double") / h)
    side = lambda a, box: F.greatest(F.lit(1), F.least(box, F.floor(a * scale + 0.5)))
    return side(w, box_w).cast("long"), side(h, box_h).cast("long")


def white_point(grey: Column) -> Column:
    return whole((grey - 8) * 100, 255)


def quant_scale(base: Column, quality: Column) -> Column:
    """An entry of a quantisation table at a quality of 1 to 100, within 1 to 255."""
    scale = F.when(quality < 50, whole(F.lit(5000), F.greatest(quality, F.lit(1)))).otherwise(200 - 2 * quality)
    return F.greatest(F.lit(1), F.least(F.lit(255), whole(base * scale + 50, 100)))


def bit_category(v: Column) -> Column:
    """Bits of the absolute value; 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v.cast("long")))))


def pixels_per_inch(px_w: Column, px_h: Column, pt_w: Column, pt_h: Column) -> Column:
    """Resolution of an image drawn pt_w by pt_h points, sides paired the way that agrees best."""
    in_w, in_h = pt_w / 72.0, pt_h / 72.0
    a, b, c, d = px_w / in_w, px_h / in_h, px_w / in_h, px_h / in_w
    return F.when(F.abs(a - b) <= F.abs(c - d), (a + b) / 2).otherwise((c + d) / 2)


def cover_dpi(w_pt: Column) -> Column:
    return F.greatest(F.lit(8), F.least(F.lit(150), whole(F.lit(360 * 72), F.greatest(F.lit(1), w_pt))))


def progress(stage: Column, done: Column, total: Column) -> Column:
    """Share of a job that is done: measuring is its first tenth, rendering the rest."""
    part = F.when(total > 0, done.cast("double") / total).otherwise(F.lit(0.0))
    return F.when(stage == "measuring", 0.1 * part).when(stage == "rendering", 0.1 + 0.9 * part).otherwise(F.lit(0.0))


def page_name(i: Column, total: Column) -> Column:
    """1-based number of page i (from 0), padded to three digits or more."""
    number = (i + 1).cast("string")
    width = F.greatest(F.lit(3), F.length(total.cast("string")), F.length(number))
    return F.lpad(number, width, F.lit("0"))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def human_bytes(n: Column) -> Column:
    """Binary units with one decimal, as `1.5 KiB`; plain bytes under 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate("KMGTPE", 1):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", F.bround(n / float(1024**power), 1)), F.lit(f" {unit}iB"))).otherwise(out)
    return out


#: Unicode white space, beyond what \s matches.
SPACES = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def normal_space(s: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(s, f"[{SPACES}]+", " "))


def clean_title(s: Column) -> Column:
    """Without characters that XML cannot hold, white space normalised."""
    return normal_space(F.regexp_replace(s, "[\\x00-\\x08\\x0e-\\x1f\\x7f-\\x84\\x86-\\x9f\\ufffe\\uffff]", ""))


def xml_escaped(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def has_token(tokens: Column, token: str) -> Column:
    return F.array_contains(F.split(normal_space(tokens), " "), token)


#: The irregular tags of RFC 5646.
GRANDFATHERED = (
    "en-gb-oed", "i-ami", "i-bnn", "i-default", "i-enochian", "i-hak", "i-klingon", "i-lux", "i-mingo", "i-navajo", "i-pwn", "i-tao", "i-tay", "i-tsu",
    "sgn-be-fr", "sgn-be-nl", "sgn-ch-de", "art-lojban", "cel-gaulish", "no-bok", "no-nyn", "zh-guoyu", "zh-hakka", "zh-min", "zh-min-nan", "zh-xiang",
)
#: The grammar of RFC 5646 in lower case, but for repeated singletons.
LANGUAGE_TAG = (
    "^(([a-z]{2,3}(-[a-z]{3}){0,3}|[a-z]{4,8})(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?(-([a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*"
    "(-[0-9a-wyz](-[a-z0-9]{2,8})+)*(-x(-[a-z0-9]{1,8})+)?|x(-[a-z0-9]{1,8})+)$"
)


def language_tag_error(tag: Column) -> Column:
    """Why a language tag is not well formed; an empty string if it is."""
    low = F.lower(tag)
    parts = F.split(low, "-")
    public = F.split(F.regexp_replace(low, "(^|-)x-.*$", ""), "-")
    single = F.filter(public, lambda p: F.length(p) == 1)
    return (
        F.when(tag.isNull() | (tag == ""), "empty tag")
        .when(low.isin(*GRANDFATHERED), "")
        .when(F.exists(parts, lambda p: p == ""), "empty subtag")
        .when(F.exists(parts, lambda p: ~p.rlike("^[a-z0-9]{1,8}$")), "bad subtag")
        .when(~low.rlike(LANGUAGE_TAG), "bad order of subtags")
        .when(F.size(single) != F.size(F.array_distinct(single)), "repeated singleton")
        .otherwise("")
    )


def finding_text(severity: Column, code: Column, path: Column, line: Column, col: Column, text: Column) -> Column:
    """`SEVERITY(CODE): path(line,col): text`; a place only where there is one."""
    place = F.when(line > 0, F.format_string("(%d,%d)", line, col)).otherwise("")
    return F.concat(severity, F.lit("("), code, F.lit("): "), F.when(path != "", F.concat(path, place, F.lit(": "))).otherwise(""), text)


def finding_code(line: Column) -> Column:
    """The label that starts a finding's text, else what stands before its first colon."""
    label = F.regexp_extract(line, r"^[A-Z]+\([A-Z]{2,3}[-_][0-9]{3}[a-z]?\)", 0)
    return F.when(label != "", label).otherwise(F.substring_index(line, ":", 1))


def image_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))
    return F.when(ext == "png", "image/png").when(ext == "gif", "image/gif").when(ext == "webp", "image/webp").when(ext == "svg", "image/svg+xml").otherwise("image/jpeg")


def sniffed_type(data: Column) -> Column:
    """An image's type from its first bytes; an empty string if unknown."""
    head = F.hex(F.substring(data, 1, 16))
    early = F.hex(F.substring(data, 1, 512))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when((F.octet_length(data) > 12) & head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(early.rlike("^(..)*3C737667"), "image/svg+xml")
        .otherwise("")
    )


def viewport_size(content: Column) -> Column:
    """struct(w, h) of a viewport such as `width=10, height=20`: parts at commas and semicolons, the last of a name; 0 where there is no whole number."""

    def side(name: str) -> Column:
        own = F.filter(F.split(content, "[,;]"), lambda p: F.trim(F.substring_index(p, "=", 1)) == name)
        value = F.trim(F.regexp_replace(F.element_at(own, -1), "^[^=]*=?", ""))
        return F.when(F.size(own) > 0, F.coalesce(F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("long")), F.lit(0))).otherwise(0).cast("long")

    return F.struct(side("width").alias("w"), side("height").alias("h"))


def message(template: Column, args: list[Column]) -> Column:
    """`%1$s` and the like filled in by number; a missing argument is empty."""
    marked = F.regexp_replace(template, r"%(\d+)\$s", "\x01$1\x02")  # so that what is filled in is not filled in again
    for i, a in enumerate(args, 1):
        marked = F.replace(marked, F.lit(f"\x01{i}\x02"), F.coalesce(a.cast("string"), F.lit("")))
    return F.regexp_replace(marked, "\x01\\d+\x02", "")


def book_file(name: Column) -> Column:
    """The package's file name for a document's."""
    return F.concat(without_extension(name), F.lit(".epub"))


def screen_fill(w: Column, h: Column, screen_w: Column, screen_h: Column) -> Column:
    """struct(fill, turn): percent of a screen that a fitted page covers, half up; turn it when under 70 and the long sides differ."""
    k = F.least(screen_w.cast("double") / w, screen_h.cast("double") / h)
    fill = F.floor(100 * (w * k) * (h * k) / (screen_w.cast("double") * screen_h) + 0.5).cast("int")
    return F.struct(fill.alias("fill"), ((fill < 70) & ((w > h) != (screen_w > screen_h))).alias("turn"))


def whole_characters(data: Column) -> Column:
    """UTF-8 bytes as text, without a character that is cut off at the end."""
    return F.regexp_replace(F.try_validate_utf8(F.make_valid_utf8(data.cast("string"))), "\ufffd+$", "")


def is_document(name: Column, kind: Column) -> Column:
    """Whether an upload is a document by its name or its media type."""
    return F.coalesce(name.rlike(r"(?i)\.pdf$"), F.lit(False)) | F.coalesce(kind == "application/pdf", F.lit(False))
