"""Content models: patterns against plain matching, messages, recovery, includes, datatypes."""

import itertools
import re

import pytest

from quire.operators import datatypes, relaxng


@pytest.mark.parametrize(("source", "fits", "fails"), [
    (r"[a-z-[aeiou]]+", ["bcd"], ["abc"]), ("^a$", ["^a$"], ["a"]), (r"\i\c*", ["a1", "_x:y"], ["1a"]), (r"\d{2}", ["42"], ["4x"]), (r"[^\d\s-[x]]", ["y"], ["1", " ", "x"]), ("a.b", ["axb"], ["a\nb"]),
    (r"\p{Lu}+", ["ÀB"], ["a"]), (r"[\i-[:]][\c-[:]]*", ["ab"], ["a:b"]), (r"\w+", ["aé1"], ["a b"]), (r"(a|b)*c?", ["abab", "c"], ["d"]), (r"\S\D", ["ab"], ["a1", " b"]), (r"[\-x]", ["-", "x"], ["y"]),
])
def test_regular_expressions(source, fits, fails):
    p = datatypes.pattern(source)
    assert all(p.fullmatch(x) for x in fits) and not any(p.fullmatch(x) for x in fails)


def test_datatypes():
    good = [("date", (), "2024-02-03"), ("unsignedByte", (), " 255 "), ("IDREFS", (("maxLength", "2"),), " a  b "), ("decimal", (("minInclusive", "9.5"),), "9.50"), ("boolean", (), "1"), ("string", (("length", "3"),), " a "), ("duration", (), "P1DT2H"), ("token", (("pattern", "a b"),), " a  b ")]
    bad = [("date", (), "2024-13-03"), ("unsignedByte", (), "256"), ("IDREFS", (("maxLength", "1"),), "a b"), ("decimal", (("minInclusive", "10"),), "9.5"), ("NCName", (), "a:b"), ("integer", (), "1.0"), ("duration", (), "P"), ("double", (), "x")]
    assert all(datatypes.valid(*x) for x in good) and not any(datatypes.valid(*x) for x in bad)


# A content model over the letters a, b, c and the same as a regular expression; & is tried by hand.
MODELS = {
    "A, B": "ab", "A | B": "a|b", "A?, B*": "a?b*", "(A, B)+": "(ab)+", "(A | B)*, C": "[ab]*c", "(A, (B | C))*": "(a[bc])*", "empty": "", "notAllowed | A": "a", "(A?, A?), B": "a?a?b", "((A | empty)+, C?)+": "(a*c?)+",
    "A & B": "ab|ba", "A* & B": "a*ba*", "(A, B) & C": "abc|acb|cab", "A? & B? & C?": "|a|b|c|ab|ba|ac|ca|bc|cb|abc|acb|bac|bca|cab|cba",
}


@pytest.mark.parametrize("model", list(MODELS))
def test_models_equal_plain_expressions(model):
    schema = relaxng.Schema(f"start = element r {{ {model} }}\n" + "".join(f"{x.upper()} = element {x} {{ empty }}\n" for x in "abc"))
    for word in itertools.chain.from_iterable(itertools.product("abc", repeat=n) for n in range(5)):
        data = "<r>" + "".join(f"<{x}/>" for x in word) + "</r>"
        assert (not schema.errors(data.encode())) == bool(re.fullmatch(MODELS[model], "".join(word))), data


BOOK = """
default namespace = "q" # of elements
datatypes xsd = "http://www.w3.org/2001/XMLSchema-datatypes"
namespace x = "other"
start = element book { attribute id { xsd:NCName { maxLength = "4" } }, attribute kind { "paper" | "screen" }?, attribute x:note { text }?, title, (chapter | part)+, (element x:* { any }*) }
title = element title { mixed { element em { text }* } }
part = element part { title, chapter+ }
chapter = element chapter { attribute n { xsd:positiveInteger }, element size { list { xsd:int, xsd:int } }?, [ note = "left out" ] element code { xsd:token - "none" } }
any = (element * - (q:* | x:bad) { any } | attribute * { text } | text)*
namespace q = "q"
""".replace('namespace q = "q"\n', "").replace("namespace x =", 'namespace q = "q"\nnamespace x =')


def messages(schema, data):
    return [m for _, _, m in schema.errors(data.encode())]


def test_messages_and_recovery():
    schema = relaxng.Schema(BOOK)
    good = '<book xmlns="q" xmlns:x="other" id="b1" x:note=""><title>A <em>b</em> c</title><part><title/><chapter n="1"><size> 1 2 </size><code>k</code></chapter></part><x:y a="1">t<z xmlns=""/></x:y></book>'
    assert schema.errors(good.encode()) == []
    assert messages(schema, good.replace('id="b1"', 'id="toolong"')) == ['value "toolong" of attribute "id" is not allowed', "missing attributes: id"]
    assert messages(schema, good.replace('id="b1"', 'id="b1" odd=""')) == ['attribute "odd" is not allowed here']
    assert messages(schema, good.replace(" n=\"1\"", "")) == ["missing attributes: n"]
    assert messages(schema, good.replace("<title/>", "<odd><title/><deep/></odd><title/>")) == ['element "odd" is not allowed here; expected "title"']
    assert messages(schema, good.replace("<code>k</code>", "<code>none</code>")) == ["text is not allowed here; nothing is expected", 'element "code" is incomplete; nothing is expected']
    assert messages(schema, good.replace("<size> 1 2 </size>", "<size>1</size>"))[0].startswith("text is not allowed")
    assert messages(schema, good.replace("<code>k</code>", "")) == ['element "chapter" is incomplete; expected "code"']
    assert messages(schema, good.replace("x:y", "x:bad")) == [] and messages(schema, good.replace("<z xmlns=\"\"/>", "<x:bad/>")) == ['element "bad" is not allowed here; expected "any name"']
    assert messages(schema, "<book>") == ['element "book" is not allowed here; expected "book"', "no element found"]
    assert len(schema.errors(b"")) == 1


def test_includes_and_combinations():
    files = {"base.rnc": 'start = element r { body }\nbody = A\nA = element a { empty }\nB |= element b { empty }', "more.rnc": 'include "base.rnc" { body = B+ }\nB |= element c { empty }\ndiv { extra = empty }'}
    schema = relaxng.Schema('include "more.rnc"\nstart &= notUsed\nnotUsed = empty', files)
    assert not schema.errors(b"<r><b/><c/></r>") and messages(schema, "<r><a/></r>")[0] == 'element "a" is not allowed here; expected "b", "c"'
    nested = relaxng.Schema("start = element r { grammar { start = element s { parent leaf } } }\nleaf = element t { empty }")
    assert not nested.errors(b"<r><s><t/></s></r>") and nested.errors(b"<r><s/></r>")
    many = relaxng.Schema("start = element r { " + " | ".join(f"element e{i:02} {{ empty }}" for i in range(12)) + " }")
    assert messages(many, "<r><z/></r>")[0].endswith('"e09" (and more)')


@pytest.mark.parametrize("source", ["start = element a { b }", "start = element a { empty }\nstart = empty", "start = a\na = a", "x = empty, empty | empty\nstart = x", 'include "none"', "start = element a { xsd:odd }", "start = element a {", "start = a\na |= empty\na &= empty"])
def test_schemas_that_cannot_be_read(source):
    with pytest.raises(relaxng.GrammarError):
        relaxng.Schema(source)


def test_findings(spark):
    docs = spark.createDataFrame([("p", "a", bytearray(b"<r/>")), ("p", "b", bytearray(b"<r>\n <x/></r>")), (None, "c", None)], "package_id string, doc string, content binary")
    got = relaxng.grammar_findings(docs, "start = element r { empty }").collect()
    assert sorted((str(r.package_id), r.path, r.line, r.col) for r in got) == [("None", "c", 1, 1), ("p", "b", 2, 2)] and relaxng.grammar_findings(docs.limit(0), "start = element r { empty }").count() == 0
