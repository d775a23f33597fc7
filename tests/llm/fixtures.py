"""Documents with every awkward shape: nulls, empties, repeats, one long text, clashing extra columns."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_shingles int, component_id string, score string, start string, _quire_salt int"


def word(r):
    return "".join(r.choice(["an", "re", "th", "ou", "le", "que", "er", "ö"]) for _ in range(r.randint(1, 4)))


def texts(seed=3, n=40):
    r = random.Random(seed)
    base = [" ".join(word(r) for _ in range(r.randint(3, 120))) for _ in range(n)]
    near = []
    for t in base[:12]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return [*base, *near, base[0], base[0].upper(), base[1] + "\n", "", None, " \t\n", "one", "two words", "one", "no break\x00here", "x" * 3000 + " tail", " ".join(word(r) for _ in range(20_000)), "...", "123 !!", "<|endoftext|>", "one <|endoftext|> two<|startoftext|>"]


def rows(seed=3):
    out = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], len(t or ""), 1, "x", "y", "z", 0) for i, t in enumerate(texts(seed))]
    return [*out, out[0], (None, "null id text here now", None, None, 1, 1, "x", "y", "z", 0)]


def documents(spark, seed=3):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n
