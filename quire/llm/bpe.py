"""Token ids of public byte-pair vocabularies, with caches over repeated words.

The ids are those of ``tokenizers`` with ``add_special_tokens=False``: the string of a special token in a
text is that token, as the library reads it. A text is cut at those strings, and at spaces where the
vocabulary's pre-tokenizer always cuts, so each piece can be encoded alone and remembered. Pieces of plain Latin letters, digits and ASCII
signs go straight to the library's BPE model, word by word; any other piece goes through the whole
library pipeline. `encode_all` looks the pieces of many texts up at once and merges new words of plain letters together, as
array operations. Caches are cleared when full, which bounds memory and never changes an id.

Defined results: null and empty texts have no ids. Where a vocabulary has added tokens that strip or normalise
what stands beside them, a text that holds one goes through the library whole.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from quire.llm.words import MASKS, eights, placed

MAX_WORDS, MAX_PIECES = 300_000, 600_000  # entries
MAX_PIECE = 80
GROUP = 1 << 20  # characters of texts that are looked up together
TOGETHER, WIDE = 8192, 32  # words merged at once; more than the symbols of any of them

_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_ENDS = tuple(".,;:!?")
#: Of bytes: signs of _ENDS; those of A-Z, a-z and À-ÿ without × and ÷ (0xC3 and what may follow it).
_IS_END, _IS_LETTER = (np.array([c in x for c in range(256)]) for x in ("".join(_ENDS).encode(), string.ascii_letters.encode() + bytes([0xC3, *range(0x80, 0xC0)]).translate(None, b"\x97\xb7")))
_CUT = re.compile(r" (?=\S)")
#: A space and what may follow it that is white space too.
_TWO = tuple(" " + chr(c) for c in range(0x3001) if chr(c).isspace())
_PACK = [struct.Struct(f"<{n}I").pack for n in range(MAX_PIECE)]


def _byte_letters() -> list[int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [b if b in shown else next(rest) for b in range(256)]


class _Words(dict):
    """pre-token -> ids as little-endian 32-bit integers"""

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model
        self.letters = {b: chr(c) for b, c in enumerate(_byte_letters())}

    def encoded(self, shown: str) -> bytes:
        """ids of a word in the letters that stand for bytes"""
        ids = [t.id for t in self.model.tokenize(shown)]
        return _PACK[len(ids)](*ids) if len(ids) < MAX_PIECE else struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            out = self.encoded(word.replace(" ", self.letters[32]))
        else:
            out = self.encoded(word.encode().decode("latin-1").translate(self.letters))
        if len(self) >= MAX_WORDS:
            self.clear()
        if len(word) <= MAX_PIECE:
            self[word] = out
        return out


class _Pieces(dict):
    """piece -> ids; lead is put before the piece when it is encoded"""

    def __init__(self, owner: Bpe, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, piece: str) -> bytes:
        out = self.owner.encode_piece(self.lead, piece)
        if len(self) >= MAX_PIECES:
            self.clear()
        if len(piece) <= MAX_PIECE:
            self[piece] = out
        return out


class _Known:
    """Ids of pieces of at most 16 bytes, found for many pieces at once in a table with open addressing.

    A piece is known by its first and last eight bytes, its length, and whether it stands first in a text, and these are
    compared exactly; a hash of them only says where to look. The table is cleared when it is full.
    """

    BITS = 21

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.at = np.full(1 << self.BITS, -1, np.int32)
        self.keys = np.zeros((3, 1024), np.uint64)
        self.starts, self.ids, self.n = np.zeros(1025, np.int64), np.zeros(1 << 14, np.uint32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = (keys[0] ^ keys[2] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(32) ^ keys[1]) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it is not known."""
        slot = self._slot(keys)
        out = self.at[slot].astype(np.int64)
        left = np.flatnonzero(out >= 0)
        left = left[(self.keys[:, out[left]] != keys[:, left]).any(0)]
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.at)
            out[left] = self.at[slot[left]]
            left = left[out[left] >= 0]
            left = left[(self.keys[:, out[left]] != keys[:, left]).any(0)]
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Pieces that are not known and differ from each other, their ids end to end, and how many each has."""
        more = self.n + len(size)
        if more >= self.keys.shape[1]:
            self.keys = np.concatenate([self.keys, np.zeros((3, more), np.uint64)], 1)
            self.starts = np.concatenate([self.starts, np.zeros(more, np.int64)])
        ends = self.starts[self.n] + np.cumsum(size)
        if len(ends) and ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(int(ends[-1]), np.uint32)])
        self.keys[:, self.n : more], self.starts[self.n + 1 : more + 1] = keys, ends
        self.ids[self.starts[self.n] : self.starts[more]] = ids
        slot, number = self._slot(keys), np.arange(self.n, more)
        while len(slot):  # of several pieces that want one free slot, the last gets it
            free = self.at[slot] < 0
            self.at[slot[free]] = number[free]
            left = self.at[slot] != number
            slot, number = (slot[left] + 1) % len(self.at), number[left]
        self.n = more


class _Merges:
    """The merges of a byte-level model, for many words of one length at once; a pair is found in a table with open addressing.

    In each round every word's pair of least rank (the leftmost of equals) becomes one symbol: the library's order.
    """

    def __init__(self, model: dict):
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.symbol = np.array([vocab[chr(c)] for c in _byte_letters()], np.int64)
        self.made, self.none = np.array([vocab[a + b] for a, b in pairs] + [0], np.int64), len(pairs)
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.keys, self.ranks = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.none, np.int32)
        ranks = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        for key, at in zip(ranks, self._slot(np.fromiter(ranks, np.int64, len(ranks))).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.ranks[at] = key, ranks[key]

    @staticmethod
    def serves(model: dict) -> bool:
        """Whether the model is plain merging of pairs, with a symbol for each byte."""
        more = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        return model.get("type") == "BPE" and not any(model.get(k) for k in more) and all(chr(c) in model["vocab"] for c in _byte_letters())

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, `none` where it is not merged."""
        key = a << 32 | b
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], np.int32(self.none))
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) % len(self.keys)
            found = self.keys[at[left]]
            same = found == key[left]
            out[left[same]] = self.ranks[at[left[same]]]
            left = left[~same & (found >= 0)]
        return out

    def words(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """raw: a column of bytes for each word -> (columns, their ids as rows), as words end."""
        who, s = np.arange(raw.shape[1]), self.symbol[raw]
        r = self.rank(s[:-1].ravel(), s[1:].ravel()).reshape(len(s) - 1, -1)
        while True:
            # All words that go on are of one length, as each round merges one pair of each.
            n = len(r)
            best = (r * np.int32(WIDE) + np.arange(n, dtype=np.int32)[:, None]).min(0, initial=self.none * WIDE)
            on = best < self.none * WIDE
            if not on.all():
                yield who[~on], s[:, ~on].T
                who, s, r, best = who[on], s[:, on], r[:, on], best[on]
            if not len(who):
                return
            at, column = best % WIDE, np.arange(len(who))
            before = np.arange(n)[:, None] < at
            s = np.where(before, s[:-1], s[1:])
            s[at, column] = new = self.made[best // WIDE]
            r = np.where(before[:-1], r[:-1], r[1:])
            i = np.flatnonzero(at > 0)
            r[at[i] - 1, i] = self.rank(s[at[i] - 1, i], new[i])
            i = np.flatnonzero(at < n - 1)
            r[at[i], i] = self.rank(new[i], s[at[i] + 1, i])


class Bpe:
    """spaced: words carry their leading space (byte-level); else white space is dropped and case folded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Python worker has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.model._resize_cache(0)  # ours stands before it
        added = self.whole.get_added_tokens_decoder()
        self.special = {t.content: struct.pack("<I", i) for i, t in added.items()}
        self.simple = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.sections = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})").split
        self.spaced = self.whole.normalizer is None
        # The pre-tokenizers' patterns over plain characters.
        letters = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
        if self.spaced:
            self.words_in = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[0-9]+| ?[^\s{letters}0-9]+|\s+(?!\S)|\s+").findall
        else:
            self.words_in = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^\s{letters}0-9]+").findall
        self.words = _Words(self.whole)
        self.first = _Pieces(self, "")
        self.later = _Pieces(self, " ") if self.spaced else self.first
        self.known = _Known()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = _Merges(model) if self.spaced and _Merges.serves(model) else None

    def encode_piece(self, lead: str, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():
            return self.words.encoded(self.words.letters[32] + piece if lead else piece if self.spaced else piece.lower())
        if piece[-1:] in _ENDS and (body := piece[:-1]).isalpha() and (body.isascii() or _PLAIN.fullmatch(body)):  # one word and one sign
            return (self.later if lead or not self.spaced else self.first)[body] + self.words[piece[-1]]
        piece = lead + piece
        if _PLAIN.fullmatch(piece):
            return b"".join(map(self.words.__getitem__, self.words_in(piece if self.spaced else piece.lower())))
        return self._library(piece)

    def _library(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit integers; null and empty texts have none"""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return self._section(text)
        if not self.simple:
            return self._library(text)
        return b"".join(self.special[s] if i % 2 else self._section(s) for i, s in enumerate(self.sections(text)) if s)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """encode() of each text as numbers, in order; pieces of about GROUP characters of texts are looked up together."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "") + 1
            if size >= GROUP:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        odd = [*self.special, *_TWO]
        narrow = [x for x in odd if x.isascii()]
        plain = [self.spaced and bool(t) and t[0] != " " != t[-1] and not any(map(t.__contains__, narrow if t.isascii() else odd)) for t in texts]
        raw = [t.encode() for t, p in zip(texts, plain, strict=True) if p]
        if raw:
            ids, ends = self._joined(raw)
            cut = iter(np.split(ids, ends[:-1]))
        for text, p in zip(texts, plain, strict=True):
            yield next(cut) if p else np.frombuffer(self.encode(text), "<u4")

    def _joined(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts without special tokens, whose spaces all stand alone between two pieces, end to end; the end of each text's."""
        data = b"".join([b" ", b" ".join(raw), b" " * 9])
        start, n = placed(data)
        eight, mask = eights(data), MASKS[np.minimum(n, 8)]
        begins = 1 + np.cumsum([0, *(len(x) + 1 for x in raw)])
        first = np.searchsorted(start, begins[:-1])
        kind = n.astype(np.uint64) << np.uint64(1)
        kind[first] |= np.uint64(1)
        short = np.flatnonzero(n <= 16)
        head, tail = eight[start] & mask, eight[np.maximum(start + n - 8, 0)] >> (np.uint64(64) - (np.minimum(n, 8) << 3).astype(np.uint64)) % np.uint64(64)
        keys = np.stack([head, tail, kind])[:, short]
        at = self.known.find(keys)
        if (at < 0).any():
            new = self._unknown(keys, at)
            if self.known.n + len(new) > MAX_PIECES:
                self.known.clear()
                new = self._unknown(keys, at := np.full(len(at), -1))
            places = short[new]
            self.known.add(keys[:, new], *self._fresh(data, start[places], n[places], keys[2, new] & np.uint64(1) > 0))
            left = np.flatnonzero(at < 0)
            at[left] = self.known.find(keys[:, left])
        # Longer pieces go one by one; their ids stand behind the known ones.
        long = np.flatnonzero(n > 16)
        is_first = (kind[long] & np.uint64(1)).tolist()
        rest = [(self.first if x else self.later)[data[a:b].decode()] for a, b, x in zip(start[long].tolist(), (start + n)[long].tolist(), is_first, strict=True)]
        held = int(self.known.starts[self.known.n])
        pool = np.concatenate([self.known.ids[:held], np.frombuffer(b"".join(rest), "<u4")])
        size, place = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        place[short] = self.known.starts[at]
        size[short] = self.known.starts[at + 1] - place[short]
        size[long] = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        place[long] = held + np.cumsum(size[long]) - size[long]
        ends = np.cumsum(size)
        ids = pool[np.repeat(place - ends + size, size) + np.arange(ends[-1])]
        return ids, ends[np.append(first[1:], len(n)) - 1]

    def _fresh(self, data: bytes, start: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces of data end to end, and how many each has. Words of plain letters, with a sign behind or not, are merged together."""
        found, size, left = [], np.zeros(len(n), np.int64), np.ones(len(n), bool)
        if self.merges:
            raw = np.frombuffer(data, np.uint8)
            sign = raw[start + n - 1]
            signed = _IS_END[sign]
            body = np.where(first, 0, n - signed)
            for length in range(1, int(body.max(initial=0)) + 1):
                who = np.flatnonzero(body == length)
                who = who[_IS_LETTER[raw[start[who] + np.arange(length)[:, None]]].all(0)]
                for i in range(0, len(who), TOGETHER):
                    some = who[i : i + TOGETHER]
                    letters = raw[start[some] + np.arange(-1, length)[:, None]]  # with the space before it
                    for at, ids in self.merges.words(letters):
                        at = some[at]
                        size[at], left[at] = ids.shape[1] + signed[at], False
                        found.append((at, ids))
        rest = np.flatnonzero(left).tolist()
        slow = [self.encode_piece("" if first[i] else " ", data[start[i] : start[i] + n[i]].decode()) for i in rest]
        size[rest] = [len(x) // 4 for x in slow]
        ends = np.cumsum(size)
        out, begins = np.empty(int(ends[-1]), np.uint32), ends - size
        for at, ids in found:
            out[begins[at][:, None] + np.arange(ids.shape[1])] = ids
            behind = at[signed[at]]
            out[ends[behind] - 1] = self.merges.symbol[sign[behind]]
        for i, x in zip(rest, slow, strict=True):
            out[begins[i] : ends[i]] = np.frombuffer(x, "<u4")
        return out, size

    @staticmethod
    def _unknown(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A place of each distinct piece among those that are not known."""
        left = np.flatnonzero(at < 0)
        order = left[np.lexsort(keys[:, left])]
        k = keys[:, order]
        return order[np.append(True, (k[:, 1:] != k[:, :-1]).any(0))]

    def _section(self, text: str) -> bytes:
        """ids of a text that holds no special token"""
        pieces = _CUT.split(text) if self.spaced and any(s in text for s in _TWO) else text.split(" ")
        if not self.spaced:
            return b"".join(map(self.first.__getitem__, pieces))
        return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """One per Python worker and vocabulary."""
    return Bpe(path)


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
