"""BPE encoding and decoding with forced boundaries.

The vocabulary file gives the merges. A pair of neighbouring symbols that occurs inside no vocabulary token can never
end up inside one token, so it marks a certain cut: every word is split at all such pairs, the fragments are encoded
independently (by their merges, lowest rank first) and the ids are concatenated. The fragments of all words that a piece
of texts has and the task does not remember are merged together, in numpy: each round joins in every fragment its pair
of the lowest rank, the leftmost of several. Words are remembered in a table of bounded size.

Text is prepared as the vocabulary asks: special tokens are taken out first as they stand, the rest is put in NFC,
letters are lower-cased, words are taken by pattern, and bytes are written as the vocabulary's printable symbols. Decoding joins the tokens' strings with blanks, as a vocabulary without a decoder does.

Every row is handled alone, so nothing is shuffled; memory follows the size of a piece, or the longest text. Defined
cases: null and empty texts give no ids; texts of any length are encoded whole; repeated rows are encoded each for
itself; an empty table gives an empty table; an id outside the vocabulary decodes to nothing; extra columns stay
untouched, and one that has the name of the new column is an error that says so.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from .common import map_batches, new_names, pieces

#: Words that a task remembers before it starts afresh.
REMEMBER = 120_000
#: Longer fragments are merged by a heap, each for itself; longer words are not remembered.
LONG = 64
#: Words that are merged together.
TOGETHER = 50_000
NONE = (1 << 31) - 1


def _ranges(kind: str, upto: int) -> str:
    """The letters (L) or numbers (N) of Unicode below upto, as ranges for a character class."""
    points = [c for c in range(upto) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for i, c in enumerate(points) if not i or points[i - 1] != c - 1]
    ends = [c for i, c in enumerate(points) if i + 1 == len(points) or points[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


class Joins:
    """A hash table in numpy: pair of ids -> rank and joined id. Slots are tried in a row until one is free."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, ids: np.ndarray):
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.ids = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        left, slot = np.arange(len(pairs)), self.first(pairs)
        while len(left):
            free = self.keys[slot] < 0
            _, own = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[own]
            self.keys[slot[put]], self.ranks[slot[put]], self.ids[slot[put]] = pairs[left[put]], ranks[left[put]], ids[left[put]]
            on = np.ones(len(left), bool)
            on[put] = False
            left, slot = left[on], (slot[on] + 1) & (size - 1)

    def first(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE for pairs that do not join) and joined id."""
        pairs = a.astype(np.int64) << 32 | b
        slot = self.first(pairs)
        at = self.keys[slot]
        left = np.flatnonzero((at != pairs) & (at >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            at = self.keys[slot[left]]
            left = left[(at != pairs[left]) & (at >= 0)]
        return self.ranks[slot], self.ids[slot]


#: Beyond the plane whose character classes Python looks up in one step.
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=2)
def word_pattern(upto: int) -> re.Pattern:
    """What the vocabulary's pre-tokenizer calls a word, in texts of characters below upto: contractions, letters,
    single numbers, other signs."""
    letters, numbers = _ranges("L", upto), _ranges("N", upto)
    space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it prints in Latin-1, else the next free one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary with an end-of-word suffix, as its file describes it. A symbol is a byte, or 256 more at a word's end."""

    def __init__(self, spec: dict):
        model = spec["model"]
        ids: dict[str, int] = dict(model["vocab"])
        end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        symbols = byte_symbols()
        self.first = np.array([*[ids[c] for c in symbols], *[ids[c + end] for c in symbols]], np.int32)
        pairs, made = [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs.append(ids[a] << 32 | ids[b])
            made.append(ids[a + b])
        self.ranked = {p: (rank, new) for rank, (p, new) in enumerate(zip(pairs, made))}
        distinct = np.array(list(self.ranked), np.int64)
        ranks, joined_ids = np.array(list(self.ranked.values()), np.int32).reshape(-1, 2).T
        self.joins = Joins(distinct, ranks, joined_ids)
        self.inside = np.zeros(512 * 512, bool)
        byte_of = {c: b for b, c in enumerate(symbols)}
        for token in ids:
            body = token[: -len(end)] if end and token.endswith(end) and token != end else token
            if all(c in byte_of for c in body):
                parts = [byte_of[c] for c in body]
                if body != token:
                    parts[-1] += 256
                self.inside[[a * 512 + b for a, b in zip(parts, parts[1:])]] = True
        self.specials = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        self.known = dict(self.specials)

    def merge_long(self, parts: list[int]) -> list[int]:
        """The ids of one long fragment: a heap of pairs over a linked list, n log n."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def entry(i: int, j: int):
            found = self.ranked.get(parts[i] << 32 | parts[j])
            return None if found is None else (found[0], i, parts[i], parts[j], found[1])

        heap = [e for i in range(n - 1) if (e := entry(i, i + 1))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (e := entry(x, y)):
                    heapq.heappush(heap, e)
        return [p for p in parts if p >= 0]

    def merge(self, ids: np.ndarray, fragment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids, each with its fragment's number (ascending), after all merges; finished fragments are set aside."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, new = np.full(len(ids), NONE, np.int32), np.zeros(len(ids), np.int32)
        fresh = np.flatnonzero(fragment[1:] == fragment[:-1])
        while True:
            rank[fresh], new[fresh] = self.joins.find(ids[fresh], ids[fresh + 1])
            starts = np.flatnonzero(np.diff(fragment, prepend=-1))
            if not len(starts):
                break
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(ids))
            on = np.repeat(least < NONE, sizes)
            done.append((ids[~on], fragment[~on]))
            ids, fragment, rank, new = ids[on], fragment[on], rank[on], new[on]
            least = np.repeat(least[least < NONE], sizes[least < NONE])
            at = np.flatnonzero(rank == least)
            at = at[np.diff(fragment[at], prepend=-1) != 0]
            ids[at] = new[at]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, fragment, rank, new = ids[stays], fragment[stays], rank[stays], new[stays]
            at -= np.arange(len(at))  # each merge moves what follows by one
            rank[at] = NONE
            fresh = np.concatenate([at[at > 0] - 1, at[at + 1 < len(ids)]])
            fresh = fresh[fragment[fresh] == fragment[fresh + 1]]
        fragment = np.concatenate([f for _, f in done])
        order = np.argsort(fragment, kind="stable")
        return np.concatenate([x for x, _ in done])[order], fragment[order]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Every word's ids, four bytes each: cut where a pair is inside no token, each fragment encoded for itself."""
        if not words:
            return []
        data = [w.encode() for w in words]
        ends = np.cumsum([len(x) for x in data])
        symbols = np.frombuffer(b"".join(data), np.uint8).astype(np.int32)
        symbols[ends - 1] += 256
        cut = np.ones(len(symbols), bool)
        cut[1:] = ~self.inside[symbols[:-1] * 512 + symbols[1:]]
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        fragment = np.cumsum(cut, dtype=np.int32) - 1
        ids, sizes = self.first[symbols], np.diff(starts, append=len(symbols))
        long = sizes >= LONG
        if long.any():
            apart = np.repeat(long, sizes)
            out, of = self.merge(ids[~apart], fragment[~apart])
            more = [self.merge_long(ids[starts[k] : starts[k] + sizes[k]].tolist()) for k in np.flatnonzero(long)]
            of = np.concatenate([of, np.repeat(np.flatnonzero(long), [len(m) for m in more])])
            order = np.argsort(of, kind="stable")
            ids, of = np.concatenate([out, *[np.array(m, np.int32) for m in more]])[order], of[order]
        else:
            ids, of = self.merge(ids, fragment)
        upto = np.searchsorted(of, fragment[ends - 1], side="right") * 4
        flat = ids.astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]

    def words_of(self, text: str | None) -> list[str]:
        """A text's special tokens, and the words of what stands between them."""
        out: list[str] = []
        text, at = text or "", 0
        for m in self.cut_special.finditer(text):
            out += self.plain_words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        out += self.plain_words(text[at:] if at else text)
        return out

    def plain_words(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return word_pattern(0x110000 if ASTRAL.search(text) else 0x10000).findall(lower(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Every text's ids, four bytes each, little-endian."""
        parts = [self.words_of(t) for t in texts]
        new = list(set().union(*parts) - self.known.keys())
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            self.known.update(zip(some, self.encode_words(some)))
        ids = self.known.__getitem__
        out = [b"".join(map(ids, p)) for p in parts]
        if len(self.known) > REMEMBER:
            self.known = dict(self.specials)
        else:
            for w in new:
                if len(w) >= LONG:
                    del self.known[w]
        return out


def lower(text: str) -> str:
    """Lower case letter by letter: no letter's case depends on its neighbours."""
    out = text.lower()
    if "Σ" in text:  # a final capital sigma is the one letter for which str.lower looks around
        out = "σ".join(p.lower() for p in text.split("Σ"))
    return out


@lru_cache(maxsize=4)
def token_strings(path: str) -> pa.Array:
    """What decoding needs: the string of every id, null where there is none."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.array([of.get(i) for i in range(max(of) + 1)], pa.string())


def joined(tokens: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The token strings of runs of ids of the given sizes, joined with blanks; ids without a string are left out."""
    known = ids < len(tokens)
    if tokens.null_count:
        known[known] = tokens.is_valid().to_numpy(zero_copy_only=False)[ids[known]]
    ends = np.cumsum(sizes)
    if not known.all():
        ends, ids = np.concatenate([[0], np.cumsum(known)])[ends], ids[known]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), tokens.take(pa.array(ids.astype(np.int64))))
    return pc.binary_join(lists, " ")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


def encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids", packed: bool = False) -> DataFrame:
    """df with out_col, the text's token ids, in place of text_col. path: the vocabulary's place on every machine.

    packed: ids as binary, four bytes each, little-endian and unsigned, instead of an array of ints.
    """
    rest = [c for c in df.columns if c != text_col]
    new_names(rest, out_col)
    kind = BinaryType() if packed else ArrayType(IntegerType(), False)
    schema = StructType([*[df.schema[c] for c in rest], StructField(out_col, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in pieces(batches, len(rest)):
            ids = v.encode(b.column(len(rest)).to_pylist())
            out = pa.array(ids, pa.binary()) if packed else pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], out], names=schema.names)

    return map_batches(df.select(*[f"`{c}`" for c in rest], text_col), run, schema)


def joined_lists(tokens: pa.Array, ids: list[np.ndarray]) -> pa.Array:
    return joined(tokens, np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64))


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """encode() to packed ids and decode() of these in one go: df with ids_col and decoded_col in place of text_col."""
    rest = [c for c in df.columns if c != text_col]
    new_names(rest, ids_col, decoded_col)
    schema = StructType([*[df.schema[c] for c in rest], StructField(ids_col, BinaryType()), StructField(decoded_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, tokens = vocabulary(path), token_strings(path)
        for b in pieces(batches, len(rest)):
            ids = v.encode(b.column(len(rest)).to_pylist())
            texts = joined_lists(tokens, [np.frombuffer(x, "<u4") for x in ids])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(ids, pa.binary()), texts], names=schema.names)

    return map_batches(df.select(*[f"`{c}`" for c in rest], text_col), run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col, the text that the ids (an array, or packed) stand for; null ids decode to null."""
    new_names(df.columns, out_col)
    schema = StructType([*df.schema.fields, StructField(out_col, StringType())])
    packed, at = isinstance(df.schema[ids_col].dataType, BinaryType), df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_strings(path)
        for b in pieces(batches, at) if packed else batches:
            column = b.column(at)
            rows = column.to_pylist()
            flat = [np.zeros(0, np.uint32) if x is None else np.frombuffer(x, "<u4") if packed else np.array(x, np.uint32) for x in rows]
            texts = joined_lists(tokens, flat)
            texts = pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=schema.names)

    return map_batches(df, run, schema)
