"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes, by DuckDB in every task.

Two tokenizers read a space and the text. Where a space follows something that is no white space both end a token, so a
text is a row of words that align each for itself, and a process aligns a word once however often it stands there. The new
words of a batch become interval tables (start, end, id) of either side, laid one behind the other; DuckDB finds where both
end (an as-of join), numbers A's groups by a window sum of these cuts, brings B's tokens in by a range join with the
groups' spans, and pairs the ids of a group with the number of their occurrences.

Every text is written with its distinct pairs. How many documents hold a pair is counted from these per task and merged in
Spark; then each text's pairs are looked up in the counts, which are broadcast while they are no more than `most` rows as
counted (the vocabularies bound them, at 17 bytes a row). Beyond that pairs and counts are joined in Spark, with frequent
pairs dealt over several tasks.

Memory: a batch of texts, the words that a process keeps from task to task (at KEEP words those seen once go), and DuckDB's tables of a batch's new words. A text
without a space is one word and meets whole.

Defined cases: a text that is null, empty, or whose tokens of either side do not join to its bytes has no tokens, zeros and
an empty digest; repeated rows are documents each for itself; an empty table gives an empty table; a text of any length is
read whole; ties for an A id's highest count all are best; of extra columns those in keep stay, and one with the name of
a new column is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, map_batches, materialize, materialize_counted, new_names, pieces

#: Words a task keeps aligned; pairs whose counts are broadcast; parts over which a frequent pair is dealt.
KEEP, MOST, DEAL = 400_000, 3_000_000, 32
#: Pair counts a task holds before it passes them on.
HOLD = 1_500_000
#: Words end where a space follows what is no white space.
CUT = re.compile(r"(?<=\S)(?= )")
UNEVEN = re.compile(r"\s ")
BORDER = re.compile(r"\s | \s|^\s|\s$")
#: New words that are encoded in one text.
TOGETHER = 2_000

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def words_of(text: str) -> list[str]:
    """The words of a space and the text, each without the space it begins with."""
    spaced = " " + text
    if UNEVEN.search(spaced):
        return [w[1:] for w in CUT.split(spaced)]
    return text.split(" ")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: the printable ones of Latin-1 stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level BPE of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        byte = _byte_of()
        self.bytes = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch([" " + w for w in words], add_special_tokens=False)]


class Pieces:
    """Side B: a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.size = len(names)
        self.space = self.library.piece_to_id("▁")
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece holds a space behind another character: words can't be aligned each for itself")

    def encode(self, words: list[str]) -> list[list[int]]:
        # no word at all encodes to nothing, though the space is there
        return [ids or [self.space] for ids in self.library.encode(words, num_threads=1)]


#: Groups and links of two interval tables that cover the same bytes.
CUTS = """
CREATE OR REPLACE TEMP TABLE cut AS
SELECT a.s, a.e, a.id, coalesce(sum(CASE WHEN a.e = b.e THEN 1 ELSE 0 END) OVER (ORDER BY a.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grp
FROM a ASOF LEFT JOIN b ON a.e >= b.e
"""
SPANS = "CREATE OR REPLACE TEMP TABLE span AS SELECT grp, min(s) AS s, max(e) AS e FROM cut GROUP BY grp"
INSIDE = "CREATE OR REPLACE TEMP TABLE inside AS SELECT b.s, b.id, span.grp FROM b JOIN span ON b.s >= span.s AND b.e <= span.e"
LINKS = """
SELECT grp, x.id AS a, y.id AS b, x.n * y.n AS n
FROM (SELECT grp, id, count(*) AS n FROM cut GROUP BY grp, id) x JOIN (SELECT grp, id, count(*) AS n FROM inside GROUP BY grp, id) y USING (grp) ORDER BY grp
"""


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Aligner:
    """Words, aligned as they come: numbers of tokens, groups and links by word, the words' pairs and their groups as text."""

    def __init__(self, a: ByteLevel, b: Pieces):
        import duckdb

        self.sides = a, b
        self.width, self.top = len(b.bytes), len(a.bytes) * len(b.bytes)
        self.sizes_of = [np.array([len(x) for x in side.bytes]) for side in self.sides]
        # ids as text with what follows them: another of the side, or the end of the side's part of a group
        self.text_of = [[f"{i}{c}".encode() for i in range(len(side.bytes)) for c in (",", end)] for side, end in zip(self.sides, "|;")]
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.number = _Numbers()
        self.good, self.seen = np.zeros(0, bool), np.zeros(0, np.int64)
        self.sizes = np.zeros((0, 4), np.int64)
        self.ids: list[bytes] = []
        self.first = np.zeros(1, np.int64)
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers, which hold until the next call; new words are aligned."""
        if len(self.number) > KEEP:
            self._forget()
        known = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > known:
            self._align(list(islice(self.number, known, None)))
        self.seen += np.bincount(out, minlength=len(self.seen))
        return out

    def _forget(self) -> None:
        """Gives up the words that came once only, and all where that leaves too many."""
        kept = np.flatnonzero(self.seen > 1)
        kept = kept if len(kept) < KEEP / 2 else kept[:0]
        words = list(self.number)
        self.number = _Numbers()
        for k in kept.tolist():
            self.number[words[k]]
        many, at = self.spread(kept)
        self.pair, self.times = self.pair[at], self.times[at]
        self.first = np.append(0, np.cumsum(many))
        self.good, self.sizes, self.seen = self.good[kept], self.sizes[kept], np.zeros(len(kept), np.int64)
        self.ids = [self.ids[k] for k in kept.tolist()]

    def _encoded(self, words: list[str], sizes: np.ndarray, runs: list[tuple[int, int, str]], alone: list[int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Side k's ids of all words in order, how many each has, and whether they join to its bytes.

        sizes: bytes of the words with their spaces; runs: first, end and text of words that are encoded as one text; the
        words in alone are encoded each for itself, as are those of a run that does not join to its bytes."""
        side, of_id = self.sides[k], self.sizes_of[k]
        many, good = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        parts: list[tuple[int, np.ndarray]] = []
        alone = list(alone)
        for (first, end, text), got in zip(runs, side.encode([t for _, _, t in runs])):
            if b"".join(map(side.bytes.__getitem__, got)) != b" " + text.encode():
                alone += range(first, end)
                continue
            flat = np.array(got)
            to = np.searchsorted(np.cumsum(of_id[flat]), np.cumsum(sizes[first:end]))
            many[first:end] = np.diff(to, prepend=-1)
            good[first:end] = True
            parts.append((first, flat))
        for n, got in zip(alone, side.encode([words[n] for n in alone])):
            many[n], good[n] = len(got), b"".join(map(side.bytes.__getitem__, got)) == b" " + words[n].encode()
            parts.append((n, np.array(got)))
        parts.sort(key=lambda x: x[0])
        return np.concatenate([x for _, x in parts]), many, good

    @staticmethod
    def _runs(words: list[str]) -> tuple[list[tuple[int, int, str]], list[int]]:
        """Runs of words that stand in one text as they are, and the words that don't."""
        runs, alone = [], []
        for first in range(0, len(words), TOGETHER):
            own = words[first : first + TOGETHER]
            text = " ".join(own)
            if own[0] and own[-1] and not BORDER.search(text):
                runs.append((first, first + len(own), text))
                continue
            start = first
            for n in range(first, first + len(own) + 1):
                if n == first + len(own) or not words[n] or words[n][0].isspace() or words[n][-1].isspace():
                    if n > start:
                        runs.append((start, n, " ".join(words[start:n])))
                    if n < first + len(own):
                        alone.append(n)
                    start = n + 1
        return runs, alone

    def _align(self, words: list[str]) -> None:
        runs, alone = self._runs(words)
        long = np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1
        (flat_a, many_a, good_a), (flat_b, many_b, good_b) = (self._encoded(words, long, runs, alone, k) for k in (0, 1))
        good = good_a & good_b
        flat_a, flat_b = flat_a[np.repeat(good, many_a)], flat_b[np.repeat(good, many_b)]
        many_a, many_b = many_a * good, many_b * good
        sizes = np.zeros((len(words), 4), np.int64)
        names, counts = [b""] * len(words), np.zeros(len(words), np.int64)
        if len(flat_a):
            ends = [np.cumsum(size[flat]) for size, flat in zip(self.sizes_of, (flat_a, flat_b))]
            for name, e, flat in zip("ab", ends, (flat_a, flat_b)):
                self.duck.register(name, pa.table({"s": np.append(0, e[:-1]), "e": e, "id": flat}))
            for sql in (CUTS, SPANS, INSIDE):
                self.duck.execute(sql)
            group_a, group_b = (self.duck.sql(f"SELECT grp FROM {t} ORDER BY s").to_arrow_table()["grp"].to_numpy() for t in ("cut", "inside"))
            links = self.duck.sql(LINKS).to_arrow_table()
            word_of = np.repeat(np.arange(len(words)), many_a)[np.searchsorted(group_a, np.arange(group_a[-1] + 1))]
            in_word = np.bincount(word_of, minlength=len(words))
            of, times = word_of[links["grp"].to_numpy()], links["n"].to_numpy()
            counts = np.bincount(of, minlength=len(words))
            sizes = np.column_stack([many_a, many_b, in_word, np.bincount(of, times, len(words)).astype(np.int64)])
            names = self._names(group_a, group_b, flat_a, flat_b, many_a + many_b)
            self.pair = np.append(self.pair, links["a"].to_numpy() * self.width + links["b"].to_numpy())
            self.times = np.append(self.times, times)
        self.good, self.seen = np.append(self.good, good), np.append(self.seen, np.zeros(len(words), np.int64))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids += names
        self.first = np.append(self.first, self.first[-1] + np.cumsum(counts))

    def _names(self, group_a: np.ndarray, group_b: np.ndarray, flat_a: np.ndarray, flat_b: np.ndarray, many: np.ndarray) -> list[bytes]:
        """The groups of each word as text, without the mark at the end."""
        last = [np.diff(g, append=-1) != 0 for g in (group_a, group_b)]
        parts = [list(map(t.__getitem__, (2 * flat + end).tolist())) for t, flat, end in zip(self.text_of, (flat_a, flat_b), last)]
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        both = parts[0] + parts[1]
        texts = [both[k] for k in order.tolist()]
        ends = np.cumsum(many).tolist()
        return [b"".join(texts[first:end])[:-1] for first, end in zip([0, *ends], ends)]

    def spread(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many pairs the words have, and the places of all."""
        many = self.first[numbers + 1] - self.first[numbers]
        return many, np.repeat(self.first[numbers] - (np.cumsum(many) - many), many) + np.arange(many.sum())


@lru_cache(maxsize=1)
def aligner_of(a: str, b: str) -> Aligner:
    """The aligner of a process: its tasks share the words."""
    return Aligner(ByteLevel(a), Pieces(b))


class Texts:
    """A batch of texts as numbers of words: owner is a word's text; texts whose bytes do not return have no words."""

    def __init__(self, aligner: Aligner, texts: list[str | None]):
        words = [words_of(t) if t else [] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        numbers = aligner.numbers(list(chain.from_iterable(words)))
        bad = np.zeros(len(texts), bool)
        bad[owner[~aligner.good[numbers]]] = True
        keep = ~bad[owner]
        self.n, self.numbers, self.owner, self.aligner = len(texts), numbers[keep], owner[keep], aligner

    def sums(self, by_word: np.ndarray) -> np.ndarray:
        """Sums over the words of each text of integers by word, exact in 64 bits."""
        out = np.zeros(self.n, np.int64)
        if len(self.owner):
            starts = np.flatnonzero(np.diff(self.owner, prepend=-1))
            out[self.owner[starts]] = np.add.reduceat(by_word[self.numbers], starts)
        return out

    def digests(self) -> list[str]:
        out = [""] * self.n
        edges = [*np.flatnonzero(np.diff(self.owner, prepend=-1)).tolist(), len(self.owner)]
        for first, end in zip(edges, edges[1:]):
            out[self.owner[first]] = sha256(b";".join(map(self.aligner.ids.__getitem__, self.numbers[first:end].tolist()))).hexdigest()
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's pairs begin and the last ends, the distinct pairs in order, and their occurrences."""
        size = len(self.aligner.number)
        keys, times = np.unique(self.owner * size + self.numbers, return_counts=True)
        many, at = self.aligner.spread(keys % max(1, size))
        owner, pair, n = np.repeat(keys // max(1, size), many), self.aligner.pair[at], self.aligner.times[at] * np.repeat(times, many)
        order = np.argsort(owner * self.aligner.top + pair)
        owner, pair, n = owner[order], pair[order], n[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(new)
        return np.searchsorted(owner[starts], np.arange(self.n + 1)), pair[starts], np.add.reduceat(n, starts) if len(starts) else n


def align_texts(df: DataFrame, a: str, b: str, text_col: str, keep: list[str]) -> DataFrame:
    """The columns in keep with n_a, n_b, n_groups, n_links, groups_sha256, and the text's distinct pairs with occurrences."""
    schema = StructType([*[df.schema[c] for c in keep], *StructType.fromDDL("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, __pairs array<bigint>, __times array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(a, b)
        for batch in pieces(batches, text_col):
            texts = Texts(aligner, batch.column(text_col).to_pylist())
            ends, *lists = texts.pairs()
            arrays = [pa.ListArray.from_arrays(ends.astype(np.int32), x) for x in lists]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(texts.sums(x)) for x in aligner.sizes.T], pa.array(texts.digests(), pa.string()), *arrays], names=schema.names)

    return map_batches(df.select(*dict.fromkeys([*keep, text_col])), run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many rows hold the pair linked; pair is A's id times the size of B's vocabulary plus B's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, times = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            both = np.append(held, keys)
            held, at = np.unique(both, return_inverse=True)
            count = np.bincount(at, np.append(count, times), len(held)).astype(np.int64)
            if len(held) > HOLD:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(count)], names=["pair", "n"])
                held, count = held[:0], count[:0]
        for at in range(0, len(held), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(held[at : at + (1 << 18)]), pa.array(count[at : at + (1 << 18)])], names=["pair", "n"])

    return map_batches(aligned.select("__pairs"), run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def align(df: DataFrame, a: str, b: str, text_col: str = "text", keep: list[str] | None = None, most: int = MOST) -> DataFrame:
    """The columns in keep (all by default) with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a: file of a byte-level vocabulary of the tokenizers library; b: a sentencepiece model. Both paths are read by the
    driver and by every machine."""
    keep = df.columns if keep is None else keep
    new_names(keep, *COLUMNS, "n_best", "count_sum", "__pairs", "__times")
    aligned = materialize(align_texts(df, a, b, text_col, keep), "aligned")
    counts, n = materialize_counted(pair_counts(aligned), "pair-counts")
    width = Pieces(b).size
    out = [*keep, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if n > most:
        return _joined(aligned, counts, width).select(*[F.col(f"`{c}`") for c in out])
    table = counts.toArrow().sort_by("pair")
    pair, count = table["pair"].to_numpy(), table["n"].to_numpy()
    discard(counts)
    side = pair // width
    starts = np.flatnonzero(np.diff(side, prepend=-1))
    top = np.repeat(np.maximum.reduceat(count, starts), np.diff(np.append(starts, len(side)))) if len(pair) else count
    known = df.sparkSession.sparkContext.broadcast((pair, count, count == top))
    schema = StructType([*[f for f in aligned.schema if not f.name.startswith("__") or f.name in keep], *StructType.fromDDL("n_best bigint, count_sum bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = known.value
        for batch in batches:
            pairs, times = batch.column("__pairs"), batch.column("__times").flatten().to_numpy()
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            ends = np.append(0, np.cumsum(pc.list_value_length(pairs).to_numpy(zero_copy_only=False)))
            sums = [np.diff(np.append(0, np.cumsum(times * x[at]))[ends]) for x in (best, count)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-2]], *map(pa.array, sums)], names=schema.names)

    return map_batches(aligned, run, schema).select(*[F.col(f"`{c}`") for c in out])


def _joined(aligned: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """The sums where the counts are too many to broadcast: texts' pairs meet their counts in Spark.

    Texts are told apart by their groups: equal groups have equal pairs."""
    top = counts.withColumn("__best", F.col("n") == F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / width))))
    dealt = top.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    deal = F.pmod(F.xxhash64("groups_sha256"), F.lit(DEAL)).cast("int").alias("__deal")
    both = F.arrays_zip(F.col("__pairs").alias("pair"), F.col("__times").alias("times"))
    once = aligned.select("groups_sha256", "__pairs", "__times").dropDuplicates(["groups_sha256"])
    found = once.select("groups_sha256", deal, F.inline(both)).join(dealt, ["pair", "__deal"])
    sums = found.groupBy("groups_sha256").agg(F.sum(F.when(F.col("__best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return aligned.join(sums, "groups_sha256", "left").withColumns({c: zero(c) for c in ("n_best", "count_sum")})
