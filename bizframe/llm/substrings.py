"""Removal of repeated byte strings by the anchors of a sparse suffix array, put into buckets and refined by fingerprints.

The dealt bucket-pointer refinement is kept in part only: a bucket is refined by fingerprints of what stands at later
offsets, made where the text is, and no round writes bucket identifiers back for others to use (the README says why).

Every byte covered by a `LENGTH`-byte string that also starts earlier (a smaller id, or earlier in the same document) is
removed. Suffixes are sorted into buckets step by step, and only what shares a bucket goes on:

0. Initial buckets: the `GRAM`-byte gram at a suffix. Of all suffixes only anchors are sorted: in every string of LENGTH
   bytes the (leftmost) gram of the smallest identifier, which equal strings share at the same offset, so no repeat is
   missed. An anchor stands for the run of strings that chose it.
1. Each bucket is refined by the identifier of its whole run of strings. All anchors of a refined bucket but the first
   repeat entirely; anchors alone in their bucket are done. One anchor of every refined bucket of a bucket that has
   several goes on, if its left or its right side still meets another's (a LENGTH-byte repeat reaches over one of them).
2. Their strings are refined one by one by fingerprints that are put together from those of their parts, doubling: 25
   bytes, then 50 of two of 25, then 100 of two of 50. All of a refined bucket but the first are repeats.

Bucket identifiers are 64-bit fingerprints in place of ranks, so buckets of all documents agree without a global
renaming, and a bucket is always told apart by its gram and its refinement together (128 bits).

Shuffles carry identifiers and positions; a task first sends only the earliest of its own equal strings and reports the
others as repeats, so a passage that a third of all documents share costs a few rows a task. Texts are shuffled once, by
id, to meet the positions found.

Defined cases: null text counts as empty; texts shorter than LENGTH lose nothing; a null id stays whole and takes no
part; rows repeated under one id are one document and do not repeat each other; an empty table gives an empty table; ids
are integers; a text longer than a block is a block of its own; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .shingles import BASE, mixed, odd_constants, powers

LENGTH, GRAM = 100, 25
BLOCK = 2 << 20
TAG = 511


def leftmost_least(v: np.ndarray, w: int) -> np.ndarray:
    """For every window of w values the index of its leftmost least value."""
    at, size = np.arange(len(v), dtype=np.int32), 1
    while size * 2 <= w:
        left = v[:-size] <= v[size:]
        at, v, size = np.where(left, at[:-size], at[size:]), np.where(left, v[:-size], v[size:]), size * 2
    if w > size:
        rest = w - size
        at = np.where(v[:-rest] <= v[rest:], at[:-rest], at[rest:])
    return at


class Grams:
    """Fingerprints of any part of one run of bytes."""

    def __init__(self, data: bytes):
        flat = np.frombuffer(data, np.uint8)
        self.size = len(flat)
        power = powers(BASE, self.size + 1)
        self.back = powers(pow(BASE, -1, 1 << 64), self.size + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * power[: self.size], dtype=np.uint64)])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * self.back[: self.size - size + 1])


def anchors(data: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of a block of texts: text, position in it, first and last string (relative to it), bucket, refinement, side tags."""
    lens = np.array([len(x) for x in data], np.int64)
    ends = np.cumsum(lens)
    g = Grams(b"".join(data))
    if g.size < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    gram = g.all(GRAM)
    least = leftmost_least(gram, LENGTH - GRAM + 1)
    text = np.repeat(np.arange(len(data)), lens)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[text])
    anchor = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    first, last, p = start[at], start[np.append(at[1:], len(start))[: len(at)] - 1], anchor[at].astype(np.int64)
    text = text[first]
    bucket = gram[p]
    run = mixed(g.part(first, last + LENGTH) ^ ((p - first) * 128 + (last - first)).astype(np.uint64))
    side = (LENGTH - GRAM) // 2
    left = g.part(np.maximum(p - side, (ends - lens)[text]), p + GRAM)
    right = g.part(p, np.minimum(p + GRAM + side + 1, ends[text]))
    tags = (left & np.uint64(TAG)) << np.uint64(9) | (right & np.uint64(TAG))
    base = (ends - lens)[text]
    return text, p - base, p - first, last - first, bucket, run, tags


def packed(p: np.ndarray, back: np.ndarray, more: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """One long: position, bytes back to the first string, strings after it, side tags. Orders by position."""
    return p << 32 | back << 25 | more << 18 | tags.astype(np.int64)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, ...]:
    return at >> 32, at >> 25 & 127, at >> 18 & 127, at >> 9 & TAG, at & TAG


def run_starts(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def later_ones(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows sorted by keys, doc, at: those that are not at the first place of their key."""
    new = run_starts(*keys)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, np.int64)
    return (doc != doc[first]) | (at >> 32 != at[first] >> 32)


def text_blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    run: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        x = (t or "").encode()
        if run and size + len(x) > BLOCK:
            yield first, run
            run, size, first = [], 0, i
        run.append(x)
        size += len(x)
    if run:
        yield first, run


KEYED = "bucket long, part long, id long, at long, known boolean"


def combined(bucket: np.ndarray, part: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The rows a task sends. Those that repeat an earlier one of the same task are known repeats, dealt anywhere."""
    order = np.lexsort((at, doc, part, bucket))
    bucket, part, doc, at = bucket[order], part[order], doc[order], at[order]
    known = later_ones((bucket, part), doc, at)
    bucket = np.where(known, mixed((doc << 20 ^ at).view(np.uint64)), bucket)
    part = np.where(known, np.uint64(0), part)
    arrays = [pa.array(bucket.view(np.int64)), pa.array(part.view(np.int64)), pa.array(doc), pa.array(at), pa.array(known)]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "part", "id", "at", "known"])


def find_anchors(docs: DataFrame) -> DataFrame:
    """docs: id, text. The anchors of all texts, as KEYED rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            for first, data in text_blocks(b.column(1).to_pylist()):
                text, p, back, more, bucket, part, tags = anchors(data)
                if len(p):
                    yield combined(bucket, part, ids[first + text], packed(p, back, more, tags))

    return map_batches(docs, run, KEYED)


def in_buckets(rows: DataFrame, keys: list[str], found: Callable[..., pa.RecordBatch | None], schema: str) -> DataFrame:
    """found(bucket, part, id, at, known) over all rows of a key in order, as many keys together as an Arrow batch holds.
    keys: bucket, or bucket and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [np.asarray(b.column(i)) for i in range(4)] + [np.asarray(b.column(4).cast(pa.int8())) == 1]
            cols = cols if held is None else [np.concatenate([x, y]) for x, y in zip(held, cols)]
            cut = int(np.flatnonzero(run_starts(*cols[: len(keys)]))[-1]) if len(cols[0]) else 0
            held = [c[cut:] for c in cols]
            if cut and (out := found(*[c[:cut] for c in cols])) is not None:
                yield out
        if held is not None and len(held[0]) and (out := found(*held)) is not None:
            yield out

    return map_batches(rows.repartition(*keys).sortWithinPartitions("bucket", "part", "id", "at"), run, schema)


PLACES = "id long, bucket long, at long, known boolean"


def refine_runs(bucket: np.ndarray, part: np.ndarray, doc: np.ndarray, at: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Step 1 over whole buckets: repeats (known), and what goes on to step 2."""
    repeats = known | later_ones((bucket, part), doc, at)
    firsts = run_starts(bucket, part) & ~known
    new = run_starts(bucket)
    group = np.cumsum(new) - 1
    several = np.bincount(group, firsts, len(np.flatnonzero(new)))[group] >= 2
    on = np.flatnonzero(firsts & several)
    if len(on):
        _, _, _, left, right = unpacked(at[on])
        meets = np.zeros(len(on), bool)
        for tag in (left, right):
            _, which, count = np.unique(group[on] * (TAG + 1) + tag, return_inverse=True, return_counts=True)
            meets |= count[which] >= 2
        on = on[meets]
    pick = np.concatenate([np.flatnonzero(repeats), on])
    is_known = np.arange(len(pick)) < len(pick) - len(on)
    arrays = [pa.array(doc[pick]), pa.array(bucket[pick]), pa.array(at[pick]), pa.array(is_known)]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "bucket", "at", "known"])


def refine_strings(bucket: np.ndarray, part: np.ndarray, doc: np.ndarray, at: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Step 2 over whole buckets: the strings that repeat."""
    pick = known | later_ones((bucket, part), doc, at)
    n = int(pick.sum())
    arrays = [pa.array(doc[pick]), pa.array(bucket[pick]), pa.array(at[pick]), pa.array(np.ones(n, bool))]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "bucket", "at", "known"])


def doubled(g: Grams, start: np.ndarray) -> np.ndarray:
    """Identifiers of LENGTH bytes from those of a quarter: pointers to later offsets, twice."""
    near, far = odd_constants(2)
    size, ids = GRAM, g.part(start[:, None] + np.arange(0, LENGTH, GRAM), start[:, None] + np.arange(GRAM, LENGTH + 1, GRAM))
    while size < LENGTH:
        ids, size = mixed(ids[:, 0::2] * near + ids[:, 1::2] * far), size * 2
    return ids[:, 0]


def find_strings(docs: DataFrame, going: DataFrame) -> DataFrame:
    """The strings of the anchors that go on, as KEYED rows. going: id, places (bucket and packed position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, places = b.column(0).to_pylist(), b.column(2)
            got: list[tuple[np.ndarray, ...]] = []
            for i, text in enumerate(b.column(1).to_pylist()):
                rows = places[i].values
                bucket, at = np.asarray(rows.field("bucket")).view(np.uint64), np.asarray(rows.field("at"))
                p, back, more, _, _ = unpacked(at)
                n = more + 1
                of = np.repeat(np.arange(len(p)), n)
                start = (p - back)[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                ids100 = mixed(doubled(Grams((text or "").encode()), start) + (p[of] - start).astype(np.uint64))
                got.append((bucket[of], ids100, np.full(len(of), ids[i]), start << 32))
            if got:
                yield combined(*[np.concatenate(x) for x in zip(*got)])

    return map_batches(docs.join(going, "id").select("id", "text", "places"), run, KEYED)


def repeats(docs: DataFrame) -> DataFrame:
    """id, ranges: for each document with repeats, the starts and ends of runs of repeated strings, one long each."""
    places = materialize(in_buckets(find_anchors(docs), ["bucket"], refine_runs, PLACES), "places")
    going = places.where("not known").groupBy("id").agg(F.collect_list(F.struct("bucket", "at")).alias("places"))
    strings = in_buckets(find_strings(docs, going), ["bucket", "part"], refine_strings, PLACES)
    first = F.shiftright("at", 32) - F.shiftright("at", 25).bitwiseAND(127)
    last = first + F.shiftright("at", 18).bitwiseAND(127)
    ranges = places.where("known").unionByName(strings).select("id", (F.shiftleft(first, 32) + last + LENGTH).alias("range"))
    return ranges.groupBy("id").agg(F.collect_list("range").alias("ranges"))


def merged(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs (starts, ends) of the ranges; runs that touch are one."""
    order = np.sort(ranges)
    start, end = order >> 32, np.maximum.accumulate(order & 0xFFFFFFFF)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay; a cut may split a character)."""
    # an alias of a column to its own name would keep Spark from shuffling the texts once for both joins
    text = F.col("text") if text_col == "text" else F.col(text_col).alias("text")
    named = df.select(F.col(id_col).cast("long").alias("id"), text)
    docs = named.where("id is not null")
    rows = docs.join(repeats(docs), "id", "left").select("id", "text", "ranges")
    rows = rows.unionByName(named.where("id is null").select("id", "text", F.lit(None).cast("array<long>").alias("ranges")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, spans, kept = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                data = (text or "").encode()
                cell = b.column(2)[i]
                start = end = np.zeros(0, np.int64)
                if cell.is_valid and len(cell.values):
                    start, end = merged(np.asarray(cell.values))
                edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(data)]
                kept.append(b"".join([data[a:z] for a, z in zip(edges[0::2], edges[1::2])]))
                size.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                spans.append(len(start))
            arrays = [b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = map_batches(rows, run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
