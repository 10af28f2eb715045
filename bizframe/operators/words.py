"""Two streams of a page's words, native and recognised, aligned by boxes, by text and by order.

A row is a page, as layouts come: native: array of (n, text, left, top, width, height), words: array of (m, and the same); n and
m are positions in reading order. First, words whose boxes overlap by at least `least` (intersection over union, 0.5 or more) and
are each other's best are paired. Such boxes hold each other's centres, so a recognised word is looked up by the cell of its
centre among the cells that native boxes cover; a page's cells are as large as two of its mean boxes, so few words share one.
What is left lies between paired neighbours: there the k-th word of a text is paired with the k-th of that text, and then, where as many are left on both
sides, the k-th with the k-th.

A page stays where it is: nothing is shuffled (pages_of() gathers words that come as rows). Batches are bounded in bytes and cut
into runs of about WORDS words, over which numpy works; a page is the least that is read together.

Defined cases: ties in overlap go to the earlier words; pairs that cross (columns read in another order) stay pairs, and a gap
is named by the native word before it; a null box is no box; null texts are paired by boxes and order; words repeated under one
position count once; words without a position are left out; a null or empty side leaves the other alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Words that numpy works on together, and bytes of an Arrow batch where the session sets no bound.
WORDS, BATCH = 100_000, 4 << 20
BOX = ("left", "top", "width", "height")
PAIRED = "n long, native_text string, m long, word_text string, how string, overlap double, gap long"
HOW = np.array(["box", "text", "order", "native", "recognised"])


class Stream:
    """One side of a run of pages: page, pos, text and box of each word, by page and position."""

    def __init__(self, lists: pa.Array):
        kind, lists = lists.type, pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
        flat = lists.flatten()
        page = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        pos = flat.field(0)
        known = pos.is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(known)
        value = pc.fill_null(pos.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        if len(at) and not np.all((np.diff(page[at]) > 0) | (np.diff(value[at]) >= 0)):  # lists are mostly in order
            at = at[np.lexsort((value[at], page[at]))]
        again = np.zeros(len(at), bool)
        again[1:] = (page[at][1:] == page[at][:-1]) & (value[at][1:] == value[at][:-1])
        at = at[~again]
        self.page, self.pos = page[at], value[at]
        self.text = flat.field(1).take(pa.array(at))
        names = [kind.value_type.field(i).name for i in range(kind.value_type.num_fields)]
        self.box = np.stack([flat.field(names.index(c)).cast(pa.float64()).take(pa.array(at)).to_numpy(zero_copy_only=False) for c in BOX]).astype(np.float64)
        self.boxed = np.isfinite(self.box).all(0) & (self.box[2] > 0) & (self.box[3] > 0)
        self.mate = np.full(len(at), -1)

    def before(self, natives: np.ndarray) -> np.ndarray:
        """For every word the native word of the pair before it in its page, else a number below 0 of the page's own."""
        seen = np.where(self.mate >= 0, np.arange(len(self.mate)), -1)
        last = np.maximum.accumulate(np.concatenate([[-1], seen[:-1]])) if len(seen) else seen
        inside = last >= np.searchsorted(self.page, self.page)
        return np.where(inside, natives[np.maximum(last, 0)], -1 - self.page) if len(seen) else seen


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows repeated count times, and first, first + 1, ... of each."""
    row = np.repeat(np.arange(len(count)), count)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _by_boxes(a: Stream, b: Stream, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a and of b that are each other's best, and how much they overlap."""
    ia, ib = np.flatnonzero(a.boxed), np.flatnonzero(b.boxed)
    if not len(ia) or not len(ib):
        return np.array([], int), np.array([], int), np.array([])
    page, n_pages = a.page[ia], int(max(a.page[-1], b.page[-1])) + 1
    count = np.maximum(np.bincount(page, minlength=n_pages), 1)
    covered, centres = [], []
    row, key_a, key_b = np.arange(len(ia)), page, b.page[ib]
    for at, size in ((0, 2), (1, 3)):
        lengths = a.box[size, ia]
        widest = np.zeros(n_pages)
        np.maximum.at(widest, page, lengths)
        cell = np.maximum(np.maximum(2 * np.bincount(page, lengths, n_pages) / count, widest / 64), 1e-9)
        low, high = (np.floor(x / cell[page]) for x in (a.box[at, ia], a.box[at, ia] + lengths))
        covered.append((low, (high - low + 1).astype(np.int64)))
        centres.append(np.floor((b.box[at, ib] + b.box[size, ib] / 2) / cell[b.page[ib]]))
    for (low, n), centre in zip(covered, centres):
        times, cell = _spread(low[row], n[row])
        row, key_a = row[times], key_a[times]
        # the number of a (key so far, cell), by its place in the grid, or by rank where the grid is too large to count
        cell, so_far = np.concatenate([cell, centre]), np.concatenate([key_a, key_b])
        low, span = cell.min(), cell.max() - cell.min() + 1
        if (so_far.max() + 1) * span < 2.0**62:
            both = so_far * int(span) + (cell - low).astype(np.int64)
        else:
            ranks = np.unique(cell, return_inverse=True)[1]
            both = np.unique(so_far * (ranks.max() + 1) + ranks, return_inverse=True)[1]
        key_a, key_b = both[: len(key_a)], both[len(key_a) :]
    order = np.argsort(key_a, kind="stable")
    key_a, row = key_a[order], row[order]
    first = np.searchsorted(key_a, key_b)
    j, at = _spread(first, np.searchsorted(key_a, key_b, "right") - first)
    i, j = ia[row[at]], ib[j]
    x, y = a.box[:, i], b.box[:, j]
    both = np.ones(len(i))
    for at, size in ((0, 2), (1, 3)):
        both *= np.maximum(0, np.minimum(x[at] + x[size], y[at] + y[size]) - np.maximum(x[at], y[at]))
    overlap = both / (x[2] * x[3] + y[2] * y[3] - both)
    good = overlap >= least
    i, j, overlap = i[good], j[good], overlap[good]

    if len(i) and np.bincount(i).max() == 1 == np.bincount(j).max():  # no word has a choice
        return i, j, overlap

    def best(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        by = np.lexsort((other, -overlap, own))
        out = np.zeros(len(own), bool)
        out[by[np.flatnonzero(np.diff(own[by], prepend=-1))]] = True
        return out

    both = best(i, j) & best(j, i)
    return i[both], j[both], overlap[both]


def _by_turn(gaps: tuple[np.ndarray, np.ndarray], of: tuple[np.ndarray, np.ndarray], even: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both sides that are the k-th under one (gap, of); even: only where both sides have as many."""
    sides = [np.arange(len(g)) for g in gaps]
    group = np.unique(np.stack([np.concatenate(gaps), np.concatenate(of)]), axis=1, return_inverse=True)[1].reshape(-1) if sum(map(len, sides)) else np.array([], int)
    size = int(group.max()) + 1 if len(group) else 0
    own = group[: len(sides[0])], group[len(sides[0]) :]
    counts = [np.bincount(g, minlength=size) for g in own]
    orders = [np.argsort(g, kind="stable") for g in own]
    starts = [np.cumsum(c) - c for c in counts]
    n = np.where(counts[0] == counts[1], counts[0], 0) if even else np.minimum(*counts)
    return tuple(orders[k][_spread(starts[k], n)[1]] for k in (0, 1))


def paired_run(native: pa.Array, words: pa.Array, least: float):
    """Both streams with their mates, how each native word was paired, its overlap, gaps and codes of both sides' texts (null: -1)."""
    a, b = Stream(native), Stream(words)
    i, j, overlap = _by_boxes(a, b, least)
    a.mate[i], b.mate[j] = j, i
    how, shared = np.full(len(a.page), 3), np.full(len(a.page), np.nan)
    how[i], shared[i] = 0, overlap
    gaps = a.before(np.arange(len(a.page))), b.before(b.mate)
    code = pa.concat_arrays([a.text, b.text]).dictionary_encode().indices
    code = pc.fill_null(code, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = code[: len(a.page)], code[len(a.page) :]
    for step in (1, 2):  # by text, then by order
        open_ = [np.flatnonzero((s.mate < 0) & ((c >= 0) | (step == 2))) for s, c in zip((a, b), codes)]
        kinds = tuple(c[o] if step == 1 else np.zeros(len(o), np.int64) for c, o in zip(codes, open_))
        x, y = _by_turn(tuple(g[o] for g, o in zip(gaps, open_)), kinds, step == 2)
        i, j = open_[0][x], open_[1][y]
        a.mate[i], b.mate[j], how[i] = j, i, step
    return a, b, how, shared, gaps, codes


def ordered(a: Stream, b: Stream, gaps: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """left and right (rows of both sides, -1 for none), gap and page: native words in order, those only recognised behind the pair before them."""
    alone = np.flatnonzero(b.mate < 0)
    left = np.concatenate([np.arange(len(a.page)), np.full(len(alone), -1)])
    right = np.concatenate([a.mate, alone])
    gap = np.concatenate([gaps[0], gaps[1][alone]])
    page = np.concatenate([a.page, b.page[alone]])
    order = np.lexsort((right, left < 0, np.where(left < 0, gap, left), page))
    return left[order], right[order], gap[order], page[order]


def aligned_run(native: pa.Array, words: pa.Array, least: float) -> pa.Array:
    """For each page an array of PAIRED."""
    a, b, how, shared, gaps, _ = paired_run(native, words, least)
    left, right, gap, page = ordered(a, b, gaps)
    how, shared = (np.append(v, w)[left] for v, w in ((how, 4), (shared, np.nan)))

    def taken(values: pa.Array, at: np.ndarray) -> pa.Array:
        return values.take(pa.array(at, mask=at < 0))

    at_gap = pa.array(np.where(gap >= 0, a.pos[np.maximum(gap, 0)], -1) if len(a.pos) else np.full(len(gap), -1), pa.int64())
    columns = [taken(pa.array(a.pos), left), taken(a.text, left), taken(pa.array(b.pos), right), taken(b.text, right), pa.array(HOW[how], pa.string()), pa.array(shared, mask=np.isnan(shared)), at_gap]
    flat = pa.StructArray.from_arrays(columns, names=[c.split(" ")[0] for c in PAIRED.split(", ")])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(page, np.arange(len(native) + 1)), pa.int32()), flat)


def merged_run(native: pa.Array, words: pa.Array, least: float) -> tuple[pa.Array, pa.Array]:
    """For each page what merged_text() makes of its alignment: n_words and text."""
    a, b, _, _, gaps, _ = paired_run(native, words, least)
    left, right, _, page = ordered(a, b, gaps)
    read = (left < 0) | (a.text.is_null().to_numpy(zero_copy_only=False)[left] if len(a.page) else False)
    at = np.where(read, np.where(right < 0, -1, right + len(a.page)), left)
    text = pc.fill_null(pa.concat_arrays([a.text, b.text]).take(pa.array(at, mask=at < 0)), "")
    edges = np.searchsorted(page, np.arange(len(native) + 1))
    return pa.array(np.diff(edges)), pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), text), " ")


def counted_run(native: pa.Array, words: pa.Array, least: float) -> list[pa.Array]:
    """For each page how many words were paired in each way of HOW, and how many pairs have one text."""
    a, b, how, _, _, (mine, theirs) = paired_run(native, words, least)
    n = len(native)
    kinds = np.bincount(a.page * 5 + how, minlength=5 * n).reshape(n, 5)
    kinds[:, 4] = np.bincount(b.page[b.mate < 0], minlength=n)
    both = np.flatnonzero(a.mate >= 0)
    equal = both[mine[both] == theirs[a.mate[both]]]
    return [*map(pa.array, kinds.T), pa.array(np.bincount(a.page[equal], minlength=n))]


def _by_runs(pages: DataFrame, keys: list[str], least: float, make: Callable[[pa.Array, pa.Array, float], Sequence[pa.Array]], fields: list[StructField]) -> DataFrame:
    """keys and what make() gives of runs of pages."""
    if least < 0.5:
        raise ValueError("boxes that overlap by less than a half need not hold each other's centres")

    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = sum(pc.fill_null(pc.list_value_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("native", "words"))
            edges = [*np.flatnonzero(np.diff(np.cumsum(sizes) // WORDS, prepend=-1)).tolist(), b.num_rows]
            for first, end in zip(edges, edges[1:]):
                part = b.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *make(part.column("native"), part.column("words"), least)], names=[*keys, *names])

    conf, key = pages.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH))
    rows = pages.select(*keys, "native", "words")
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-2], *fields]))


def align(pages: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """keys, aligned: array of (n, native_text, m, word_text, how, overlap, gap); how is box, text, order, native or recognised, gap the
    native word of the last pair by boxes before, -1 where there is none."""
    return _by_runs(pages, keys, least, lambda a, b, x: [aligned_run(a, b, x)], [StructField("aligned", ArrayType(StructType.fromDDL(PAIRED)))])


def page_texts(pages: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """merged_text() of the pages aligned, without their words as rows: keys, n_words, text."""
    return _by_runs(pages, keys, least, merged_run, [StructField("n_words", LongType()), StructField("text", StringType())])


def page_agreement(pages: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """agreement() of the pages aligned, counted where they are."""
    counts = [f"n_{k}" for k in (*HOW, "equal")]
    each = _by_runs(pages, keys, least, counted_run, [StructField(c, LongType()) for c in counts])
    return each.where(" + ".join(counts[:5]) + " > 0").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def pages_of(native: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of words that come as rows: keys, native, words."""
    lists = [s.groupBy(*keys).agg(F.collect_list(F.struct(pos, "text", *BOX)).alias(name)) for s, pos, name in ((native, "n", "native"), (words, "m", "words"))]
    return lists[0].join(lists[1], keys, "full")


def aligned_rows(aligned: DataFrame, keys: list[str]) -> DataFrame:
    return aligned.select(*keys, F.inline("aligned"))


def merged_text(aligned: DataFrame) -> DataFrame:
    """With n_words and text: the native words, and those that were only recognised behind the pair that they follow."""
    text = F.array_join(F.transform("aligned", lambda x: F.coalesce(x["native_text"], x["word_text"], F.lit(""))), " ")
    return aligned.select("*", F.size("aligned").cast("long").alias("n_words"), text.alias("text")).drop("aligned")


def agreement(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Per key how words were paired, and how many pairs have one text: what recognition got right where native text is known."""
    kinds = ("box", "text", "order", "native", "recognised")
    both = F.col("n").isNotNull() & F.col("m").isNotNull()
    equal = F.count_if(both & F.col("native_text").eqNullSafe(F.col("word_text"))).alias("n_equal")
    return aligned_rows(aligned, keys).groupBy(*keys).agg(*[F.count_if(F.col("how") == k).alias(f"n_{k}") for k in kinds], equal)
