"""Near-duplicates by ProbMinHash over weighted word shingles.

Sketch. Every shingle of weight w is a Poisson process of rate w whose arrivals each fall on a random register; a
register keeps the shingle that arrives first. A shingle stops once its next arrival is later than all registers of its
text, so most give one arrival. Two texts agree in a register with their probability Jaccard similarity.

Classes, without listing the pairs of a group:
1. texts with equal weighted shingles (a 128-bit fingerprint) collapse to one representative, the smallest id;
2. `bands` bands of `rows` registers put representatives into buckets; each member is linked to its bucket's pivot, the
   member that stands in the fullest buckets (the text that a group's copies were made from), and each such link is
   verified by the exact similarity of the two texts;
3. verified links give classes (smallest label, with pointer jumping, until nothing changes);
4. in a bucket whose other members are still of several classes, all members of different classes are compared: in a
   bucket of FEW members as pairs, in a larger one block by block inside tasks, which return similar pairs only.
So any two texts that share a band are in one class at the end or have been compared. Two are passed over only where
that is certain without reading them: 1 - similarity is a metric (it is the chance that a register differs), so texts
whose distances to their pivot differ by more than 1 - `similarity` are not similar. What remains to be missed is a pair
that agrees in no band. Large buckets of many texts that are near each other but not similar cost comparisons by the
square, and rows by the square over BLOCK.

Counts, joins and candidates are keyed by bucket or id; hot buckets are pre-aggregated (2), and their joins can be split.

Defined cases: null text counts as empty; texts without words are copies of each other; texts shorter than a shingle
agree only where all words do; rows with a null id stay, each in a class of its own (class_id null); rows repeated under
one id count once each in class_size and share their fate; an empty table gives an empty table; ids are integers; ties
go to the smallest id; extra columns stay out of the way, whatever their names. A long text is read in one task.
Intermediate tables go to the shared folder; all but the two that the result reads are deleted when it is planned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, discard, map_batches, materialize, materialize_counted, pieces, small_or_shuffled
from .shingles import WORDS, blocks, mixed, odd_constants, shingle_hashes, similarities, weighted

BANDS, ROWS, SIMILARITY = 25, 5, 0.8
#: Members of a bucket whose pairs become rows; members of a block of a larger bucket.
FEW, BLOCK = 32, 512
SALT = 0xD1B54A32D192ED03
ALL = (1 << 64) - 1


def sketch(owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """(texts, size) uint64: for every register the shingle that arrives first; 0 for texts without shingles."""
    best = np.full(texts * size, np.inf)
    ids = np.zeros(texts * size, np.uint64)
    latest = np.full(texts, np.inf)
    time = np.zeros(len(hashes))
    k = 0
    while len(hashes):
        k += 1
        bits = mixed(hashes + np.uint64(k * SALT & ALL))
        register = owner * size + ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        uniform = (mixed(bits ^ np.uint64(SALT)) >> np.uint64(11)).astype(np.float64) + 1
        time = time - np.log(uniform * 2.0**-53) / weight
        np.minimum.at(best, register, time)
        first = best[register] == time
        ids[register[first]] = hashes[first]
        live = np.unique(owner)
        latest[live] = best.reshape(texts, size)[live].max(1)
        on = time < latest[owner]
        owner, hashes, weight, time = owner[on], hashes[on], weight[on], time[on]
    return ids.reshape(texts, size)


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """id, fp1, fp2 (fingerprint of the weighted shingles), keys (one per band)."""
    schema = "id long, fp1 long, fp2 long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            ids = b.column(0)
            for at, data in blocks(b.column(1).to_pylist()):
                owner, hashes, weight = weighted(*shingle_hashes(data, words))
                n = len(data)
                prints = []
                for salt in (SALT, SALT ^ ALL):
                    total = np.zeros(n, np.uint64)
                    np.add.at(total, owner, mixed(hashes ^ (weight.astype(np.uint64) * np.uint64(salt))))
                    prints.append(total)
                ids_of = sketch(owner, hashes, weight, n, bands * rows).reshape(n, bands, rows)
                keys = mixed((ids_of * odd_constants(rows)).sum(2, dtype=np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), *[pa.array(p.view(np.int64)) for p in prints], lists], names=["id", "fp1", "fp2", "keys"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null"), run, schema)


def compared(pairs: DataFrame, texts: DataFrame, n_texts: int, words: int = WORDS) -> DataFrame:
    """Pairs (a, b), a written table, with the similarity of their texts. texts: id, text, of n_texts rows."""
    needed = materialize_counted(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes", at_most=n_texts)
    kept = texts.join(small_or_shuffled(*needed), "id", "left_semi")
    both = pairs.join(kept.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(
        kept.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            at: dict[int, int] = {}
            data: list[bytes] = []
            sides = []
            for ids, column in ((a.to_pylist(), ta), (b.to_pylist(), tb)):
                for i, x in enumerate(ids):
                    if x not in at:  # a batch has few texts and many pairs of them
                        at[x] = len(data)
                        data.append((column[i].as_py() or "").lower().encode())
                sides.append(np.array([at[x] for x in ids], np.int64))
            found = similarities(*sides, len(data), *weighted(*shingle_hashes(data, words)))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return map_batches(both.select("a", "b", "ta", "tb"), run, "a long, b long, similarity double")


def components(links: DataFrame, nodes: int) -> DataFrame:
    """node, label: the smallest node of its component, for the nodes (at most so many) of links (a, b), a written table."""
    sides = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    sides = materialize(sides.unionByName(sides.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "sides", at_most=2 * nodes)
    labels, old = sides.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")), None
    while True:
        near = sides.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        moved, changes = materialize_counted(moved, "labels", F.col("label") != F.col("old"), at_most=nodes)
        if old is not None:
            discard(old)
        labels, old = moved.select("node", "label"), moved
        if not changes:
            discard(sides)
            return labels


def joined(labels: DataFrame, links: DataFrame, nodes: int) -> DataFrame:
    """labels (node, label) after more links (a, b), a written table: components of the classes that these link."""
    ends = links
    for side in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(side), "label"), side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
    found = components(materialize(ends.select("a", "b").distinct(), "ends", at_most=nodes), nodes)
    lower = found.select(F.col("node").alias("label"), F.col("label").alias("lower"))
    kept = labels.join(lower, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    return materialize(kept.unionByName(found.join(labels, "node", "left_anti")), "labels", at_most=nodes)


def with_pivots(members: DataFrame, at_most: int) -> DataFrame:
    """Members (bucket, rep, central) of the buckets that have several, with the bucket's size and pivot."""
    order = F.struct("central", -F.col("rep"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.max(order).alias("top")).where("size > 1")
    buckets = buckets.select("bucket", "size", (-F.col("top")["col2"]).alias("pivot"))
    return materialize(members.join(buckets, "bucket").select("bucket", "band", "rep", "size", "pivot"), "placed", at_most)


def of_several_classes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Of rows (bucket, rep, ...) those of the buckets that hold several classes, with their class as label."""
    own = labels.select(F.col("node").alias("rep"), "label")
    rows = rows.drop("label").join(own, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    several = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return rows.join(several.select("bucket"), "bucket", "left_semi")


def listed(rows: DataFrame, distance: float) -> DataFrame:
    """a < b: the pairs of different classes that share one of the buckets of rows, which hold FEW members at most."""
    one = rows.select("bucket", F.col("rep").alias("a"), F.col("label").alias("of_a"), F.col("distance").alias("far"))
    meet = one.join(rows, "bucket").where((F.col("rep") > F.col("a")) & (F.col("label") != F.col("of_a")))
    return meet.where(F.abs(F.col("distance") - F.col("far")) <= distance + 1e-9).select("a", F.col("rep").alias("b")).distinct()


def in_blocks(rows: DataFrame, texts: DataFrame, keys: DataFrame, similarity: float, words: int = WORDS) -> DataFrame:
    """a < b: the similar pairs of different classes that share one of the buckets of rows. A bucket's members are cut into
    blocks of about BLOCK, each task holds two of them and compares their pairs in numpy, and only similar ones become rows.
    Of the buckets that two texts share, the one of the first band compares them. texts: id, text. keys: rep, keys."""
    needed = materialize_counted(rows.select(F.col("rep").alias("id")).distinct(), "nodes")
    kept = texts.join(small_or_shuffled(*needed), "id", "left_semi").withColumnRenamed("id", "rep")
    held = rows.join(kept, "rep").join(keys, "rep")
    blocks_ = F.ceil(F.col("size") / BLOCK).cast("int")
    held = held.withColumn("block", F.pmod(F.xxhash64("rep", "bucket"), blocks_).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), blocks_ - 1)))
    held = held.select("bucket", F.least("block", "__other").alias("i"), F.greatest("block", "__other").alias("j"), "block", "band", "rep", "label", "distance", "text", "keys")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        block, label, far, rep = (np.asarray(group[c]) for c in ("block", "label", "distance", "rep"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        on = (label[a] != label[b]) & (np.abs(far[a] - far[b]) <= 1 - similarity + 1e-9)
        if i == j:
            on &= a < b
        a, b = a[on], b[on]
        of_band = np.asarray(pc.list_flatten(group["keys"])).reshape(group.num_rows, -1)
        for band in range(group["band"][0].as_py()):
            apart = of_band[a, band] != of_band[b, band]
            a, b = a[apart], b[apart]
        texts = group["text"].combine_chunks()
        run_of = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
        runs = run_of[a] << 32 | run_of[b]
        found = np.zeros(len(a), bool)
        for r in np.unique(runs):  # long texts: two runs of about PIECE bytes at a time
            on = np.flatnonzero(runs == r)
            both, at = np.unique(np.concatenate([a[on], b[on]]), return_inverse=True)
            data = [(texts[int(k)].as_py() or "").lower().encode() for k in both]
            at = at.reshape(2, -1)
            found[on] = similarities(at[0], at[1], len(data), *weighted(*shingle_hashes(data, words))) >= similarity - 1e-12
        x, y = rep[a[found]], rep[b[found]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return held.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """id, class_id (the smallest id of its near-duplicates, itself included), class_size; one row per row of df with an id."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    found, n_texts = materialize_counted(sketches(df, id_col, text_col, bands, rows, words), "sketches")
    copies = found.groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.min_by("keys", "id").alias("keys"), F.count(F.lit(1)).alias("n"))
    copies, n = materialize_counted(copies, "copies", at_most=8 * n_texts)  # rows of bands are wider
    members = copies.select("rep", F.posexplode("keys").alias("band", "bucket")).select("rep", "band", F.xxhash64("band", "bucket").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared, n_shared = materialize_counted(members.join(sizes, "bucket"), "buckets", at_most=bands * n)
    central = shared.groupBy("rep").agg(F.sum("size").alias("central"))
    placed = with_pivots(shared.drop("size").join(central, "rep"), n_shared)
    tried = materialize(placed.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs", at_most=n_shared)
    stars = materialize(compared(tried, texts, n, words), "stars")
    similar = F.col("similarity") >= similarity - 1e-12
    labels = components(stars.where(similar), n)
    used = [copies, shared, placed, tried, stars]
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    rest = of_several_classes(placed.where("size > 2 and rep <> pivot"), labels)  # a pivot has been compared with all
    far = stars.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), (1 - F.col("similarity")).alias("distance"))
    rest, n_rest = materialize_counted(rest.join(far, ["rep", "pivot"]).select("bucket", "band", "rep", "size", "distance", "label"), "mixed", at_most=n_shared)
    used.append(rest)
    if n_rest:
        pairs = materialize(listed(rest.where(F.col("size") <= FEW), 1 - similarity).join(tried, ["a", "b"], "left_anti"), "pairs")
        large = in_blocks(rest.where(F.col("size") > FEW), texts, copies.select("rep", "keys"), similarity, words)
        found_links = compared(pairs, texts, n, words).where(similar).select("a", "b").unionByName(large).distinct()
        more, links = materialize_counted(found_links, "links", at_most=n_shared)
        used += [pairs, more]
        if links:
            labels = joined(labels, more, n)

    owned = copies.select("fp1", "fp2", "rep", "n").join(labels, F.col("rep") == F.col("node"), "left").select("fp1", "fp2", "n", F.coalesce("label", "rep").alias("class_id"))
    sizes = owned.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    owned = materialize(owned.join(sizes, "class_id").select("fp1", "fp2", "class_id", "class_size"), "classes", at_most=n)
    discard(*used)
    return found.select("id", "fp1", "fp2").join(owned, ["fp1", "fp2"]).select("id", "class_id", "class_size")


def mark_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of df: the id, class_id, class_size, kept (it has its class's smallest id)."""
    out = classes(df, id_col, text_col, **how).select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("id") == F.col("class_id")).alias("kept"))
    alone = df.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df without the rows that are near-duplicates of a smaller id; all columns of df."""
    gone = classes(df, id_col, text_col, **how).where("id <> class_id").select("id").distinct()
    gone = materialize_counted(gone.withColumnRenamed("id", "__gone"), "gone")
    return df.join(small_or_shuffled(*gone), F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
