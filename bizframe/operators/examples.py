"""The best past examples of every document, without scoring every document against every example.

Points: 10 for an example of the document's type, 10 for its provider, 15 for its language, 40 and 20 for a partner name and
a reference that stand in the document's text. Documents and examples of a type are dealt to blocks, and every block of
documents meets every block of examples in a task, so a text is shuffled once for each block of examples of its type and never
once for each phrase in it; only the best of a block leave the task, and the best of those are the result. In a block all phrases
are looked for in one pass over the texts. What else gives points is known from an example's company, provider and
language, so a task looks at the first examples of those, at the first ones of the few references found that go first, and at the
examples of the partner names found.

Defined cases: a document without id, text or type has no examples; an example of another company does not count, one without
a company counts for all; a document's own examples do not count; null or empty languages and phrases give no points;
ties go to the more used, then the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources import interim
from .contains import BROADCAST, Phrases

#: Fixed points.
BASE, PROVIDER, LANGUAGE, PARTNER, REFERENCE = 10, 10, 15, 40, 20
#: Bytes of the texts of a block, its documents and its examples; bytes of texts, and texts times phrases, that are looked at together; numbers held
#: for companies, providers and languages that asked.
TEXTS, DOCS, EXAMPLES, TOGETHER, CELLS, HELD = 32 << 20, 10_000, 200_000, 256 << 10, 8 << 20, 16 << 20


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _codes(ours: pa.ChunkedArray, theirs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the values of two columns, equal where those are, -1 for null; and the values."""
    both = pa.chunked_array([*ours.chunks, *theirs.chunks], ours.type).combine_chunks().dictionary_encode()
    n = np.asarray(both.indices.fill_null(-1))
    return n[: len(ours)], n[len(ours) :], both.dictionary


def _members(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by code, in order, and where each code's begin; those of k are places[starts[k] : starts[k + 1]]."""
    places = np.argsort(codes, kind="stable")
    return places, np.searchsorted(codes[places], np.arange(n + 1))


class _Asked:
    """A block's examples as documents of one company, provider and language see them. Places of examples go by use."""

    def __init__(self, points: np.ndarray, reference: np.ndarray, n: int, need: int):
        self.points, self.need, self.lists = points, need, {}
        order = np.argsort(-points, kind="stable")[: np.count_nonzero(points)]
        self.first = order[:need]
        self.rank = np.full(n + 1, len(points), np.int32)
        self.rank[reference[order[::-1]]] = np.arange(len(order))[::-1]  # of several the last one stays, which is the first
        self.rank[-1] = len(points)

    def of(self, reference: int, places: np.ndarray) -> np.ndarray:
        """The first of the examples of a reference, whose places are given."""
        if reference not in self.lists:
            own = self.points[places]
            self.lists[reference] = places[np.argsort(-own, kind="stable")[: self.need]]
        return self.lists[reference]


def _best_of_block(limit: int, d: pa.Table, e: pa.Table) -> pa.Table:
    """doc_id, example_id, score, use_count: the first examples of a block for each document of a block, of one type."""
    if d.num_rows and e.num_rows:
        e = e.take(pc.sort_indices(e, [("use_count", "descending"), ("example_id", "ascending")], null_placement="at_end"))
    doc, own, _ = _codes(d["doc_id"], e["own"])
    company, e_company, _ = _codes(d["company"], e["company"])
    provider, e_provider, _ = _codes(d["provider"], e["provider"])
    language, e_language, _ = _codes(d["language"], e["language"])
    partner, reference, phrases = _codes(e["partner"], e["reference"])
    n = len(phrases)
    owned = np.bincount(own[own >= 0])
    need = limit + int(owned.max(initial=0))  # a document's own may be before those that count
    of_partner, partner_at = _members(partner, n)
    of_reference, reference_at = _members(reference, n)
    wanted, asked = Phrases(phrases.to_pylist()), {}
    texts = d["text"].to_pylist()
    most, rows, places, scores = 1 + CELLS // (n + 1), [], [], []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and upto - at < most and (upto == at or size + len(texts[upto]) <= TOGETHER):
            size += len(texts[upto])
            upto += 1
        for t, seen in enumerate(wanted.within(texts[at:upto]), at):
            key = company[t], provider[t], language[t]
            if key not in asked:
                if len(asked) * (n + len(own)) > HELD:
                    asked.clear()
                points = np.where((e_company < 0) | (e_company == key[0]), BASE, 0).astype(np.int16)
                for theirs, ours, more in ((e_provider, key[1], PROVIDER), (e_language, key[2], LANGUAGE)):
                    if ours >= 0:
                        points[(points > 0) & (theirs == ours)] += more
                asked[key] = _Asked(points, reference, n, need)
            mine = asked[key]
            found = np.flatnonzero(seen)
            rank = mine.rank[found]
            refs = found[rank < len(mine.points)]
            if len(refs) > need:
                refs = refs[np.argpartition(mine.rank[refs], need)[:need]]
            looked = [mine.first, *[mine.of(int(r), of_reference[reference_at[r] : reference_at[r + 1]]) for r in refs]]
            for p in found[partner_at[found] < partner_at[found + 1]]:
                all_of = of_partner[partner_at[p] : partner_at[p + 1]]
                if len(all_of) > need:
                    got = np.where(mine.points[all_of] > 0, mine.points[all_of] + REFERENCE * seen[reference[all_of]], 0)
                    all_of = all_of[np.argsort(-got, kind="stable")[:need]]
                looked.append(all_of)
            some = np.unique(np.concatenate(looked))
            some = some[(mine.points[some] > 0) & (own[some] != doc[t])]
            score = mine.points[some] + PARTNER * seen[partner[some]] + REFERENCE * seen[reference[some]]
            best = np.argsort(-score, kind="stable")[:limit]
            rows.append(np.full(len(best), t))
            places.append(some[best])
            scores.append(score[best])
        at = upto
    rows, places, scores = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (rows, places, scores))
    return pa.table({"doc_id": d["doc_id"].take(rows), "example_id": e["example_id"].take(places), "score": pa.array(scores, pa.int32()), "use_count": e["use_count"].take(places)})


def best_examples(docs: DataFrame, examples: DataFrame, limit: int = 3) -> DataFrame:
    """doc_id, rank, example_id, score. docs: doc_id, type, company, provider, language, text; examples: example_id, doc_id,
    type, company, provider, language, partner_name, reference_text, use_count, active."""
    lang = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    # columns that are compared get the type that both have in common
    alike = lambda c, other: F.coalesce(F.col(c), F.lit(None).cast(other.schema[c].dataType)).alias(c)
    phrase = lambda c: F.nullif(_norm(F.col(c)), F.lit("")).cast("binary")
    d = docs.select(alike("doc_id", examples), "type", *[alike(c, examples) for c in ("company", "provider")], lang(F.col("language")).alias("language"), _norm(F.col("text")).alias("text")).where("length(text) > 0 AND type IS NOT NULL AND doc_id IS NOT NULL")
    e = examples.where("active AND type IS NOT NULL AND example_id IS NOT NULL").select(
        "example_id", alike("doc_id", docs).alias("own"), "type", *[alike(c, docs) for c in ("company", "provider")], lang(F.col("language")).alias("language"), "use_count",
        phrase("partner_name").alias("partner"), phrase("reference_text").alias("reference"),
    )
    many = F.greatest(F.ceil(F.sum(F.octet_length("text")) / TEXTS), F.ceil(F.count(F.lit(1)) / DOCS)).alias("n_d")
    blocks = docs.groupBy("type").agg(many).join(e.groupBy("type").agg(F.ceil(F.count(F.lit(1)) / EXAMPLES).alias("n_e")), "type")
    blocks, counts = interim.write(blocks, "blocks")
    blocks = F.broadcast(blocks) if counts["n"] <= BROADCAST else blocks

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """df dealt to its own blocks, by a key, each row once for every block of the other side."""
        at = df.join(blocks, "type").withColumn(f"at_{own}", F.pmod(F.xxhash64(key), f"n_{own}"))
        return at.withColumn(f"at_{other}", F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).drop("n_d", "n_e").groupBy("type", "at_d", "at_e")

    schema = StructType([d.schema["doc_id"], e.schema["example_id"], StructField("score", IntegerType()), e.schema["use_count"]])
    pairs = dealt(d.withColumn("text", F.col("text").cast("binary")), "doc_id", "d", "e").cogroup(dealt(e, "example_id", "e", "d"))
    found = pairs.applyInArrow(lambda ours, theirs: _best_of_block(limit, ours, theirs), schema)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("use_count"), "example_id"))
    return found.select("doc_id", rank.alias("rank"), "example_id", "score").where(F.col("rank") <= limit)


def captured(docs: DataFrame, examples: DataFrame) -> DataFrame:
    """examples after feedback: reviewed documents with text and data replace their own example or add one, use counts kept."""
    new = docs.where("reviewed AND length(text) > 0 AND data IS NOT NULL").select("doc_id", "text", "data")
    old = examples.select("doc_id", "use_count", "text", "data")
    both = old.join(new.select(F.col("doc_id"), F.col("text").alias("new_text"), F.col("data").alias("new_data")), "doc_id", "full_outer")
    return both.select("doc_id", F.coalesce("use_count", F.lit(0)).cast(old.schema["use_count"].dataType).alias("use_count"), F.coalesce("new_text", "text").alias("text"), F.coalesce("new_data", "data").alias("data"))
