"""Texts that contain a phrase, joined by an index of character q-grams; entity cascades with equal and contains steps.

A phrase is looked for by one of its q-grams, the rarest, and only texts that hold that gram are compared with it. What a
text holds is a list of its distinct grams, of which those that are some phrase's key go on as (text, gram), so texts are
shuffled once at most, to be compared. How rare a gram is, is judged on a bounded sample of texts; that choice moves work,
never results. Phrases shorter than q are their own gram, of their own length.

Defined cases: upper and lower case are the same; a null or empty phrase is in no text, nor is any in a null text; equal
texts and equal phrases under several rows all match; a text or a phrase of any length is read whole; a phrase that every
text holds matches every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import interim

#: Length of a gram; texts by which grams are judged; keys up to which they are broadcast, as counted.
Q, JUDGED, BROADCAST = 5, 20_000, 400_000


def grams(text: Column, n: int) -> Column:
    """The distinct n-grams of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def candidates(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, q: int = Q, judged: int = JUDGED, same: tuple[str, ...] = ()) -> DataFrame:
    """(__text, __phrase, same): hashes of folded texts and phrases that share the phrase's key and are equal in the columns `same`;
    those of short phrases are matches."""
    folded = texts.select(F.lower(text).alias("__t"), *same).where("length(__t) > 0")
    wanted, _ = interim.write(phrases.select(F.lower(phrase).alias("__p"), *same).where("length(__p) > 0").distinct(), "phrases")
    wanted = wanted.withColumn("__n", F.least(F.length("__p"), F.lit(q)))
    lengths = sorted(r[0] for r in wanted.select("__n").distinct().collect())  # q of them at most
    found = []
    for n in lengths:
        own = wanted.where(F.col("__n") == n)
        if n < q:
            keyed = own.select(_hash(F.col("__p")).alias("__phrase"), *same, F.col("__p").alias("__gram"))
        else:
            of_phrase = own.select(_hash(F.col("__p")).alias("__phrase"), *same, F.explode(grams(F.col("__p"), q)).alias("__gram"))
            rows = folded.count()
            few = folded.where(F.rand(seed=11) < min(1.0, judged / max(1, rows))) if rows > judged else folded
            often = few.select(F.explode(grams(F.col("__t"), q)).alias("__gram")).join(of_phrase.select("__gram").distinct(), "__gram", "left_semi").groupBy("__gram").agg(F.count(F.lit(1)).alias("__often"))
            rank = F.struct(F.coalesce("__often", F.lit(0)), "__gram")
            keyed = of_phrase.join(often, "__gram", "left").groupBy("__phrase", *same).agg(F.min_by("__gram", rank).alias("__gram"))
        keyed, counts = interim.write(keyed, "keys")
        side = F.broadcast(keyed) if counts["n"] <= BROADCAST else keyed
        # outer: Spark filters before a plain explode, by the grams worked out once more
        held = folded.select(_hash(F.col("__t")).alias("__text"), *same, F.explode_outer(grams(F.col("__t"), n)).alias("__gram"))
        found.append(held.join(side, ["__gram", *same]).select("__text", "__phrase", *same))
    if not found:
        return folded.select(_hash(F.col("__t")).alias("__text"), F.lit(None).cast("binary").alias("__phrase"), *same).where("false")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def contains_join(df: DataFrame, text: str, phrases: DataFrame, phrase: str, q: int = Q, judged: int = JUDGED, same: tuple[str, ...] = ()) -> DataFrame:
    """Rows of df beside the rows of phrases whose phrase stands in the text; columns of both, names apart. same: columns of
    both, kept once, in which they must be equal and not null; what differs in them is no candidate."""
    pairs, counts = interim.write(candidates(df, text, phrases, phrase, q, judged, same), "candidates")
    left = df.withColumn("__text", _hash(F.lower(text)))
    right = phrases.withColumn("__phrase", _hash(F.lower(phrase)))
    pairs = F.broadcast(pairs) if counts["n"] <= BROADCAST else pairs
    return left.join(pairs, ["__text", *same]).join(right, ["__phrase", *same]).where(F.contains(F.lower(F.col(text)), F.lower(F.col(phrase)))).drop("__text", "__phrase")


class Phrases:
    """Phrases that are looked for in a task, all in one pass over a run of texts (both in UTF-8). Up to 8 bytes are read as a
    number, which tells the phrase; longer phrases begin where their first 8 bytes stand, and a hash of the rest of their length
    names one to be compared."""

    ODD, SLOTS = 0x9E3779B97F4A7C15, 18

    def __init__(self, phrases: list[bytes]):
        self.phrases, self.lengths = phrases, {}
        sizes = np.array([len(p) for p in phrases], np.int64)
        self.heads = np.zeros(1 << self.SLOTS, bool)
        for size in np.unique(sizes[sizes > 0]).tolist():
            which = np.flatnonzero(sizes == size)
            flat = np.frombuffer(b"".join([phrases[k] for k in which]), np.uint8).reshape(-1, size)
            head = np.zeros(len(which), np.uint64)
            for k in range(min(size, 8)):
                head = head << np.uint64(8) | flat[:, k]
            table = np.zeros(1 << self.SLOTS, bool)
            table[self._slot(head)] = True
            if size > 8:
                self.heads |= table
                head = (flat * self._powers(size)).sum(1, dtype=np.uint64)
            order = np.argsort(head)
            head, which = head[order], which[order]
            repeats = np.bincount(np.unique(head, return_inverse=True)[1]).max()
            self.lengths[size] = table, head, which, int(repeats)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(self.ODD)) >> np.uint64(64 - self.SLOTS)

    def _powers(self, n: int, of: int = ODD) -> np.ndarray:
        out = np.full(n, of, np.uint64)
        out[:1] = 1
        return np.cumprod(out)

    def within(self, texts: list[bytes]) -> np.ndarray:
        """For each text, which phrases stand in it; one column more, which is never true. An empty phrase is in no text."""
        seen = np.zeros((len(texts), len(self.phrases) + 1), bool)
        blob = b"".join(texts)
        flat = np.frombuffer(blob, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        of = np.repeat(np.arange(len(texts)), sizes)
        left = np.cumsum(sizes)[of] - np.arange(len(flat))
        code = np.zeros(len(flat), np.uint64)
        longest = max(self.lengths, default=0)
        for size in range(1, min(longest, 8) + 1):
            code = code << np.uint64(8)
            code[: max(0, len(flat) - size + 1)] |= flat[size - 1 :]
            if size in self.lengths or size == 8:
                slot = self._slot(code)
            if size in self.lengths:
                table, keys, which, _ = self.lengths[size]
                at = np.flatnonzero(table[slot])
                at = at[left[at] >= size]
                k = np.minimum(np.searchsorted(keys, code[at]), len(keys) - 1)
                hit = keys[k] == code[at]
                seen[of[at[hit]], which[k[hit]]] = True
        if longest > 8:
            begins = np.flatnonzero(self.heads[slot])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * self._powers(len(flat)), dtype=np.uint64)])
            back = self._powers(len(flat), pow(self.ODD, -1, 1 << 64))
            for size in self.lengths:
                if size > 8:
                    table, keys, which, repeats = self.lengths[size]
                    at = begins[table[slot[begins]] & (left[begins] >= size)]
                    h = (sums[at + size] - sums[at]) * back[at]
                    first = np.searchsorted(keys, h)
                    for more in range(repeats):
                        k = np.minimum(first + more, len(keys) - 1)
                        hit = keys[k] == h
                        for p, t, w in zip(at[hit].tolist(), of[at[hit]].tolist(), which[k[hit]].tolist()):
                            if not seen[t, w] and blob[p : p + size] == self.phrases[w]:
                                seen[t, w] = True
        return seen


def _several(c: str) -> Column:
    """__n: 2 where there are several values, else 1; sums before a shuffle, unlike a count of distinct ones."""
    return F.when(F.min(c) < F.max(c), 2).otherwise(1).alias("__n")


@dataclass(frozen=True)
class Step:
    """One way to find an entity: rows of candidates whose column `theirs` equals the row's value `ours` (trimmed, case folded),
    contains it, or stands in it (within). several: 'first' takes the smallest id, 'error' ends the cascade for the row."""

    candidates: DataFrame
    theirs: str
    ours: str
    how: str = "equal"
    several: str = "first"


def entity_cascade(df: DataFrame, key: str, steps: list[Step], id_col: str, out: str = "match_id", create: Column | None = None) -> DataFrame:
    """df with the id of the first step that finds one, matched_by (its number from 1) and match_error: 'several', 'none',
    or null; where create holds, rows without a match say 'create'. key tells df's rows apart; rows that share it share a match.

    A step is asked for the rows that those before it left open, and its answer is written, narrow."""
    open_rows = df.select(F.col(key).alias("__key"), *dict.fromkeys(s.ours for s in steps)).where("__key is not null")
    answers = []
    for n, s in enumerate(steps, 1):
        ours = F.trim(F.col(s.ours).cast("string"))
        asked = open_rows.select("__key", ours.alias("__ours")).where("length(__ours) > 0")
        theirs = s.candidates.select(F.col(id_col).alias("__id"), F.col(s.theirs).cast("string").alias("__theirs")).where("__id is not null")
        if s.how == "equal":
            side = theirs.groupBy(F.lower(F.trim("__theirs")).alias("__k")).agg(F.min("__id").alias("__id"), _several("__id"))
            hits = asked.join(side, F.lower("__ours") == F.col("__k")).groupBy("__key").agg(F.min("__id").alias("__id"), F.max("__n").alias("__n"))
        else:
            values, _ = interim.write(asked.select("__ours").distinct(), "values")  # read for keys, candidates and the comparison
            if s.how == "contains":
                pairs = contains_join(theirs, "__theirs", values, "__ours")
            elif s.how == "within":
                pairs = contains_join(values, "__ours", theirs, "__theirs")
            else:
                raise ValueError(f"unknown step {s.how!r}")
            by_value = pairs.groupBy("__ours").agg(F.min("__id").alias("__id"), _several("__id"))
            hits = asked.join(by_value, "__ours").groupBy("__key").agg(F.min("__id").alias("__id"), F.max("__n").alias("__n"))
        several = (F.col("__n") > 1) if s.several == "error" else F.lit(False)
        answer = hits.select("__key", F.when(~several, F.col("__id")).alias(out), F.lit(n).alias("matched_by"), F.when(several, "several").alias("match_error"))
        answer, _ = interim.write(answer, "answers")
        answers.append(answer)
        open_rows = open_rows.join(answer.select("__key"), "__key", "left_anti")
    found = answers[0]
    for a in answers[1:]:
        found = found.unionByName(a)
    joined = df.join(found.withColumnRenamed("__key", "__k"), F.col(key) == F.col("__k"), "left").drop("__k")
    none = F.when(F.coalesce(create, F.lit(False)), "create").otherwise("none") if create is not None else F.lit("none")
    return joined.withColumn("match_error", F.when(F.col("matched_by").isNull(), none).otherwise(F.col("match_error")))
