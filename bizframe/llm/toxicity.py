"""Toxicity: a weighted finite-state grammar of clauses, its weights learned from labelled rows.

A lexicon turns words into classes: words of insult in three strengths, threats, intents, targets, negations, verbs of
reported speech, clause ends. Insults are learned: whole words and word beginnings that stand in toxic documents and
hardly in others, judged over distinct texts so that copies count once; further classes are fixed lists. Five transducers
read the classes one after the other and mark what they find: reported speech (up to the clause's end), negation (a few
words), target (addressed, spoken of), threat (an intent before it or a target by it), insult. compose() makes one machine
of them by walking the product of their states. A clause's strongest finding, with its marks, is one event of one kind;
single words carry no score of their own. A document's score is the logistic of a constant and each kind's weight times
log(1 + its number of clauses).

fit() learns from at most about `sample` labelled rows (by a seeded hash of the text): pattern counts are Spark
aggregates, of which at most `patterns` of the most certain come to the driver; the weights are a ridge regression
towards prior weights, so that kinds the rows do not show keep the grammar's sense: what is said of someone counts more
than what is negated or reported. score() reads whole texts and shuffles nothing.

Defined cases: a null or empty text has no clause and gets the score of the constant; rows without a label or without
text are not learned from; without any labelled row the prior weights hold and no insult is known but the fixed ones;
rows repeated under one id are scored each for itself, and count once in learning; several labels of one id count as
toxic if one is; an empty table gives an empty table; a text of any length is read whole; extra columns are dropped but
those in keep, and one with the name of a new column is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import map_batches, new_names, pieces

#: Bounds of what is learned from and of the lexicon; characters of a word's beginning that may become a pattern.
SAMPLE, PATTERNS, BEGINNINGS = 24_000, 4_000, (5, 6, 7, 8)
#: A pattern needs so many toxic texts, and this share of its texts to be toxic, as estimated.
LEAST, SHARE = 2, 0.7
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")

#: Classes of words.
OTHER, END, STRONG, MIDDLE, WEAK, THREAT, INTENT, YOU, THEM, NOT, SAID = range(11)
WORDS = {
    STRONG: "idiot moron scum trash loser stupid worthless pathetic disgusting clown",
    THREAT: "kill hurt destroy punish strangle töten tuer matar",
    INTENT: "will gonna shall going i'll we'll werde vais voy",
    YOU: "you your you're ur yourself du dich dein tu vous toi tú usted",
    THEM: "he she they him her them his their these those er ihn ils elle ellos ella",
    NOT: "not no never isn't aren't don't nicht kein keine nie pas jamais nunca",
    SAID: "said says say claimed claims wrote reported called quoted told sagte schrieb dit dijo",
}
#: Words that a negation reaches.
REACH = 4

#: What a clause can be: its strongest finding, its target, and whether it is negated or reported.
FINDINGS = ("weak", "middle", "strong", "threat")
MARKS = ("said", "denied", "plain", "aimed")
KINDS = [(f, m) for f in FINDINGS for m in MARKS]
#: Weights before any row is seen, by finding and mark, and of the constant.
PRIOR = np.array([s * m for s in (0.6, 1.5, 2.5, 2.5) for m in (0.3, 0.1, 1.0, 1.4)])
PRIOR_CONSTANT = -3.0


# The machine


@dataclass(frozen=True)
class Transducer:
    """step(state, symbol) -> (state, symbol): letter to letter; symbols are (class, marks)."""

    start: object
    step: object


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that gives what second makes of what first gives."""

    def step(state, symbol):
        a, middle = first.step(state[0], symbol)
        b, out = second.step(state[1], middle)
        return (a, b), out

    return Transducer((first.start, second.start), step)


def _marking(on: int, mark: str, reach: int | None) -> Transducer:
    """Marks findings after a word of class on, until the clause ends or for reach words."""

    def step(left, symbol):
        kind, marks = symbol
        if kind == END:
            return 0, symbol
        out = (kind, marks | {mark}) if left and kind in (STRONG, MIDDLE, WEAK, THREAT) else symbol
        if kind == on:
            return reach or 1, out
        return (max(0, left - 1) if reach else left), out

    return Transducer(0, step)


def _target() -> Transducer:
    def step(state, symbol):
        kind, marks = symbol
        if kind == END:
            return "", symbol
        if kind in (YOU, THEM):
            return "aimed", symbol
        return state, (kind, marks | {state}) if state and kind in (STRONG, MIDDLE, WEAK, THREAT) else symbol

    return Transducer("", step)


def _threat() -> Transducer:
    """A verb of threat counts where an intent or a target stands before it in the clause; else it is a word like others."""

    def step(intent, symbol):
        kind, marks = symbol
        if kind == END:
            return False, symbol
        if kind == THREAT and not (intent or "aimed" in marks):
            return intent, (OTHER, marks)
        return intent or kind == INTENT, symbol

    return Transducer(False, step)


def _clause() -> Transducer:
    """At the end of a clause gives (kind, number) of its strongest finding, raised by a target that follows it; else None."""
    level = {WEAK: 0, MIDDLE: 1, STRONG: 2, THREAT: 3}

    def step(best, symbol):
        kind, marks = symbol
        if kind == END:
            return None, best
        if kind in level:
            mark = "said" if "said" in marks else "denied" if "denied" in marks else "aimed" if "aimed" in marks else "plain"
            found = level[kind] * len(MARKS) + MARKS.index(mark)
            # an unmarked finding outranks a reported or denied one, then the stronger one does
            rank = lambda k: (k % len(MARKS) >= 2, k)
            return (found if best is None or rank(found) > rank(best) else best), None
        if kind in (YOU, THEM) and best is not None and MARKS[best % len(MARKS)] == "plain":
            return best + 1, None
        return best, None

    return Transducer(None, step)


@cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, event or -1) of the composed machine by state and class; it starts in state 0."""
    whole = _marking(SAID, "said", None)
    for part in (_marking(NOT, "denied", REACH), _target(), _threat(), _clause()):
        whole = compose(whole, part)
    number, to, out, todo = {whole.start: 0}, [], [], [whole.start]
    for state in todo:
        to.append([])
        out.append([])
        for kind in range(SAID + 1):
            after, event = whole.step(state, (kind, frozenset()))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            to[-1].append(number[after])
            out[-1].append(-1 if event is None else event)
    return np.array(to), np.array(out)


# Reading


class Lexicon(dict):
    """Class of a word: whole words, else the longest known beginning. Words asked for are kept, up to a number."""

    KEEP = 400_000

    def __init__(self, words: dict[str, int], beginnings: dict[str, int]):
        super().__init__()
        fixed = {w: kind for kind, ws in WORDS.items() for w in ws.split()} | {c: END for c in ".!?;:\n"}
        self.words, self.beginnings = words | fixed, beginnings

    def __missing__(self, word: str) -> int:
        kind = self.words.get(word)
        if kind is None:
            kind = next((k for n in reversed(BEGINNINGS) if len(word) > n and (k := self.beginnings.get(word[:n])) is not None), OTHER)
        if len(self) < self.KEEP:
            self[word] = kind
        return kind


_FOUND = re.compile(bytes([91, STRONG, 45, THREAT, 93]))


def events(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """How many clauses of each kind the text has."""
    count = np.zeros(len(KINDS))
    if not text:
        return count
    classes = bytes(map(lexicon.__getitem__, TOKEN.findall(text.lower())))
    if not _FOUND.search(classes):
        return count
    to, out = (t.tolist() for t in machine())
    for clause in classes.split(bytes([END])):
        if _FOUND.search(clause):
            state = 0
            for kind in clause:
                state = to[state][kind]
            if (event := out[state][END]) >= 0:
                count[event] += 1
    return count


@dataclass
class Model:
    words: dict[str, int] = field(default_factory=dict)
    beginnings: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    constant: float = PRIOR_CONSTANT

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.log1p(counts) @ self.weights + self.constant)))


# Learning


def pattern_counts(rows: DataFrame, text_col: str, toxic_col: str, half_col: str) -> DataFrame:
    """(pattern, whole, n, toxic, n1, toxic1): texts that hold a word, or a longer word with that beginning, how many are
    toxic, and both for the texts of half 1."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"(\p{L}+)"), 1))
    begin = lambda n: F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.substring(w, 1, n))
    # as strings, whole words behind an equals sign: structs would be compared each with each
    found = F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("="), w)), *[begin(n) for n in BEGINNINGS]))
    toxic, half = F.col("__t"), F.col("__h")
    rows = rows.select(F.explode(found).alias("__p"), F.col(toxic_col).cast("long").alias("__t"), F.col(half_col).cast("long").alias("__h"))
    counts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.sum(toxic).alias("toxic"), F.sum(half).alias("n1"), F.sum(half * toxic).alias("toxic1"))
    return counts.select(F.ltrim(F.col("__p"), F.lit("=")).alias("pattern"), F.startswith("__p", F.lit("=")).alias("whole"), "n", "toxic", "n1", "toxic1")


def strength(n: int, toxic: int, rate: float) -> int | None:
    """The class of a pattern that toxic of n texts hold, if it is one of insult."""
    sure = (toxic + rate) / (n + 1)
    if toxic < LEAST or sure < SHARE:
        return None
    return STRONG if toxic >= 8 and sure >= 0.9 else MIDDLE if toxic >= 4 and sure >= 0.8 else WEAK


def regress(counts: np.ndarray, toxic: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Newton's method for logistic weights, drawn towards the prior ones."""
    x = np.column_stack([np.log1p(counts), np.ones(len(counts))])
    prior = np.append(PRIOR, PRIOR_CONSTANT)
    pull = np.append(np.full(len(PRIOR), ridge), 1e-3)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - toxic) + pull * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w = w - step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample: int = SAMPLE, patterns: int = PATTERNS, seed: int = 13) -> Model:
    """A model learned from the rows where learn holds, of about `sample` distinct texts at most."""
    known = labels.where(F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(toxic_col) == 1).cast("int")).alias("__toxic"))
    n = known.count()
    below = min(2**63 - 1, int(min(1.0, sample / max(1, n)) * 2**64) - 2**63)
    text = docs.where(learn & F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    few = text.where(F.xxhash64("__text", F.lit(seed)) <= below).join(known, "__id")
    few = few.groupBy("__text").agg(F.max("__toxic").alias("__toxic"))
    few = few.withColumn("__half", F.pmod(F.xxhash64("__text", F.lit(seed + 1)), F.lit(2)))
    rate = few.agg(F.avg("__toxic")).first()[0]
    if rate is None:
        return Model()
    share = (F.col("toxic") + rate) / (F.col("n") + 1)
    likely = pattern_counts(few, "__text", "__toxic", "__half").where(F.col("toxic") >= LEAST)
    best = likely.orderBy((share * F.log1p("toxic")).desc(), "pattern", "whole").limit(patterns).collect()

    def lexicon(count) -> Model:
        out = Model()
        for r in best:
            kind = strength(*count(r), rate)
            if kind is not None:
                (out.words if r["whole"] else out.beginnings)[r["pattern"]] = kind
        return out

    # the weights are learned from what the patterns of one half find in the other, else chance patterns would look sure
    halves = [lexicon(lambda r: (r["n1"], r["toxic1"])), lexicon(lambda r: (r["n"] - r["n1"], r["toxic"] - r["toxic1"]))]
    seen = [r for k, m in enumerate(halves) for r in _count(few.where(F.col("__half") == k), m, "__text", ["__toxic"]).groupBy("counts", "__toxic").count().collect()]
    counts = np.array([r["counts"] for r in seen], float)
    times = np.array([r["count"] for r in seen])
    model = lexicon(lambda r: (r["n"], r["toxic"]))
    model.weights, model.constant = regress(np.repeat(counts, times, 0), np.repeat([r["__toxic"] for r in seen], times))
    return model


def _count(df: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    schema = StructType([*[df.schema[c] for c in keep], *StructType.fromDDL("counts array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.words, model.beginnings)
        for b in pieces(batches, text_col):
            counts = [events(t, lexicon).astype(np.int32) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(counts, pa.list_(pa.int32()))], names=schema.names)

    return map_batches(df.select(*keep, text_col), run, schema)


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all by default) with score and predicted."""
    keep = df.columns if keep is None else keep
    new_names(keep, "score", "predicted")
    schema = StructType([*[df.schema[c] for c in keep], StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.words, model.beginnings)
        for b in pieces(batches, text_col):
            counts = np.array([events(t, lexicon) for t in b.column(text_col).to_pylist()]).reshape(-1, len(KINDS))
            p = model.scores(counts)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return map_batches(df.select(*dict.fromkeys([*keep, text_col])), run, schema)
