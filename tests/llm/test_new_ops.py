"""Alignment, filter audit and toxicity: brute force, held-out accuracy, and the cases of the docstrings."""

import bisect
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from bizframe.llm import align, filter_audit, queries, toxicity
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, score string, n_a long, mask string, counts int"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, x, "s", 1, "m", 2) for i, t, x in rows], DOCS).repartition(3)


# Alignment


def brute_alignment(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, digest of every text, by plain loops over whole encodings."""
    sides = align.ByteLevel(queries.tokenizer_path(queries.ALIGNED[0])), align.Pieces(queries.tokenizer_path(queries.ALIGNED[1]))
    found, held = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        ids = [sides[0].library.encode(" " + (text or ""), add_special_tokens=False).ids, sides[1].library.encode(text or "")]
        raw = [[side.bytes[i] for i in own] for side, own in zip(sides, ids)]
        if not text or any(b"".join(r) != want for r in raw):
            found.append(None)
            continue
        ends = [list(itertools.accumulate(map(len, r))) for r in raw]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k in (0, 1):
            for end, i in zip(ends[k], ids[k]):
                groups[bisect.bisect_left(cuts, end)][k].append(i)
        links = Counter(p for a, b in groups for p in itertools.product(a, b))
        held.update(links.keys())
        found.append((len(ids[0]), len(ids[1]), groups, links))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for x in found:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        top = sum(n for (a, b), n in links.items() if held[a, b] == best[a])
        out.append((n_a, n_b, len(groups), sum(links.values()), top, sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  ", "a", " a", "a ", "\n", "a\n b", "\n \n", "é🙂", "<|endoftext|> x", "▁", "a▁b", "x" * 5000, "<s> <unk> <0x0A>", "日本 語", "\x00", "a\x00 b", "\t \x85 \xa0 x", "a  b", "don't  we'll", "word " * 3000]


def odd_texts(n):
    rng = random.Random(0)
    parts = ["a", " ", "  ", "\n", "é", "🙂", "the", "Σ", "\x1c", "'s", "12", "日本", "　", "\xa0", "!!", "<s>", "tion"]
    return ODD + ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("most", [align.MOST, 5])
def test_alignment_of_odd_texts(spark, most):
    texts = odd_texts(400)
    df = docs_of(spark, [(k, t, "en") for k, t in enumerate(texts)] + [(3, "the same", "en")] * 3).drop("n_a")
    texts += ["the same"] * 3
    got = sorted(tuple(r) for r in align.align(df, *map(queries.tokenizer_path, queries.ALIGNED), keep=["doc_id"], most=most).collect())
    assert got == sorted((i, *x) for i, x in zip([*range(len(texts) - 3), 3, 3, 3], brute_alignment(texts)))


def test_alignment_of_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], brute_alignment([r["text"] for r in rows])))
    df = queries.op11_align(spark, sf)
    assert df.columns == ["doc_id", *NAMES]
    assert {r[0]: tuple(r[1:]) for r in df.collect()} == want


def test_alignment_keeps_few_words(spark, monkeypatch):
    aligner = align.aligner_of(*map(queries.tokenizer_path, queries.ALIGNED))
    texts = ["one two three", "two three four", "five two", "one", "x " * 9, "two three six seven eight"] * 2
    want = [tuple(x[:4]) + (x[6],) for x in brute_alignment(texts)]
    monkeypatch.setattr(align, "KEEP", 6)
    for t, w in zip(texts, want):
        own = align.Texts(aligner, [t])
        assert (*[int(own.sums(c)[0]) for c in aligner.sizes.T], own.digests()[0]) == w
    assert len(aligner.number) < 20


def test_alignment_names_and_empty(spark):
    paths = list(map(queries.tokenizer_path, queries.ALIGNED))
    with pytest.raises(ValueError, match="there already"):
        align.align(docs_of(spark, [(1, "a", "en")]), *paths)
    assert align.align(docs_of(spark, []), *paths, keep=["doc_id", "score"]).count() == 0


# Filter audit


def brute_audit(rows, labels):
    flags = {}
    for i, quality, toxic in labels:
        if i is not None:
            old = flags.get(i, (0, 0))
            flags[i] = (max(old[0], quality == 1), max(old[1], toxic == 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, part in rows:
        t = t or ""
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        fails.append((part or "", {f for f, on in (("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)), ("D", any(c in "#$%&*|" for c in t)), ("E", i is not None and first[t] < i)) if on}, flags.get(i, (0, 0))))
    out = []
    for part in {p for p, _, _ in fails}:
        own = [x for x in fails if x[0] == part]
        shapley, rows_of_part = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, f in enumerate(order):
                before = set(order[:s])
                removed = [x for x in own if f in x[1] and not x[1] & before]
                shapley[f] += len(removed)
                rows_of_part.append((part, order, s + 1, sum(not x[1] & (before | {f}) for x in own), len(removed), sum(f in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {f} for x in own), sum(x[2][0] for x in removed), sum(x[2][1] for x in removed)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows_of_part]
    return sorted(out)


def audit_of(docs, labels):
    filters = filter_audit.text_filters(F.coalesce("text", F.lit("")))
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return filter_audit.audit(filter_audit.mask_cells(docs, labels, filters, F.col("lang"), flags), "ABCDE", list(flags))


def test_audit_is_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "Bc", "XYZ", "d%", "e", "f\tg", "\x85", "\x1c"]
    rows = [(k % 40 if k % 11 else None, rng.choice([None, "", "same", " ".join(f"w{j}" for j in range(rng.choice([90, 120]))), " ".join(rng.choices(words, k=rng.randint(1, 130)))]), rng.choice(["en", None, "", "fr"])) for k in range(120)]
    rows += rows[:9] + [(7, "same", "en"), (7, "same", "fr")] + [(200 + k, "copies of one", "en") for k in range(60)]
    labels = [(rng.choice([None, *range(50)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    df = audit_of(docs_of(spark, rows), spark.createDataFrame(labels, LABELS))
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert dict(df.dtypes)["step"] == "int" and dict(df.dtypes)["shapley"] == "bigint"
    assert sorted(tuple(r) for r in df.collect()) == brute_audit(rows, labels)


def test_audit_of_orders_and_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert audit_of(docs_of(spark, []), labels).count() == 0
    long = docs_of(spark, [(1, "word " * 300_000, "en")])
    cells = filter_audit.mask_cells(long, labels, {"X": F.length("text") > 5}, F.lit("p"), {"good": F.col("quality") == 1})
    got = filter_audit.audit(cells, "XE", ["good"], orders=["XE"]).orderBy("step").collect()
    assert [(r["removed"], r["good_lost"], r["kept"]) for r in got] == [(1, 1, 0), (0, 0, 0)]


# Toxicity

LEX = toxicity.Lexicon({}, {"blurgh": toxicity.WEAK})


def kinds(text, lexicon=LEX):
    return {toxicity.KINDS[k]: int(n) for k, n in enumerate(toxicity.events(text, lexicon)) if n}


@pytest.mark.parametrize(
    "text, want",
    [
        ("You are an idiot.", {("strong", "aimed"): 1}),
        ("What an idiot you are", {("strong", "aimed"): 1}),
        ("Idiot! Moron. trash", {("strong", "plain"): 3}),
        ("He said you are an idiot. Fine.", {("strong", "said"): 1}),
        ("You are not an idiot.", {("strong", "denied"): 1}),
        ("It is not so, that she is, after all, an idiot", {("strong", "aimed"): 1}),
        ("not an idiot or moron", {("strong", "denied"): 1}),
        ("not an idiot but a moron", {("strong", "plain"): 1}),
        ("I will hurt you.", {("threat", "aimed"): 1}),
        ("Birds kill time; it hurts.", {}),
        ("blurghing fool", {("weak", "plain"): 1}),
        ("blurgh", {}),
        ("idiot idiot idiot", {("strong", "plain"): 1}),
        ("idiotic", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_clauses(text, want):
    assert kinds(text) == want


def test_composition_is_the_parts_in_turn():
    """The machine gives what the transducers give one after the other."""
    parts = [toxicity._marking(toxicity.SAID, "said", None), toxicity._marking(toxicity.NOT, "denied", toxicity.REACH), toxicity._target(), toxicity._threat(), toxicity._clause()]
    to, out = toxicity.machine()
    rng = random.Random(5)
    for _ in range(300):
        classes = rng.choices(range(toxicity.SAID + 1), k=12)
        state, own = 0, [p.start for p in parts]
        for kind in classes:
            symbol = (kind, frozenset())
            for k, p in enumerate(parts):
                own[k], symbol = p.step(own[k], symbol)
            assert out[state][kind] == (-1 if symbol is None else symbol)
            state = to[state][kind]


def test_learns_words_and_beginnings(spark):
    rng = random.Random(1)
    clean = [f"w{rng.randint(0, 300)}" for _ in range(2)]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        words = [f"wort{rng.choice('abcdefgh')}{rng.choice('xyzuv')}" for _ in range(30)] + clean
        if toxic:
            words[3] = "grumbelk" + rng.choice("abcde")
            words[20] = "zonk"
        rows.append((k, " ".join(words) + f" {k}", "en"))
        labels.append((k, 1, int(toxic)))
    rows += [(700 + k, "a copy with copyword in it", "en") for k in range(40)] + [(800, None, "en"), (801, "", "en"), (None, "zonk", "en")]
    labels += [(700 + k, 1, 1) for k in range(40)] + [(800, 0, 1), (801, 0, None), (5, None, None)]
    df, marks = docs_of(spark, rows).drop("score"), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(df, marks, F.col("doc_id") % 5 != 0)
    assert model.words["zonk"] == toxicity.STRONG and "copyword" not in model.words and "grumbelk" in model.beginnings
    got = toxicity.score(df, model, keep=["doc_id", "counts"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 600:
            assert r["predicted"] == (r["doc_id"] % 6 == 0)
    assert len({r["score"] for r in got if r["doc_id"] in (800, 801)}) == 1
    again = toxicity.fit(df, marks, F.col("doc_id") % 5 != 0)
    assert again.words == model.words and np.allclose(again.weights, model.weights)


def test_toxicity_defined_cases(spark):
    none = spark.createDataFrame([], LABELS)
    df = docs_of(spark, [(1, "you idiot", "en"), (1, "you idiot", "en"), (2, "x. " * 300_000 + "idiot", "en")]).drop("score")
    model = toxicity.fit(df, none, F.lit(True))
    got = toxicity.score(df, model, keep=["doc_id"]).collect()
    assert len(got) == 3 and got[0]["score"] != got[1]["score"] or len({r["score"] for r in got}) == 2
    assert toxicity.score(df.where("false"), model).count() == 0 and not toxicity.fit(df.where("false"), none, F.lit(True)).words
    with pytest.raises(ValueError, match="there already"):
        toxicity.score(df.withColumn("Score", F.lit(1)), model)


def test_op13(spark):
    """Held-out accuracy, and the flag, on the next larger tables."""
    sf = "/root/testdata/sf0.01"
    got = queries.op13_toxicity(spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and len(got) == 1000
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) >= 0.94 * len(held) and all(y for p, y in held if p)
