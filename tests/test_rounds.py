"""Operators in written rounds and with state: brute force, sizes that other ways can't reach, restarts."""

import os
import random
import shutil
from collections import defaultdict

import pytest

from bizframe.operators import constraints, contains, documents, numbering, sets
from bizframe.plans import hierarchy
from bizframe.streaming import jobs, retries
from pyspark.sql import functions as F

# Hierarchies


def walk(parents, start):
    """The rows above a row, itself first, until the top or a row passed before."""
    out = []
    while start in parents and start not in out:
        out.append(start)
        start = parents[start]
    return out


@pytest.fixture(scope="module")
def forest():
    """Chains, broad rows, cycles, parents that are no rows."""
    rng = random.Random(2)
    parents = {k: (rng.randint(0, k - 1) if k % 9 else None) for k in range(40)}
    parents |= {200 + k: 199 + k for k in range(1, 16)} | {200: None, 300: 301, 301: 302, 302: 300, 303: 302, 304: 303, 400: 999, 401: 400}
    return parents


def frame_of(spark, parents):
    rows = list(parents.items()) + [(5, parents[5]), (None, 3)]
    return spark.createDataFrame(rows, "id long, parent long").repartition(3)


def marks_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "x long")


@pytest.mark.parametrize("levels", [6, 0])
def test_walks_are_brute_force(spark, forest, monkeypatch, levels):
    monkeypatch.setattr(hierarchy, "LEVELS", levels)
    df = frame_of(spark, forest)
    roots = {k for k, p in forest.items() if p not in forest}
    way = {k: walk(forest, k) for k in forest}
    for marks in (None, [0, 30, 31, 205, 210, 301, 400, 7777]) if levels else ([0, 30, 210],):
        want = {}
        for k, up in way.items():
            for steps, a in enumerate(up):
                if a in (roots if marks is None else marks):
                    want[k] = (a, steps)
                    break
        got = hierarchy.nearest(df, "id", "parent", None if marks is None else marks_of(spark, marks)).collect()
        assert len(got) == len(want) and {r["id"]: (r["near"], r["distance"]) for r in got} == want
    if levels:  # the closures go the same way for any number of levels
        return
    starts = [39, 214, 304, 401, 8888]
    above = {a for s in starts for a in way.get(s, [])}
    assert sorted(r["id"] for r in hierarchy.ancestors(df, "id", "parent", marks_of(spark, starts)).collect()) == sorted(above)
    pairs = lambda d: sorted((r["ancestor"], r["id"]) for r in d.collect())
    all_pairs = sorted((a, k) for k, up in way.items() for a in up)
    assert pairs(hierarchy.closure(df, "id", "parent")) == all_pairs
    assert pairs(hierarchy.closure(df, "id", "parent", marks_of(spark, starts))) == [p for p in all_pairs if p[1] in starts]
    assert pairs(hierarchy.closure(df, "id", "parent", marks_of(spark, [0, 30, 210, 301, 302]), down=True)) == [p for p in all_pairs if p[0] in (0, 30, 210, 301, 302)]


def test_hierarchy_beyond_a_million_rows(spark):
    """A chain of 400, a broad root with 600,000 rows below, two levels of 700,000, a cycle. BIG_TESTS=1: 5 million, chain 200,000."""
    big = 5 if os.environ.get("BIG_TESTS") else 1
    chain = 200_000 if big > 1 else 400
    broad, flat = 500_000 * big, 350_000 * big
    df = spark.range(chain).selectExpr("id", "id - 1 AS parent").where("id > 0").unionByName(spark.range(1).selectExpr("id", "CAST(NULL AS LONG) AS parent"))
    df = df.unionByName(spark.range(broad).selectExpr("10000000 + id AS id", f"{chain - 1} AS parent"))
    df = df.unionByName(spark.range(2 * flat).selectExpr("20000000 + id AS id", f"CASE WHEN id >= {flat} THEN 20000000 + id - {flat} END AS parent"))
    df = df.unionByName(spark.range(1000).selectExpr("90000000 + id AS id", "90000000 + (id + 1) % 1000 AS parent"))
    near = hierarchy.nearest(df, "id", "parent")
    r = near.agg(F.count("id").alias("n"), F.max("distance").alias("deep"), F.count_if(F.col("id") >= 90_000_000).alias("round")).first()
    assert (r["n"], r["deep"], r["round"]) == (chain + broad + 2 * flat, chain, 0)
    below = hierarchy.nearest(df, "id", "parent", marks_of(spark, [5]))
    assert below.agg(F.count("id"), F.max("distance")).first()[:] == (chain - 5 + broad, chain - 5)
    assert hierarchy.ancestors(df, "id", "parent", marks_of(spark, [10_000_007])).count() == chain + 1


def test_empty_hierarchy(spark):
    none = spark.createDataFrame([], "id long, parent long")
    assert hierarchy.nearest(none, "id", "parent").count() == hierarchy.closure(none, "id", "parent").count() == 0
    assert hierarchy.ancestors(none, "id", "parent", marks_of(spark, [1])).count() == 0


# Containment


def test_contains_is_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abÀ é🙂-", k=n))
    texts = [None, "", "a", *[word(rng.randint(1, 60)) for _ in range(120)], "x" * 50_000 + "Needle in hay" + "y" * 50_000]
    phrases = [None, "", "NEEDLE IN hay", "à", "🙂", *[word(rng.randint(1, 8)) for _ in range(60)], *[t[3:12].upper() for t in texts if t and len(t) > 30], "x" * 200]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(500, texts[10])], "d long, body string").repartition(3)
    ex = spark.createDataFrame([(k, p) for k, p in enumerate(phrases)] + [(900, phrases[7])], "e long, phrase string")
    want = sorted((d, e) for d, t in [*enumerate(texts), (500, texts[10])] for e, p in [*enumerate(phrases), (900, phrases[7])] if t and p and p.lower() in t.lower())
    for q, judged in ((5, 20_000), (3, 7)):
        assert sorted((r["d"], r["e"]) for r in contains.contains_join(df, "body", ex, "phrase", q, judged).collect()) == want
    assert contains.contains_join(df, "body", ex.where("phrase is null"), "phrase").count() == 0 == contains.contains_join(df.where("false"), "body", ex, "phrase").count()


def test_phrases_do_not_meet_texts_all_to_all(spark):
    df, ex = spark.createDataFrame([(1, "some text")], "d long, body string"), spark.createDataFrame([(1, "ext")], "e long, phrase string")
    plan = contains.contains_join(df, "body", ex, "phrase")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


PARTNERS = [(1, "Acme Tools", "DE1", "Main Street 5"), (2, "Acme", "DE2", "Side Road"), (3, "Beta GmbH", "DE3", "Main Street 51"), (4, "Beta GmbH", None, None), (5, "acme", "DE2", " ")]


@pytest.mark.parametrize("several", ["first", "error"])
def test_cascade(spark, several):
    p = spark.createDataFrame(PARTNERS, "id long, name string, vat string, street string")
    rows = [(1, "de2", None, None), (2, " DE3 ", "Acme", None), (3, "", "tools", None), (4, None, "ACME", None), (5, None, None, "main street"), (6, "XX", "zzz", "side"), (7, None, None, None), (8, "", " ", "street 51"), (8, "", " ", "street 51")]
    df = spark.createDataFrame(rows, "k long, vat string, name string, street string")
    steps = [contains.Step(p, "vat", "vat", "equal", several), contains.Step(p, "name", "name", "contains", several), contains.Step(p, "street", "street", "contains", several)]
    got = sorted(((r["k"], r["match_id"], r["matched_by"], r["match_error"]) for r in contains.entity_cascade(df, "k", steps, "id", create=F.col("name").isNotNull()).collect()), key=str)
    two = (lambda i: (i, None)) if several == "first" else (lambda i: (None, "several"))
    want = [(1, two(2)[0], 1, two(2)[1]), (2, 3, 1, None), (3, 1, 2, None), (4, two(1)[0], 2, two(1)[1]), (5, two(1)[0], 3, two(1)[1]), (6, 2, 3, None), (7, None, None, "none"), (8, 3, 3, None), (8, 3, 3, None)]
    assert got == sorted(want, key=str)
    with pytest.raises(ValueError, match="unknown step"):
        contains.entity_cascade(df, "k", [contains.Step(p, "vat", "vat", "near")], "id")


def test_cascade_finds_names_in_texts(spark):
    p = spark.createDataFrame(PARTNERS, "id long, name string, vat string, street string")
    df = spark.createDataFrame([(1, "An offer of ACME TOOLS to us"), (2, "beta gmbh, here"), (3, "nothing")], "k long, body string")
    got = {r["k"]: (r["match_id"], r["match_error"]) for r in contains.entity_cascade(df, "k", [contains.Step(p, "name", "body", "within")], "id").collect()}
    assert got == {1: (1, None), 2: (3, None), 3: (None, "none")}


# Sets


def weak(members, seed):
    return F.xxhash64(*members) % 2


@pytest.mark.parametrize("mark", [sets.fingerprint, weak])
def test_set_classes(spark, mark):
    rng = random.Random(8)
    own = {k: {rng.choice([None, "a", "b", "c"]) for _ in range(rng.randint(1, 4))} for k in range(60)}
    rows = [(k, m) for k, s in own.items() for m in s] * 2
    df = spark.createDataFrame(rows, "id long, m string").repartition(3)
    by_set = defaultdict(list)
    for k, s in own.items():
        by_set[frozenset(s)].append(k)
    want = {k: (min(by_set[frozenset(s)]), len(by_set[frozenset(s)]), len(s)) for k, s in own.items()}
    assert {r["id"]: (r["class_id"], r["class_size"], r["set_size"]) for r in sets.set_classes(df, "id", ["m"], mark).collect()} == want
    assert sets.set_classes(df.where("false"), "id", ["m"]).count() == 0
    b = df.where("id % 3 = 0").withColumnRenamed("id", "b")
    got = {r["id"]: (r["b"], r["matches"]) for r in sets.same_set(df, b, "id", "b", ["m"]).collect()}
    assert got == {k: ((ids[0] if ids else None), len(ids)) for k, s in own.items() for ids in [sorted(x for x in by_set[frozenset(s)] if x % 3 == 0)]}


# Numbers


def test_numbers(spark):
    rows = [(k * 7919 % 10_007, "x") for k in range(5000)] + [(None, "x")]
    df = spark.createDataFrame(rows, "k long, v string").repartition(7)
    out = numbering.number_rows(df, ["k"], "n", 100)
    got = {r["k"]: r["n"] for r in out.collect()}
    assert got == {k: 100 + i for i, k in enumerate([None, *sorted(k for k, _ in rows if k is not None)])}
    assert got == {r["k"]: r["n"] for r in numbering.number_rows(df.repartition(2), ["k"], "n", 100).collect()}
    assert numbering.number_rows(df.where("false"), ["k"]).count() == 0
    equal = numbering.number_rows(df.withColumn("k", F.lit(1)), ["k"]).select("n").collect()
    assert sorted(r["n"] for r in equal) == list(range(5001))
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_columns_first_seen_in_order(spark):
    df = spark.createDataFrame([(2, {"c": 1}), (1, {"b": 1}), (3, {"a": 2, "b": 1})], "n int, m map<string,int>")
    assert sorted((r["position"], r["column"]) for r in documents.columns_first_seen(df, "m", "n").collect()) == [(0, "b"), (1, "c"), (2, "a")]


# Constraints

RULES = [constraints.Unique("a", ("x",), "kind <> 'free'"), constraints.Unique("b", ("y", "z")), constraints.Unique("c", ("z",), "x > 3")]


def brute_append(existing, batch):
    """In order, one row at a time."""
    claims = lambda r: [c for c in (("a", r[1]) if r[4] not in (None, "free") and r[1] is not None else None, ("b", r[2], r[3]) if r[2] is not None and r[3] is not None else None, ("c", r[3]) if r[1] is not None and r[1] > 3 and r[3] is not None else None) if c]
    held = {c for r in existing for c in claims(r)}
    accepted = []
    for r in sorted(batch):
        if not held & set(claims(r)):
            accepted.append(r)
            held |= set(claims(r))
    return accepted


@pytest.mark.parametrize("seed", range(3))
def test_append_in_order(spark, seed):
    rng = random.Random(seed)
    row = lambda k: (k, rng.choice([None, *range(12)]), rng.choice([None, *range(8)]), rng.choice([None, *range(8)]), rng.choice([None, "free", "bound"]))
    existing, batch = [row(-k) for k in range(8)], [row(k) for k in range(150)]
    schema = "id long, x int, y int, z int, kind string"
    ok, refused = constraints.append_unique(spark.createDataFrame(existing, schema), spark.createDataFrame(batch, schema).repartition(3), RULES, ["id"])
    want = brute_append(existing, batch)
    assert sorted((tuple(r) for r in ok.collect()), key=str) == sorted(want, key=str)
    lost = refused.collect()
    assert sorted(r["id"] for r in lost) == sorted(r[0] for r in batch if r not in want) and {r["constraint"] for r in lost} <= {"a", "b", "c"}


def test_append_of_single_claims_takes_one_pass(spark, monkeypatch):
    rng = random.Random(6)
    row = lambda k: (k, rng.choice([None, *range(15)]), rng.choice([None, *range(6)]), rng.choice([None, "a", "b", "free"]))
    existing, batch = [row(-k) for k in range(20)], [row(k) for k in range(200)] + [(300, 14, 5, "b")] * 2
    rules = [constraints.Unique("a", ("x",), "kind = 'a'"), constraints.Unique("b", ("x", "y"), "kind = 'b'")]
    claim = lambda r: ("a", r[1]) if r[3] == "a" and r[1] is not None else ("b", *r[1:3]) if r[3] == "b" and None not in r[1:3] else None
    held, want, lost = {claim(r) for r in existing} - {None}, [], []
    for r in batch:
        (lost if claim(r) in held else want).append(r if claim(r) not in held else (*r, claim(r)[0]))
        held |= {claim(r)} - {None}
    names, write = [], constraints.interim.write
    monkeypatch.setattr(constraints.interim, "write", lambda df, name, **counts: (names.append(name), write(df, name, **counts))[1])
    schema = "id long, x int, y int, kind string"
    ok, refused = constraints.append_unique(spark.createDataFrame(existing, schema), spark.createDataFrame(batch, schema).repartition(3), rules, ["id"])
    assert sorted(map(tuple, ok.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, refused.collect()), key=str) == sorted(lost, key=str) and len(lost) > 50
    assert names.count("won") == 1 and "claims" not in names and "lost" not in names


def test_append_of_hot_and_repeated_rows(spark):
    schema = "id long, x int, y int, z int, kind string"
    hot = spark.createDataFrame([(k, 1, k, k, "bound") for k in range(300)], schema)
    ok, refused = constraints.append_unique(hot.where("false"), hot, RULES, ["id"])
    assert [r["id"] for r in ok.collect()] == [0] and refused.count() == 299
    twice = spark.createDataFrame([(1, 1, 1, 1, "bound")] * 3, schema)
    ok, refused = constraints.append_unique(hot.where("false"), twice, RULES, ["id"])
    assert (ok.count(), refused.count()) == (1, 2)
    ok, refused = constraints.append_unique(hot, twice, [], ["id"])
    assert (ok.count(), refused.count()) == (3, 0)


# Retries

SCHEMA = "key string, ts timestamp, kind string, id long"


def write_events(spark, rows, path, parts):
    """The events in files, one after the other in time."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.parquet(f"{path}/part{k}")
        moved = [f for f in os.listdir(f"{path}/part{k}") if f.endswith(".parquet")][0]
        os.rename(f"{path}/part{k}/{moved}", f"{path}/{k:03d}.parquet")
        shutil.rmtree(f"{path}/part{k}")


def events_of(spark, n):
    import datetime as dt

    rng, t = random.Random(1), dt.datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        t += dt.timedelta(minutes=rng.choice([0, 1, 3, 7, 40]))
        rows.append((rng.choice("abcdefgh"), t, rng.choice(["failed", "failed", "failed", "done", "other"]), k))
    return rows


def test_stopped_and_resumed_stream_is_the_batch(spark, tmp_path):
    rows = events_of(spark, 240)
    args = {"key": "key", "ts": "ts", "kind": "kind", "id_col": "id", "most": 2, "minutes": 20.0, "factor": 2.0}
    want = retries.retry_actions(spark.createDataFrame(rows, SCHEMA), **args, late_minutes=30).collect()
    actions = lambda rs: sorted((r["key"], str(r["at"]), r["action"], r["attempt"]) for r in rs)
    src, hold = f"{tmp_path}/in", f"{tmp_path}/hold"
    os.makedirs(src)
    write_events(spark, rows, hold, 4)
    for k in range(4):  # each round is a query of its own that goes on from the checkpoint
        os.rename(f"{hold}/{k:03d}.parquet", f"{src}/{k:03d}.parquet")
        out = retries.retry_stream(jobs.arriving_rows(spark, src, spark.createDataFrame([], SCHEMA).schema), **args, late="30 minutes")
        jobs.append_to(out, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert actions(got) == actions(want) and {r["action"] for r in want} == {"retry", "give_up", "closed"}


def test_retry_actions_by_hand(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", at(0), "failed", 1), ("a", at(20), "failed", 2), ("a", at(50), "failed", 3), ("a", at(60), "failed", 4), ("a", at(70), "done", 5), ("b", at(10), "failed", 6), ("b", at(12), "done", 7), ("c", at(0), "done", 8), ("d", at(95), "failed", 9), ("e", at(100), None, 10), (None, at(1), "failed", 11)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["key"], (r["at"] - at(0)).seconds // 60, r["action"], r["attempt"]) for r in retries.retry_actions(df, "key", "ts", "kind", "id", most=2, minutes=10, factor=2, late_minutes=0).collect())
    assert got == [("a", 10, "retry", 1), ("a", 40, "retry", 2), ("a", 50, "give_up", 3), ("a", 70, "closed", 4), ("b", 12, "closed", 1)]


# Rows of a task


def test_tasks_follow_rows(spark, sf, monkeypatch):
    from bizframe import queries
    from bizframe.sources import interim

    monkeypatch.setattr(interim, "ROWS_A_TASK", 1000)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert interim.spread(spark.range(10), 5000, "id").rdd.getNumPartitions() == 6
    assert queries.allocations(spark, sf).rdd.getNumPartitions() == 1 + rows // 1000


def test_set_tasks_follow_rows(spark, monkeypatch):
    from bizframe.sources import interim

    monkeypatch.setattr(interim, "ROWS_A_TASK", 100)
    tasks = {}
    write = interim.write
    monkeypatch.setattr(interim, "write", lambda df, name, **counts: (tasks.__setitem__(name, df.rdd.getNumPartitions()), write(df, name, **counts))[1])
    df = spark.range(1000).selectExpr("id % 250 AS id", "id % 8 AS m")
    got = {tuple(r) for r in sets.set_classes(df, "id", ["m"]).collect()}
    want = {k: frozenset(i % 8 for i in range(1000) if i % 250 == k) for k in range(250)}
    first = {}
    for k in range(250):
        first.setdefault(want[k], k)
    assert got == {(k, first[s], sum(x == s for x in want.values()), len(s)) for k, s in want.items()}
    assert tasks["members"] == 11
    some = spark.sql("SELECT * FROM VALUES (CAST(null AS BIGINT), 1), (1, 1), (2, 2), (2, 1), (3, 2), (3, 1) AS t(id, m)")
    want = {(None, 1, 2, 1), (1, 1, 2, 1), (2, 2, 2, 2), (3, 2, 2, 2)}
    assert {tuple(r) for r in sets.set_classes(some, "id", ["m"]).collect()} == want
    assert {tuple(r) for r in sets.set_classes(some, "id", ["m"], lambda members, seed: F.lit(0).cast("bigint")).collect()} == want


def test_only_rows_with_rows_below_are_walked(spark, monkeypatch):
    from bizframe.sources import interim

    sizes, write = {}, interim.write
    monkeypatch.setattr(interim, "write", lambda df, name, **counts: (out := write(df, name, **counts), sizes.setdefault(name, out[1]["n"]))[0])
    df = spark.range(100).selectExpr("id", "CASE WHEN id > 1 THEN id % 2 WHEN id = 1 THEN -5 END AS parent")
    assert {tuple(r) for r in hierarchy.nearest(df, "id", "parent").collect()} == {(i, i % 2, int(i > 1)) for i in range(100)}
    assert sizes["inner"] == 2
