"""Best examples, versions and levels against plain loops."""

import datetime as dt
import random

from bizframe.operators import examples, history, levels
from pyspark.sql import functions as F

DOCS = "doc_id int, type string, company int, provider int, language string, text string"
EXAMPLES = "example_id int, doc_id int, type string, company int, provider int, language string, partner_name string, reference_text string, use_count int, active boolean"


def test_phrases_of_other_types_are_no_candidates(spark):
    from bizframe.operators.contains import candidates

    texts = spark.createDataFrame([("a", "one two three"), ("b", "one two three")], "type string, text string")
    phrases = spark.createDataFrame([("a", "two"), ("b", "three"), ("c", "one")], "type string, phrase string")
    assert sorted(r["type"] for r in candidates(texts, "text", phrases, "phrase", same=("type",)).collect()) == ["a", "b"]


def test_best_examples_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    words = ["acme", "Beta", "tools", "R-1", "R-22", "x"]
    docs = [(k, rng.choice(["bill", "order", None]), rng.choice([None, 1, 2]), rng.choice([None, 1, 2]), rng.choice([None, "de", " EN ", ""]), rng.choice([None, "", " ", *[" ".join(rng.choices(words, k=6)) for _ in range(6)]])) for k in range(40)]
    ex = [(100 + k, rng.choice([None, *range(40)]), rng.choice(["bill", "order"]), rng.choice([None, 1, 2]), rng.choice([None, 1, 2]), rng.choice([None, "DE", "en", ""]), rng.choice([None, "", "Acme  beta", "tools"]), rng.choice([None, "r-22", "zz"]), rng.randint(0, 3), rng.random() < 0.9) for k in range(120)]
    norm = lambda t: " ".join((t or "").lower().split())
    lang = lambda t: (t or "").strip().lower()
    want = []
    for d in docs:
        if not norm(d[5]) or d[1] is None:
            continue
        scored = []
        for e in ex:
            if e[9] and e[2] == d[1] and e[1] != d[0] and e[3] in (None, d[2]):
                score = 10 + 10 * (d[3] is not None and d[3] == e[4]) + 15 * (bool(lang(d[4])) and lang(d[4]) == lang(e[5]))
                score += 40 * (bool(norm(e[6])) and norm(e[6]) in norm(d[5])) + 20 * (bool(norm(e[7])) and norm(e[7]) in norm(d[5]))
                scored.append((-score, -e[8], e[0]))
        want += [(d[0], r, e, -s) for r, (s, _, e) in enumerate(sorted(scored)[:3], 1)]
    got = examples.best_examples(spark.createDataFrame(docs, DOCS), spark.createDataFrame(ex, EXAMPLES), 3)
    assert sorted((r["doc_id"], r["rank"], r["example_id"], r["score"]) for r in got.collect()) == sorted(want)
    assert examples.best_examples(spark.createDataFrame([], DOCS), spark.createDataFrame(ex, EXAMPLES)).count() == 0


def test_best_examples_write_no_rows_of_phrases_found(spark, monkeypatch):
    """Many phrases stand in every text, blocks are small, and some documents have several examples of their own."""
    monkeypatch.setattr(examples, "TEXTS", 4000)
    monkeypatch.setattr(examples, "EXAMPLES", 50)
    monkeypatch.setattr(examples, "TOGETHER", 900)
    written = []
    write = examples.interim.write
    monkeypatch.setattr(examples.interim, "write", lambda *a, **k: (got := write(*a, **k), written.append(got[1]["n"]))[0])
    rng = random.Random(8)
    words = ["".join(rng.choices("abü", k=rng.randint(1, 12))) for _ in range(80)]
    docs = [(k, rng.choice(["bill", "order"]), rng.randint(0, 1), rng.randint(0, 1), rng.choice(["de", "en"]), " ".join(rng.choices(words, k=60))) for k in range(60)]
    ex = [(100 + k, rng.randint(0, 9), rng.choice(["bill", "order"]), rng.choice([None, 0, 1]), rng.randint(0, 1), rng.choice(["de", "en"]), " ".join(rng.choices(words, k=2)), rng.choice(words), rng.randint(0, 3), True) for k in range(300)]
    want = []
    for d in docs:
        scored = [
            (-10 - 10 * (d[3] == e[4]) - 15 * (d[4] == e[5]) - 40 * (e[6] in d[5]) - 20 * (e[7] in d[5]), -e[8], e[0])
            for e in ex if e[2] == d[1] and e[1] != d[0] and e[3] in (None, d[2])
        ]
        want += [(d[0], r, e, -s) for r, (s, _, e) in enumerate(sorted(scored)[:3], 1)]
    got = examples.best_examples(spark.createDataFrame(docs, DOCS), spark.createDataFrame(ex, EXAMPLES), 3)
    assert sorted((r["doc_id"], r["rank"], r["example_id"], r["score"]) for r in got.collect()) == sorted(want)
    assert sum(written) <= len(docs)


def test_a_documents_own_examples_leave_room_for_others(spark):
    docs = [(1, "bill", 1, 1, "de", "some text")]
    ex = [(k, 1 if k < 10 else 2, "bill", None, 1, "de", None, None, 20 - k, True) for k in range(14)]
    got = examples.best_examples(spark.createDataFrame(docs, DOCS), spark.createDataFrame(ex, EXAMPLES), 3)
    assert sorted(r["example_id"] for r in got.collect()) == [10, 11, 12]


def test_phrases_in_texts():
    from bizframe.operators.contains import Phrases

    rng = random.Random(1)
    for letters, longest in (("ab", 20), ("abcü ", 14), ("abcdefghij", 5)):
        for _ in range(30):
            phrases = list({"".join(rng.choices(letters, k=rng.randint(0, longest))).encode() for _ in range(60)})
            texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 5, 30, 200]))).encode() for _ in range(rng.choice([0, 1, 20]))]
            got = Phrases(phrases).within(texts)
            assert got[:, :-1].tolist() == [[bool(p) and p in t for p in phrases] for t in texts] and not got[:, -1].any()


def test_feedback(spark):
    docs = spark.createDataFrame([(1, True, "t1", "{}"), (2, True, "", "{}"), (3, False, "t3", "{}"), (4, True, "t4", None), (5, True, "t5", "{5}")], "doc_id int, reviewed boolean, text string, data string")
    old = spark.createDataFrame([(5, 7, "old", "{}"), (9, 2, "t9", "{}")], "doc_id int, use_count int, text string, data string")
    assert sorted(map(tuple, examples.captured(docs, old).collect())) == [(1, 0, "t1", "{}"), (5, 7, "t5", "{5}"), (9, 2, "t9", "{}")]


def test_versions(spark):
    """Random batches against a dictionary of versions; then a run taken back for some keys."""
    rng = random.Random(3)
    schema = "k int, state string"
    at = lambda n: F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(days=n))
    h, want = history.empty(spark.createDataFrame([], schema), ["k"]), {}
    for n in range(4):
        rows = [(k, rng.choice(["a", "b", None])) for k in [None, *range(8)] if rng.random() < 0.6]
        for k, s in rows:
            if k not in want or want[k][-1][1] != s:
                want.setdefault(k, []).append((n, s))
        # a row twice, and a smaller one of the same key, change nothing
        h = history.finalise(h, spark.createDataFrame(rows + rows[:1], schema), ["k"], at(n), f"run{n}")
        h = h.sparkSession.createDataFrame(h.collect(), h.schema)
    day = lambda t: None if t is None else (t - dt.datetime(2024, 1, 1)).days
    flat = lambda df: sorted(((r["k"], r["version"], day(r["valid_from"]), day(r["valid_to"]), r["state"]) for r in df.collect()), key=str)
    rows_of = lambda w: sorted(((k, i + 1, n, vs[i + 1][0] if i + 1 < len(vs) else None, s) for k, vs in w.items() for i, (n, s) in enumerate(vs)), key=str)
    assert flat(h) == rows_of(want)
    for n in range(5):
        then = {k: [v for v in vs if v[0] <= n][-1][1] for k, vs in want.items() if vs[0][0] <= n}
        assert {r["k"]: r["state"] for r in history.as_of(h, at(n)).collect()} == then
    # run3 again for keys 1 to 3, at day 9
    ids, changes = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "z"), (2, "a"), (7, "z")], schema)
    for k in (1, 2, 3):
        if k in want:
            want[k] = [v for v in want[k] if v[0] != 3]
    for k, s in ((1, "z"), (2, "a")):
        if not want.get(k) or want[k][-1][1] != s:
            want.setdefault(k, []).append((9, s))
    assert flat(history.rerun(h, ids, changes, ["k"], at(9), "run3")) == rows_of({k: v for k, v in want.items() if v})


def test_levels(spark):
    rng = random.Random(2)
    needs = [(k, rng.randint(0, k - 1)) for k in range(1, 40) for _ in range(2)] + [(50, 51), (51, 52), (52, 50), (53, 50), (54, 99), (55, 54), (56, 56), (57, None), (58, 3), (58, 3), (70, 1)]
    ids = [*range(40), *range(50, 59)]
    level = {}
    for _ in ids:
        for k in ids:
            own = [n for i, n in needs if i == k and n is not None]
            if k not in level and all(n in level for n in own):
                level[k] = 1 + max([level[n] for n in own], default=0)
    rows = spark.createDataFrame([(k, k % 3) for k in ids] + [(5, 2)], "id int, priority int")
    leveled = levels.levels(rows, spark.createDataFrame(needs, "id int, needs int"))
    got = {r["id"]: (r["level"], r["problem"]) for r in leveled.collect()}
    assert {k: v for k, (v, _) in got.items() if v} == level
    assert {k: p for k, (_, p) in got.items() if p} == {50: "cycle", 51: "cycle", 52: "cycle", 53: "cycle", 54: "missing", 55: "missing", 56: "cycle"}
    seen = []
    n = levels.run_levels(rows.distinct(), leveled, lambda df, at: seen.append((at, [(r["priority"], r["id"]) for r in df.collect()])))
    assert n == max(level.values()) and [at for at, _ in seen] == list(range(1, n + 1)) and all(own == sorted(own) for _, own in seen)


def test_scoped_rules_and_rates_by_month(spark):
    from bizframe.operators import lookup

    rules = spark.createDataFrame([(1, "all", "a0", 20, True), (2, "x", "ax", 30, True), (3, "y", "ay", 10, True), (4, "y", "late", 10, True), (5, "z", "off", 1, False), (6, "1", "one", 5, True)], "rule_id int, scope string, target_key string, sequence int, active boolean")
    df = spark.createDataFrame([("x", 2), ("y", 1), ("y", 2), ("z", 3), (None, 1), (None, None)], "s string, n int")
    got = [r["account"] for r in lookup.first_scoped_rule(df, rules, ["s", "n"], {"target_key": "account"}).collect()]
    assert sorted(got) == sorted(["a0", "one", "ay", "a0", "one", "a0"])
    assert [r["account"] for r in lookup.first_scoped_rule(df, rules.where("scope <> 'all'"), ["s"], {"target_key": "account"}).where("s = 'z'").collect()] == [None]
    rng = random.Random(1)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    rates = spark.createDataFrame([(c, "EUR", day(n), 1.0 + n / 1000) for c in ("USD", "GBP") for n in sorted(rng.sample(range(100, 900), 30))], "from_ccy string, to_ccy string, valid_from date, rate double")
    df = spark.createDataFrame([(k, rng.choice(["USD", "GBP", "EUR", "CHF", None]), 100.0, rng.choice([None, day(rng.randint(0, 1200))])) for k in range(300)], "k int, ccy string, v double, d date")
    a, b = ({r["k"]: r["out"] for r in lookup.as_of_convert(df, rates, "v", "ccy", "EUR", "d", "out", few=few).collect()} for few in (1000, 0))
    assert a == b and len(a) == 300 and sum(v is not None for v in a.values()) > 100


def test_driver_deals_lines_to_tasks_by_their_number(spark, monkeypatch):
    from bizframe.operators import driver

    monkeypatch.setattr(driver.interim, "ROWS_A_TASK", 100)
    write, largest = driver.interim.write, []

    def noted(df, name, **counts):
        out = write(df, name, **counts)
        if name == "lines":
            largest.extend(r["count"] for r in out[0].groupBy(F.input_file_name()).count().collect())
        return out

    monkeypatch.setattr(driver.interim, "write", noted)
    src = spark.range(400).selectExpr("id AS key", "'p' AS partner")
    built = src.selectExpr("key", "explode(sequence(1, 5)) AS line_key", "CAST(key % 7 AS int) AS product", "CAST(null AS string) AS error")
    existing = src.where("key % 2 = 0").selectExpr("key", "key + 1000 AS counterpart_id", "'draft' AS state", "partner")
    there = built.where("key % 2 = 0 AND line_key > 1").selectExpr("key", "line_key + 1 AS line_key", "product")
    versions = history.empty(spark.createDataFrame([], "key long, snapshot string"), ["key"])
    run = driver.sync(src, built, existing, there, versions, ["partner"], ["product"], F.lit(True), F.lit(dt.datetime(2024, 1, 1)), "a")
    got = {(r["action"], r["n"]): r["c"] for r in run.lines.groupBy("action", (F.col("counterpart_id") - F.col("key") == 1000).alias("n")).agg(F.count("key").alias("c")).collect()}
    assert sum(c for (a, _), c in got.items() if a == "create") == 1000 + 400 and got["keep", True] == 600 and got["delete", True] == 200
    assert len(largest) > 15 and max(largest) < 250  # about 100 each


def test_driver_and_its_rerun(spark):
    """A first run creates, a second over its results keeps all, a third changes what has changed."""
    from bizframe.operators import driver

    at = lambda n: F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(days=n))
    src = spark.createDataFrame([(1, "p", "ok"), (2, "q", "ok"), (3, "r", "no"), (4, "s", "ok"), (5, "t", "ok")], "key long, partner string, flag string")
    line = "key long, line_key int, product int, error string"
    built = spark.createDataFrame([(1, 1, 10, None), (1, 2, 20, None), (3, 1, 5, None), (4, 1, None, "no_product"), (5, 1, 1, None), (5, 1, 2, None), (9, 1, 1, None)], line)
    none = spark.createDataFrame([], "key long, counterpart_id long, state string, partner string")
    versions = history.empty(spark.createDataFrame([], "key long, snapshot string"), ["key"])
    args = (["partner"], ["product"], F.col("flag") == "ok")
    one = driver.sync(src, built, none, built.select("key", "line_key", "product").where("false"), versions, *args, at(1), "a")
    assert sorted((r["key"], r["counterpart_id"], r["action"]) for r in one.headers.collect()) == [(1, 1, "create"), (2, 2, "create")]
    assert sorted((r["key"], r["line_key"], r["action"], r["product"]) for r in one.lines.collect()) == [(1, 1, "create", 10), (1, 2, "create", 20)]
    assert sorted((r["key"], r["kind"], r["version"], r["error"]) for r in one.events.collect()) == [(1, "create", 1, None), (2, "create", 1, None), (4, "failed", None, "no_product"), (5, "failed", None, "line_key")]
    assert {r["key"]: r["n_lines"] for r in one.links.collect()} == {1: 2, 2: 0}
    existing = one.headers.select("key", "counterpart_id", F.lit("draft").alias("state"), "partner")
    lines = one.lines.select("key", "line_key", "product")
    two = driver.sync(src, built, existing, lines, one.history, *args, at(2), "b")
    assert {r["action"] for r in two.headers.collect()} == {r["action"] for r in two.lines.collect()} == {"keep"}
    assert {r["kind"] for r in two.events.where("error is null").collect()} == {"unchanged"} and two.history.count() == 2
    changed = spark.createDataFrame([(1, 2, 21, None), (1, 3, 30, None)], line)
    three = driver.sync(src, changed, existing, lines, two.history, *args, at(3), "c")
    assert sorted((r["line_key"], r["action"], r["product"]) for r in three.lines.collect()) == [(1, "delete", 10), (2, "update", 21), (3, "create", 30)]
    assert sorted((r["key"], r["version"], r["valid_to"] is None) for r in three.history.collect()) == [(1, 1, False), (1, 2, True), (2, 1, True), (4, 1, True), (5, 1, True)]  # which have no bad line any more


def test_taxes(spark):
    from bizframe.operators import driver

    lines = spark.createDataFrame([(1, 7, [2, 1]), (2, 7, [1, 9]), (3, 8, [1]), (4, 7, None), (5, 7, [])], "line_id int, company int, taxes array<int>")
    mapping = spark.createDataFrame([(7, 1, 5, 100), (7, 1, 2, 101), (7, 2, 1, 200)], "company int, tax int, sequence int, target int")
    got = {r["line_id"]: (r["taxes"], r["error"]) for r in driver.mapped_taxes(lines, mapping).collect()}
    assert got == {1: ([200, 101], None), 2: ([101], "tax 9"), 3: ([], "tax 1"), 4: ([], None), 5: ([], None)}
