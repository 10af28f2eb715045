from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from bizframe.models import registry
from bizframe.operators import access as A
from bizframe.operators import analytics as N
from bizframe.operators import ingest as I
from bizframe.operators import ledger as L
from bizframe.operators import lookup as J
from bizframe.operators import quality as Q
from bizframe.operators import recon as R
from bizframe.operators import sync as S
from bizframe.plans import registry as P
from bizframe.plans.domain import GATEWAY_OPERATORS


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_policy_and_registry(spark, sf):
    r = registry(spark, sf)
    assert r.checksum() == r.checksum()
    policies = [P.Policy("m", sequence=5), P.Policy("m", sequence=1), P.Policy("m", sequence=9, full_access=True)]
    assert P.effective_policy(policies, "m").full_access
    assert P.effective_policy(policies[:2], "m").sequence == 1
    assert P.role_of("sale.order") == "sales"
    assert P.state_groups(["done", "draft", "cancelled"]) == {"open": ["draft"], "closed": ["done"], "inactive": ["cancelled"]}
    frame, hidden = A.Access(r, P.Policy("res.partner", blocked=("c_acctbal",))).bundle("res.partner", fields=["c_name", "c_acctbal"])
    assert frame.columns == ["c_name"] and hidden == ["c_acctbal"]


def test_domain_errors(spark, sf):
    r = registry(spark, sf)
    with pytest.raises(ValueError):
        A.Access(r, operators=GATEWAY_OPERATORS).rows("org.unit", [["id", "child_of", 1]])
    with pytest.raises(ValueError):
        A.Access(r).rows("res.partner", [["nothing", "=", 1]])
    with pytest.raises(ValueError):
        A.Access(r).aggregate("res.partner", "c_name", "sum")


def test_predicates_on_null(spark):
    from bizframe.plans.domain import compare

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, v string")
    ids = lambda *leaf, **k: [x[0] for x in df.where(compare(F.col("v"), *leaf, **k)).orderBy("id").collect()]
    assert ids("=", False) == [2]
    assert ids("!=", "a") == [2, 3]
    assert ids("!=", "a", strict_null=True) == [3]
    assert ids("not in", ["a"]) == [2, 3]


def test_resolve_many_and_policies(spark):
    df = spark.createDataFrame([(1, ["a", "x", "b"]), (2, [])], "id int, keys array<string>")
    targets = spark.createDataFrame([("a", 10), ("b", 20)], "key string, t int")
    assert rows(J.resolve_many(df, "id", F.col("keys"), targets, "key", "t")) == [(1, [10, 20], ["x"]), (2, [], [])]
    flat = spark.createDataFrame([(1, "a"), (2, "x")], "id int, k string")
    kept, stubs = J.missing_keys(flat, targets, "k", "key", "skip")
    assert rows(kept.select("id", "k")) == [(1, "a"), (2, None)] and stubs.count() == 0
    assert rows(J.missing_keys(flat, targets, "k", "key", "create")[1]) == [("x",)]
    with pytest.raises(Exception, match="unresolved"):
        J.missing_keys(flat, targets, "k", "key", "stop")[0].collect()


def test_get_or_create_and_shares(spark):
    lots = spark.createDataFrame([(5, "p", "a")], "id int, product string, name string")
    wanted = spark.createDataFrame([("p", "a"), ("p", "b")], "product string, name string")
    assert rows(J.get_or_create(lots, wanted, ["product", "name"], "id")) == [(5, "p", "a"), (6, "p", "b")]
    df = spark.createDataFrame([(1, {"x": 60.0, "y": 40.0})], "id int, shares map<string,double>")
    m = spark.createDataFrame([("x", "z"), ("y", "z")], "source_key string, target_key string")
    assert J.remap_shares(df, "id", "shares", m).first()["shares"] == {"z": 100.0}


def test_match_by_text(spark):
    docs = spark.createDataFrame([(1, "Bill of ACME Tools, ref 9")], "id int, body string")
    examples = spark.createDataFrame([("acme tools",), ("acme tolls",)], "needle string")
    assert [r["needle"] for r in J.contains_match(docs, "body", examples, "needle").collect()] == ["acme tools"]


def test_recon_states(spark):
    state = lambda *x: spark.range(1).select(R.match_state(*map(F.lit, x))).first()[0]
    assert state(True, True, False, False) == "cancelled"
    assert state(False, False, False, True) == "mismatch"
    amount, error = R.proposal(F.lit(10.0), F.lit(7.0), F.lit("EUR"), F.lit("EUR"), False)
    assert spark.range(1).select(amount, error).first() == (None, "partial_not_allowed")
    assert spark.range(1).select(R.inverse_kind(F.lit("out_refund")), R.post_outcome(F.lit(True), F.lit(False))).first() == ("in_refund", "partially_posted")


def test_changes_and_guard(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, q double")
    b = spark.createDataFrame([(1, 2.5), (3, 1.0)], "k int, q double")
    changes = R.field_changes(a, b, ["k"], ["q"])
    assert rows(changes.select("k", "action")) == [(1, "update"), (2, "create"), (3, "delete")]
    ok, bad = R.guard(changes, ["k"], create=True, delete=False)
    assert rows(bad) == [(3, "deletion_not_allowed")] and ok.count() == 2


def test_counterparts(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "ref string")
    old = spark.createDataFrame([("a", 1, "cancel"), ("b", 2, "posted"), ("c", 3, "draft")], "ref string, id int, state string")
    assert rows(R.create_or_link(wanted, old, "ref", "id", "state")) == [("a", None, "create"), ("b", 2, "read_only"), ("c", 3, "link")]


@pytest.mark.parametrize("mode, policy, known, new", [("create", "skip", "skip", "create"), ("create", "error", "error", "create"), ("update", "update", "update", "skip"), ("create_update", "update", "update", "create")])
def test_upsert_matrix(spark, mode, policy, known, new):
    got = spark.range(1).select(I.upsert_action(F.lit(True), mode, policy), I.upsert_action(F.lit(False), mode, policy)).first()
    assert tuple(got) == (known, new)


def test_sync_pieces(spark):
    identity = spark.createDataFrame([("m", "1", "t", 100, True)], "source_model string, source_record_id string, target_model string, target_record_id long, active boolean")
    src = spark.createDataFrame([(1, None), (2, 1)], "id long, parent long")
    assert rows(S.resolve_parent(src, identity, "m", "parent").select("id", "parent_target_id")) == [(1, None), (2, 100)]
    created = spark.createDataFrame([(1, 100), (2, 200)], "id long, tid long")
    assert S.extend_map(identity, created, "m", "id", "t", "tid").count() == 2
    q = S.queue(spark.createDataFrame([("k", ["a"])], "k string, items array<string>"), spark.createDataFrame([("k", ["b", "a"])], "k string, items array<string>"), ["k"], "items")
    assert q.first()["items"] == ["a", "b"]
    current = spark.createDataFrame([(1, "x", None), (None, "n", "m")], "k int, a string, b string")
    changes = spark.createDataFrame([(1, None, "y"), (None, "z", None), (3, "w", None)], "k int, a string, b string")
    assert rows(S.upsert_fields(current, changes, ["k"])) == [(1, "x", "y"), (3, "w", None), (None, "z", "m")]
    assert S.checkpoint(src, "id", "j").first() == ("j", 2, 2)


def test_ledger_pieces(spark):
    ok = lambda a, b: spark.range(1).select(L.allowed_transition(F.lit(a), F.lit(b))).first()[0]
    assert ok("failed", "pending") and not ok("done", "pending")
    ledger = spark.createDataFrame([(1, "error", False, None)], "id int, kind string, resolved boolean, resolved_at timestamp")
    more = L.append_events(ledger, spark.createDataFrame([(1, "x"), (2, "y")], "id int, kind string"), "id")
    assert rows(more.select("id", "kind")) == [(1, "error"), (2, "y")]
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    assert L.resolve_events(ledger, ledger, "id", at).first()["resolved"]
    rules = spark.createDataFrame([(1, "a", "b", "t", None, True), (2, "a", "b", "t", "p", True)], "rule_id int, source_company string, destination_company string, trigger string, partner string, active boolean")
    docs = spark.createDataFrame([(1, "a", "b", "t", "p"), (2, "a", "b", "t", "q")], "doc int, source_company string, destination_company string, trigger string, partner string")
    assert rows(L.applicable_rules(docs, rules, "doc")) == [(1, 2, False), (2, 1, False)]


def test_quality_pieces(spark):
    df = spark.createDataFrame([(1, "", 0), (2, "x", None)], "id int, name string, n int")
    assert rows(df.select("id", Q.missing_labels({"name": "Name", "n": "Number"}))) == [(1, ["Name"]), (2, ["Number"])]
    ops = Q.Operators()
    ops.add("one", lambda n: spark.range(n), {"n": int})
    ops.add("risky", lambda: spark.range(1), {}, approval=True)
    got = ops.plan([("one", {"n": 3}), ("one", {"n": "3"}), ("risky", {}), ("none", {})])
    assert got[0][1].count() == 3 and [bool(e) for _, _, e in got] == [False, True, True, True]


def test_forecast_needs_two(spark):
    b = spark.createDataFrame([("k", 0, date(2024, 1, 1), 5.0)], "k string, n int, period date, value double")
    assert N.forecast(b, ["k"]).count() == 0


def test_allocation_stops_at_target(spark):
    lines = spark.createDataFrame([("d", 1, 5.0, 8.0), ("d", 2, 5.0, 8.0), ("d", 3, 5.0, 8.0)], "d string, n int, open double, target double")
    assert rows(R.allocate(lines, ["d"], "open", "target", ["n"]).select("n", "allocated")) == [(1, 5.0), (2, 3.0)]


def test_contains_match_without_word_borders(spark):
    texts = ["bench passagesX", "a??b", "Xone inner twoY", "inner", "", None]
    needles = ["bench passages", "??", "one inner two", "passages", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, body string")
    examples = spark.createDataFrame(list(enumerate(needles)), "e int, needle string")
    got = sorted((r["d"], r["e"]) for r in J.contains_match(docs, "body", examples, "needle").collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if t is not None and n is not None and n in t.lower())
