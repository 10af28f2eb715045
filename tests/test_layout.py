import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from bizframe.operators import words as W
from bizframe.sources import catalogue as C

BOX = "doc int, page int, {} long, text string, left double, top double, width double, height double"


KEYS = ["doc", "page"]


def paged(spark, native, words):
    return W.pages_of(spark.createDataFrame(native, BOX.format("n")), spark.createDataFrame(words, BOX.format("m")), KEYS)


def overlap(a, b):
    both = max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4])) * max(0, min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5]))
    return both / (a[6] * a[7] + b[6] * b[7] - both)


def test_box_pairs_against_all_pairs(spark):
    r = random.Random(5)
    box = lambda: (r.uniform(-50, 900), r.uniform(-20, 700), r.uniform(1, 260), r.uniform(1, 70))
    native = [(d, 0, n, "x", *box()) for d in range(3) for n in range(120)]
    native += [(1, 0, 900 + n, "x", 10.0**x, -(10.0**x), 20.0, 8.0) for n, x in enumerate((12, 15, 18, 20))]  # far beyond any page
    near = lambda a: tuple(v + r.uniform(-0.2, 0.2) * s for v, s in zip(a[4:], (a[6], a[7], a[6], a[7])))
    words = [(a[0], 0, m, "x", *near(a)) for m, a in enumerate(native)] + [(0, 0, 500 + m, "x", *box()) for m in range(60)]
    want = set()
    scored = [(overlap(a, b), a, b) for a in native for b in words if a[0] == b[0]]
    scored = [(o, a, b) for o, a, b in scored if o >= 0.5]
    for o, a, b in scored:
        best_a = min((-p, y[2]) for p, x, y in scored if x == a)
        best_b = min((-p, x[2]) for p, x, y in scored if y == b)
        if best_a[1] == b[2] and best_b[1] == a[2]:
            want.add((a[0], a[2], b[2], round(o, 9)))
    got = W.aligned_rows(W.align(paged(spark, native, words), KEYS), KEYS).where("how = 'box'").collect()
    assert len(want) > 150 and {(x["doc"], x["n"], x["m"], round(x["overlap"], 9)) for x in got} == want
    with pytest.raises(ValueError):
        W.align(paged(spark, native, words), KEYS, least=0.3)


def test_align_by_text_and_order(spark):
    at = lambda i: (i * 100.0, 0.0, 50.0, 10.0)
    no = (None, None, None, None)
    native = [
        (1, 0, 0, "Bill", *at(0)), (1, 0, 1, "no", *no), (1, 0, 2, "no", *no), (1, 0, 3, "O1", *no), (1, 0, 4, "end", *at(4)), (1, 0, 5, None, *no), (1, 0, 6, "x", *no),
        (2, 0, 0, "alone", *at(0)), (4, 0, 0, "b", *at(0)), (4, 0, 1, "a", *at(1)), (4, 0, 2, "z", *no),
    ]
    words = [
        (1, 0, 10, "Bi11", *at(0)), (1, 0, 11, "no", *no), (1, 0, 12, "01", *no), (1, 0, 13, "no", *no), (1, 0, 14, "end", *at(4)), (1, 0, 15, "y", *no),
        (3, 0, 7, "only", *at(0)), (4, 0, 0, "a", *at(1)), (4, 0, 1, "b", *at(0)), (4, 0, 2, "zz", *no),
    ]
    native += [x for x in native if x[2] == 0] + [(1, 0, None, "no position", *no)]  # words that are there twice
    pages = paged(spark, native, words)
    found = W.align(pages, KEYS)
    got = W.aligned_rows(found, KEYS)
    assert {(r["doc"], r["n"], r["m"], r["how"]) for r in got.collect()} == {
        (1, 0, 10, "box"), (1, 1, 11, "text"), (1, 2, 13, "text"), (1, 3, 12, "order"), (1, 4, 14, "box"), (1, 5, None, "native"), (1, 6, None, "native"), (1, None, 15, "recognised"),
        (2, 0, None, "native"), (3, None, 7, "recognised"),
        # columns read in another order: the gap of 'z' follows 'a', that of 'zz' follows 'b'
        (4, 0, 1, "box"), (4, 1, 0, "box"), (4, 2, None, "native"), (4, None, 2, "recognised"),
    }
    assert got.count() == 14
    texts = {r["doc"]: (r["n_words"], r["text"]) for r in W.merged_text(found).collect()}
    assert texts[1] == (8, "Bill no no O1 end y  x") and texts[3] == (1, "only")
    sums = {r["doc"]: r for r in W.agreement(found, ["doc"]).collect()}
    assert (sums[1]["n_box"], sums[1]["n_text"], sums[1]["n_order"], sums[1]["n_equal"]) == (2, 2, 1, 3)
    assert W.align(pages.where("false"), KEYS).count() == 0


def test_pages_counted_and_merged_in_place_equal_their_aligned_words(spark):
    r = random.Random(9)
    spot = lambda i: (i % 5 * 60.0 + r.uniform(-3, 3), i // 5 * 20.0, 50.0, 10.0) if r.random() < 0.6 else (None,) * 4
    side = lambda docs: [(d, d % 2, n, r.choice(["a", "b", "c", "", None]), *spot(n)) for d in docs for n in range(r.randrange(1, 25)) if r.random() < 0.8]
    pages = paged(spark, side(range(30)), side(range(5, 40))).union(spark.sql("SELECT 90, 0, array(), null")).coalesce(1)
    pages = pages.union(pages.where("doc = 7"))  # a page that stands twice
    found = W.align(pages, KEYS)
    got = W.page_agreement(pages, KEYS)
    assert "Generate" not in got._jdf.queryExecution().toString()  # no word becomes a row
    assert sorted(got.collect()) == sorted(W.agreement(found, KEYS).collect()) and got.where("n_order > 0 and n_recognised > 0").count() > 3
    assert sorted(W.page_texts(pages, KEYS).collect()) == sorted(W.merged_text(found).collect())
    assert W.page_agreement(pages.where("false"), KEYS).count() == W.page_texts(pages.where("false"), KEYS).count() == 0


def test_pages_are_not_shuffled(spark):
    pages = spark.range(1).selectExpr("1 AS doc", "id AS page", "array(named_struct('n', 1L, 'text', 'a', 'left', 0D, 'top', 0D, 'width', 9D, 'height', 9D)) AS native").selectExpr("*", "native AS words")
    assert "Exchange" not in W.align(pages, KEYS)._jdf.queryExecution().executedPlan().toString()


def test_catalogue(spark, tmp_path):
    pq.write_table(pa.table({"a": [1, None], "b": ["x", "y"], "c": [[1.0], None]}), tmp_path / "one.parquet")
    (tmp_path / "two.parquet" / "k=1").mkdir(parents=True)
    for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64())):
        pq.write_table(pa.table({"a": pa.array([None], kind)}), tmp_path / "two.parquet" / "k=1" / f"part-{i}.parquet")
    pq.write_table(pa.table({"a": pa.array([], pa.timestamp("us"))}), tmp_path / "three.parquet")
    pq.write_table(pa.table({"a": [1]}), tmp_path / "bare.parquet", write_statistics=False)
    (tmp_path / "two.parquet" / "_SUCCESS").write_text("")
    (tmp_path / "broken.parquet").write_text("no footer")
    (tmp_path / "_hidden.parquet").write_text("no footer")
    (tmp_path / "note.txt").write_text("no table")
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        rows = C.columns(C.scan(spark, path, ["one", "two", "three", "bare", "none"], files_a_task=2))
        got = {(r["table_name"], r["column_name"], r["position"], r["data_type"]): (r["n_files"], r["n_rows"], r["n_nulls"]) for r in rows.collect()}
        assert got == {
            ("one", "a", 1, "bigint"): (1, 2, 1), ("one", "b", 2, "string"): (1, 2, 0), ("one", "c", 3, "array<double>"): (1, 2, None),
            ("two", "a", 1, "bigint"): (3, 3, 3), ("two", "a", 1, "string"): (1, 1, 1), ("three", "a", 1, "timestamp_ntz"): (1, 0, 0), ("bare", "a", 1, "bigint"): (1, 1, None),
        }
    # the broken file is opened only where it is asked for
    assert C.scan(spark, str(tmp_path), prefix="t", files_a_task=2).where("n_rows > 0").count() == 3
    assert C.scan(spark, str(tmp_path), ["two"], files_a_task=2).rdd.getNumPartitions() == 2
    assert C.scan(spark, str(tmp_path), []).count() == 0
    with pytest.raises(Exception, match="broken|Parquet"):
        C.scan(spark, str(tmp_path)).collect()
    scan = C.scan(spark, str(tmp_path), ["one", "two"])
    one, two = scan.where("table_name = 'one'"), scan.where("table_name = 'two'")
    assert (one.union(two).count(), scan.count(), one.count()) == (5, 5, 3)
    wanted = spark.createDataFrame([("one", "a"), ("one", "q"), ("gone", "a")], "table_name string, column_name string")
    found = C.missing(C.scan(spark, str(tmp_path), ["one"]), wanted).collect()
    assert sorted(tuple(r) for r in found) == [("gone", "a", False, False), ("one", "a", True, True), ("one", "q", True, False)]


def test_footers_tell_what_the_columns_hold(spark, sf):
    names = ["orders", "documents", "embeddings", "nation", "events"]
    read = C.of_frames({t: spark.read.parquet(f"{sf}/{t}.parquet") for t in names}).where("data_type NOT LIKE 'array%'")
    footers = C.columns(C.scan(spark, sf, names)).where("data_type NOT LIKE 'array%'").select(*read.columns)
    assert read.count() == footers.count() and read.exceptAll(footers).isEmpty()
