import io
import zipfile

from bizframe.sources import readers as S
from bizframe.sources import writers as W
from bizframe.streaming import jobs


def workbook():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1">{cell("A1", "Full Name")}{cell("B1", "Qty")}</row><row r="2">{cell("A2", "x")}<c r="B2"><v>3</v></c></row><row r="3"><c r="A3"/></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "b.txt").write_text("hi")
    found = S.files(spark, str(tmp_path), "*")
    assert {(r["name"], r["kind"]) for r in found.collect()} == {("a.xlsx", "excel"), ("b.txt", "text")}
    rows = S.choose_sheet(S.read_workbooks(found.where("kind = 'excel'")), "one").collect()
    assert [(r["row_number"], r["values"]["full_name"], r["values"]["B"]) for r in rows] == [(2, "x", "3")]
    cache = found.selectExpr("path", "sha2(content, 256) AS checksum").limit(1)
    assert S.new_files(found, cache).count() == 1


def test_csv_json_series(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("A b\tA b\t\n1\t2\t3\n\t\t\n")
    df = S.read_csv(spark, str(tmp_path / "t.tsv"))
    assert df.columns == ["a_b", "a_b_2", "column_3"] and df.count() == 1
    (tmp_path / "t.json").write_text('[{"a": 1}, {"b": 2}]')
    assert sorted(S.read_json(spark, str(tmp_path / "t.json")).columns) == ["a", "b"]
    raw = [("s", '{"observations": [{"date": "2024-01-01", "value": "1.5"}, {"date": "x", "value": "2"}]}'), ("t", '[["2024-02-01", 3]]')]
    got = S.series_points(spark.createDataFrame(raw, "k string, payload string"), "payload", ["k"]).collect()
    assert sorted((r["k"], str(r["period_date"]), r["value"]) for r in got) == [("s", "2024-01-01", 1.5), ("t", "2024-02-01", 3.0)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    W.write_partitioned(df, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 'a'").count() == 1
    for _ in range(2):
        W.append_batch(df, str(tmp_path / "v"), "version", 1)
    W.append_batch(df, str(tmp_path / "v"), "version", 2)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 4
    W.export(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_streams(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "in")
    events.union(events).repartition(2).write.parquet(src)
    got = []
    once = jobs.once_each(jobs.arriving_rows(spark, src, events.schema), "event_id", "ts", "60 days")
    jobs.run_available(once.select("event_id"), lambda df, n: got.append(df.count()), str(tmp_path / "c1"))
    assert sum(got) == events.count()
    windows = jobs.windowed_counts(jobs.arriving_rows(spark, src, events.schema), "ts", ["event_type"], "value")
    jobs.append_to(windows, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    seen = []
    jobs.incremental(spark, src, events.schema, "event_id", events.where("event_id % 2 = 0").select("event_id"), lambda df, n: seen.append(df.select("event_id").distinct().count()), str(tmp_path / "c3"))
    assert sum(seen) >= events.where("event_id % 2 = 1").count()
