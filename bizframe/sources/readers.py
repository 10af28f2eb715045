"""Files and remote tables as DataFrames. Everything is read by Spark's readers, also from stores that only Spark reaches."""

from __future__ import annotations

import csv
import importlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Fixed limits of tables that are uploaded to a chat, for read_workbooks(); other readers have none.
MAX_TABLES, MAX_ROWS = 5, 500
#: Which reader a file's extension has.
KINDS = {"csv": "csv", "tsv": "csv", "xlsx": "excel", "xlsm": "excel", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "txt": "text", "md": "text", "json": "json"}


def header_names(names: list[str]) -> list[str]:
    """Lower case, other signs than letters and digits as '_', empty ones by position, repeated ones numbered."""
    out: list[str] = []
    for i, n in enumerate(names, 1):
        base = re.sub(r"[^a-z0-9]+", "_", (n or "").strip().lower()).strip("_") or f"column_{i}"
        k, name = 1, base
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Comma or, for .tsv, tab; names normalised, blank rows dropped, all text."""
    separator = "\t" if path.lower().endswith(".tsv") else ","
    df = spark.read.csv(path, sep=separator, header=True, inferSchema=False, multiLine=True, escape='"')
    head = spark.read.text(path).first()  # Spark renames columns of equal names
    names = next(csv.reader([head[0]], delimiter=separator)) if head else []
    df = df.toDF(*header_names(names if len(names) == len(df.columns) else df.columns)).dropna("all")
    return df if max_rows is None else df.limit(max_rows)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, extension, kind, modificationTime, length, content of the files whose name fits."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.element_at(F.split(name, r"\."), -1))
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])[extension], F.lit("index"))
    return df.select("path", name.alias("name"), extension.alias("extension"), kind.alias("kind"), "modificationTime", "length", "content")


def decode_text(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def column_letters(i: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """sheet, row number from 1, cells as text, of the values of an .xlsx workbook."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in root.findall("m:si", ns)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns):
            target = targets[sheet.get(rel)].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for i, row in enumerate(root.iter(f"{{{ns['m']}}}row"), 1):
                cells: dict[int, str | None] = {}
                for c in row.findall("m:c", ns):
                    v, inline = c.find("m:v", ns), c.find("m:is", ns)
                    text = None if v is None else v.text
                    if c.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    elif inline is not None:
                        text = "".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t"))
                    cells[_column_number(c.get("r"))] = text
                if any(x and x.strip() for x in cells.values()):
                    yield sheet.get("name"), int(row.get("r") or i), [cells.get(k) for k in range(max(cells) + 1)]


def read_workbooks(found: DataFrame, max_tables: int | None = None, max_rows: int | None = None, header_row: int = 1) -> DataFrame:
    """files() of workbooks as rows: path, sheet, row_number, values (by header, and by column letters), blank rows left out. Limits on the
    sheets of a file and the rows of a sheet only where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: list[tuple[str, str, int, dict]] = []
                heads: dict[str, list[str]] = {}
                taken: dict[str, int] = {}
                for sheet, n, cells in workbook_rows(content):
                    if n == header_row:
                        heads[sheet] = header_names([x or "" for x in cells])
                    if n <= header_row or (max_tables and len(taken) >= max_tables and sheet not in taken) or (max_rows and taken.get(sheet, 0) >= max_rows):
                        continue
                    taken[sheet] = taken.get(sheet, 0) + 1
                    letters = {column_letters(i): x for i, x in enumerate(cells)}
                    out.append((path, sheet, n, letters | dict(zip(heads.get(sheet, []), cells))))
                cols = list(zip(*out)) or [[], [], [], []]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]
                arrays = [pa.array([list(v.items()) for v in c] if i == 3 else list(c), k) for i, (c, k) in enumerate(zip(cols, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "sheet", "row_number", "values"])

    return found.select("path", "content").mapInArrow(run, "path string, sheet string, row_number long, values map<string,string>")


def choose_sheet(rows: DataFrame, name: str | None) -> DataFrame:
    """The sheet of that name, whatever its case, else each file's first."""
    first = rows.groupBy("path").agg(F.min_by("sheet", F.struct("row_number", "sheet")).alias("first"), F.max(F.when(F.lower("sheet") == (name or "").lower(), F.col("sheet"))).alias("named"))
    return rows.join(first, "path").where(F.col("sheet") == F.coalesce("named", "first")).drop("first", "named")


def new_files(found: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose path and content the cache does not know."""
    return found.withColumn("checksum", F.sha2("content", 256)).join(cache.select("path", "checksum"), ["path", "checksum"], "left_anti")


def series_points(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """keys, period_date, value from JSON: {"observations": [{date, value}]}, a list of such, or a list of pairs; bad points are skipped."""
    c = F.col(payload)
    listed = F.when(F.trim(c).startswith("{"), F.get_json_object(c, "$.observations")).otherwise(c)
    points = df.select(*keys, F.explode(F.from_json(listed, "array<string>")).alias("p"))
    pair = F.from_json("p", "array<string>")
    when = F.coalesce(F.get_json_object("p", "$.date"), F.get(pair, F.lit(0)))
    value = F.coalesce(F.get_json_object("p", "$.value"), F.get(pair, F.lit(1)))
    return points.select(*keys, when.try_cast("date").alias("period_date"), value.try_cast("double").alias("value")).where("period_date is not null and value is not null")


def backend_of(options: dict):
    """The connector that an option names as 'module:attribute'; a class is made without arguments."""
    module, _, attribute = options["backend"].partition(":")
    found = getattr(importlib.import_module(module), attribute)
    return found() if isinstance(found, type) else found


class KeysetReader(DataSourceReader):
    """A remote table by ranges of its ids, each read page by page: the next page begins behind the last id of the one before."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = [f.name for f in schema], options

    def partitions(self) -> list[InputPartition]:
        last, top, n = int(self.options.get("after", 0)), backend_of(self.options).top(), int(self.options.get("partitions", 8))
        edges = [last + (max(top, last) - last) * k // n for k in range(n + 1)]
        return [InputPartition((a, b)) for a, b in zip(edges, edges[1:]) if a < b] or [InputPartition((last, last))]

    def read(self, partition: InputPartition):
        backend, batch, id_name = backend_of(self.options), int(self.options.get("batch", 500)), self.options.get("id", "id")
        after, upto = partition.value
        while after < upto and (page := backend.search(after, upto, batch)):
            for row in page:
                yield tuple(row.get(n) for n in self.names)
            after = page[-1][id_name]


class KeysetSource(DataSource):
    """format('keyset'): options backend (module:attribute, importable on every machine), id, after (watermark), batch, partitions.

    A backend has schema() -> DDL text, top() -> largest id, and search(after, upto, limit) -> the rows with
    after < id <= upto as dictionaries, the smallest ids first, at most limit."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self):
        return backend_of(self.options).schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        return KeysetReader(schema, self.options)


def connect(spark: SparkSession, backend: str, after: int = 0, batch: int = 500, partitions: int = 8, id_name: str = "id") -> DataFrame:
    spark.dataSource.register(KeysetSource)
    options = {"backend": backend, "after": after, "batch": batch, "partitions": partitions, "id": id_name}
    return spark.read.format("keyset").options(**options).load()


def csv_text(rows: list[list[str]]) -> str:
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue()
