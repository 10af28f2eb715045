"""The catalogue of tables as a table that can be filtered and joined: of_frames() for whatever Spark reads, and
format("catalogue") for a folder of Parquet tables.

of_frames() counts rows and nulls by reading the columns. The format has a row for each table, column and run of files, from
footers alone. Its options tables (a JSON list of names) and prefix prune the scan: other tables' footers are not opened. These
are options and no pushed filters, because Spark 4.1 keeps one reader for a DataFrame of a Python source: of two filters on one
DataFrame, in one plan or one after the other, both read what one of them asked for (tried: a union of 6 and 3 rows came out as
6 or 12). Files are dealt in runs to tasks, so that a table of a million files is read by many; columns() adds the runs up. A
column that has two types in a table's files has two rows. Option path: a folder with `<table>.parquet` files or folders, local
or of a store whose address pyarrow knows (file, hdfs, s3, gs).

Defined cases of the format: files and folders whose names begin with '_' or '.' are no tables and no parts of one; a table
without files has no row; nulls are unknown (null) for nested columns and where a file keeps no statistics; an empty file adds
no rows but its columns. An empty frame has zeros.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

SCHEMA = "table_name string, column_name string, position int, data_type string, n_files long, n_rows long, n_nulls long"
SUFFIX = ".parquet"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; '/a', 'file:/a' and 'file:///a' are the same."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.run = options["path"], int(options.get("files_a_task", 64))
        self.tables, self.prefix = json.loads(options.get("tables", "null")), options.get("prefix", "")

    def wanted(self, name: str) -> bool:
        return name.startswith(self.prefix) and (self.tables is None or name in self.tables)

    def partitions(self) -> list[InputPartition]:
        store, top = opened(self.path)
        found = []
        for entry in store.get_file_info(fs.FileSelector(top)):
            name = entry.base_name.removesuffix(SUFFIX)
            if entry.base_name[0] in "_." or name == entry.base_name or not self.wanted(name):
                continue
            if entry.type == fs.FileType.File:
                files = [entry.path]
            else:
                inside = store.get_file_info(fs.FileSelector(entry.path, recursive=True))
                files = sorted(x.path for x in inside if x.type == fs.FileType.File and not any(p[0] in "_." for p in x.path[len(entry.path) + 1 :].split("/")))
            found += [(name, files[at : at + self.run]) for at in range(0, len(files), self.run)]
        return [InputPartition(x) for x in sorted(found)] or [InputPartition(("", []))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, files = partition.value
        store, _ = opened(self.path)
        seen: dict[tuple, list] = {}
        for file in files:
            with store.open_input_file(file) as f:
                meta = pq.ParquetFile(f).metadata
            schema = meta.schema.to_arrow_schema()
            nulls = null_counts(meta, schema)
            for at, field in enumerate(schema):
                kind = from_arrow_type(field.type, prefer_timestamp_ntz=True).simpleString()
                sums = seen.setdefault((field.name, at + 1, kind), [0, 0, 0])
                sums[0] += 1
                sums[1] += meta.num_rows
                sums[2] = None if sums[2] is None or nulls[field.name] is None else sums[2] + nulls[field.name]
        for key, sums in seen.items():
            yield (name, *key, *sums)


def null_counts(meta: pq.FileMetaData, schema: pa.Schema) -> dict[str, int | None]:
    """Nulls of a file's columns as its row groups' statistics have them."""
    out: dict[str, int | None] = {f.name: None if pa.types.is_nested(f.type) else 0 for f in schema}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns if group.num_rows else 0):
            column = group.column(c)
            name, stats = column.path_in_schema, column.statistics
            if out.get(name) is not None:
                out[name] = out[name] + stats.null_count if stats is not None and stats.has_null_count else None
    return out


class CatalogueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return CatalogueReader(self.options)


def scan(spark: SparkSession, path: str, tables: Sequence[str] | None = None, prefix: str = "", files_a_task: int = 64) -> DataFrame:
    """The catalogue's rows, of the tables of these names or of names that begin so."""
    spark.dataSource.register(CatalogueSource)
    options = {"path": path, "prefix": prefix, "files_a_task": files_a_task, "tables": json.dumps(None if tables is None else sorted(tables))}
    return spark.read.format("catalogue").options(**options).load()


def of_frames(frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, position, data_type, n_rows, n_nulls of every column of the frames, of which there is at least one."""
    parts = []
    for name, df in frames.items():
        rows = F.count(F.lit(1))
        about = lambda at, f: [F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(at).alias("position"), F.lit(f.dataType.simpleString()).alias("data_type")]  # noqa: E731, B023
        each = [F.struct(*about(at, f), rows.alias("n_rows"), (rows - F.count(df[f"`{f.name}`"])).alias("n_nulls")) for at, f in enumerate(df.schema, 1)]
        parts.append(df.agg(F.array(*each).alias("each")).select(F.inline("each")))
    return reduce(DataFrame.unionByName, parts)


def columns(rows: DataFrame) -> DataFrame:
    """One row for each table, column and type, over all files."""
    known = F.when(F.count_if(F.col("n_nulls").isNull()) == 0, F.sum("n_nulls"))
    sums = [F.sum("n_files").alias("n_files"), F.sum("n_rows").alias("n_rows"), known.alias("n_nulls")]
    return rows.groupBy("table_name", "column_name", "position", "data_type").agg(*sums)


def missing(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (table_name, column_name and more) with table_found and column_found."""
    have = rows.groupBy("table_name").agg(F.collect_set("column_name").alias("__columns"))
    j = wanted.join(have, "table_name", "left")
    found = F.coalesce(F.array_contains("__columns", F.col("column_name")), F.lit(False))
    return j.select(*wanted.columns, F.col("__columns").isNotNull().alias("table_found"), found.alias("column_found"))
