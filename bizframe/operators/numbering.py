"""Consecutive numbers for all rows of a table, in two passes and without a task that sees all of them.

The rows are dealt to ranges of their keys and written; a range's number of rows gives the others' offsets, of which the
driver sees one per range; then every range numbers its own rows. Keys that are distinct give the same numbers in every run.

Defined cases: null keys come first; rows with equal keys are numbered one after the other, in any order; an empty table
gives an empty table.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import interim


def number_rows(df: DataFrame, order: list[str], out: str = "n", start: int = 0) -> DataFrame:
    """df with the rows' numbers from start on, by the order of the columns."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("__range", F.spark_partition_id())
    rows, _ = interim.write(ranged, "numbered")
    counts = sorted((r["__range"], r["count"]) for r in rows.groupBy("__range").count().collect())  # one row a range
    offsets = accumulate([start, *[n for _, n in counts]])
    table = spark.createDataFrame([(k, o) for (k, _), o in zip(counts, offsets)], "__range int, __offset bigint")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1
    return rows.join(F.broadcast(table), "__range").withColumn(out, F.col("__offset") + own).drop("__range", "__offset")


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """existing with a row for each wanted key that it lacks, new ids after the largest, in the order of the keys."""
    new = wanted.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    kind = existing.schema[id_col].dataType
    numbered = number_rows(new, keys, id_col, int(top) + 1)
    return existing.select(id_col, *keys).unionByName(numbered.select(F.col(id_col).cast(kind), *keys))
