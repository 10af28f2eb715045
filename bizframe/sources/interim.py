"""Tables written between the rounds of an operator: they cut lineage, and lost executors do not lose them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LOCAL: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines share; where it is unset, in local mode only, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="bizframe-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = _LOCAL[0]
    return base.rstrip("/")


#: Rows that a task sorts or aggregates together.
ROWS_A_TASK = 200_000


def spread(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """df dealt by the columns to as many tasks as about so many rows need. Spark joins partitions of an exchange of its own up
    to a size in compressed bytes, which may be millions of narrow rows; a number that is given stands."""
    return df.repartition(1 + rows // ROWS_A_TASK, *cols)


def write(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The table, written and read back, and how many of its rows meet each condition (`n`: all), seen while writing."""
    spark = df.sparkSession
    path = f"{folder(spark)}/bizframe-tmp/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    counted.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    found = seen.get if "n" in (seen.get or {}) else dict.fromkeys(["n", *counts], 0)
    if not found["n"] and not out.isEmpty():  # nothing is observed where a plan is cut short
        found = out.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()]).first().asDict()
    return out, found


def stream(df: DataFrame, name: str) -> DataFrame:
    """What a stream gives out for all that has arrived, as a table."""
    spark = df.sparkSession
    path = f"{folder(spark)}/bizframe-tmp/{name}-{uuid.uuid4().hex}"
    sink = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that no plan reads again."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session.sessionState().newHadoopConf()).delete(where, True)
