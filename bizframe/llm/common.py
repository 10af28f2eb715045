"""Helpers the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word, for sizes and language models: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of texts that a task turns from and to Arrow together.
PIECE = 1 << 20


#: Bytes of an Arrow batch where the session sets no bound: Spark's own default lets 10,000 rows of long texts meet.
BATCH = 4 << 20


def give_back() -> None:
    """Returns what a Python worker has freed to the system: an idle worker keeps nothing from the task before."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow() with batches bounded in bytes, whatever the rows are; a bound of the session's own stands."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH))
    return df.mapInArrow(tidied, schema)


def pieces(batches: Iterator[pa.RecordBatch], col: str | int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows that hold about size bytes in col, so that memory follows that and not a batch."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = [*np.flatnonzero(np.diff(ends // size, prepend=-1)).tolist(), b.num_rows]
        for first, end in zip(edges, edges[1:]):
            yield b.slice(first, end - first)


def new_names(columns: list[str], *names: str) -> None:
    """An error if a column to be added has the name of one that is there."""
    if taken := {c.lower() for c in columns} & {n.lower() for n in names}:
        raise ValueError(f"columns {sorted(taken)} are there already: rename or drop them")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="bizframe-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Where each table of materialize() stands, for discard().
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Narrow rows that one task writes, where their number is known to be no more than a bound.
ROWS_A_TASK = 50_000


def materialize(df: DataFrame, name: str, at_most: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and lost executors do not lose it.

    at_most: a bound of the rows, for tables of narrow rows: they are written by as many tasks as such rows need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bizframe-tmp/{name}-{uuid.uuid4().hex}"
    (df if at_most is None else df.coalesce(2 + at_most // ROWS_A_TASK)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that no plan will read again."""
    for df in tables:
        path = _WRITTEN.pop(df, None)
        if path:
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(session.sessionState().newHadoopConf()).delete(where, True)


def materialize_counted(df: DataFrame, name: str, count: Column | None = None, at_most: int | None = None) -> tuple[DataFrame, int]:
    """materialize(), and the number of rows (where count holds), observed while writing: no job of its own."""
    seen = Observation()
    rows = F.count(F.lit(1)) if count is None else F.count_if(count)
    out = materialize(df.observe(seen, rows.alias("n")), name, at_most)
    n = seen.get.get("n")
    if n is None:  # nothing is observed where the plan is found to be empty
        n = (out if count is None else out.where(count)).count()
    return out, n


#: A side of a join is broadcast up to so many narrow rows, and shuffled beyond.
BROADCAST_ROWS = 400_000


def small_or_shuffled(df: DataFrame, n: int, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, of n narrow rows as counted, with a broadcast hint where they are few."""
    return F.broadcast(df) if n <= rows else df
