"""Versions of documents: a table of intervals in which each version of a key is valid.

A history has the keys, version (from 1), valid_from, valid_to (null: now), run (who wrote it) and the content. Finalising
appends version n + 1 of every key whose content is new or changed and closes version n; reading as of a time takes each
key's version that was valid then; a rerun takes back what a run wrote for some keys, opens what it had closed, and
finalises anew. All of it are joins and windows by key over the history and the changes.

Defined cases: content that equals the current version adds none; null content is content like other; of several rows of a
key in one change the largest content counts; a key with a null part is a key; an interval holds its start, not its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

META = ["version", "valid_from", "valid_to", "run"]


def _same(keys: list[str], a: DataFrame, b: DataFrame) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def empty(content: DataFrame, keys: list[str]) -> DataFrame:
    """A history without rows for such content."""
    rest = [c for c in content.columns if c not in keys]
    return content.select(*keys, F.lit(0).alias("version"), F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit("").alias("run"), *rest).where("false")


def finalise(history: DataFrame, changes: DataFrame, keys: list[str], at: Column, run: str) -> DataFrame:
    """The history with the changes (keys and content) valid from `at`."""
    content = [c for c in history.columns if c not in (*keys, *META)]
    rows = changes.groupBy(*keys).agg(F.max(F.struct(*content)).alias("__new"))
    newest = Window.partitionBy(*keys)
    current = history.withColumn("__last", F.max("version").over(newest)).where("version = __last").select(*keys, F.col("version").alias("__v"), F.col("valid_to").alias("__closed"), F.struct(*content).alias("__old"))
    joined = rows.join(current, _same(keys, rows, current), "left").select(*[rows[k] for k in keys], "__new", "__v", "__closed", "__old")
    changed = joined.where(F.col("__v").isNull() | F.col("__closed").isNotNull() | ~F.col("__new").eqNullSafe(F.col("__old")))
    added = changed.select(*keys, (F.coalesce("__v", F.lit(0)) + 1).cast("int").alias("version"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(run).alias("run"), "__new.*")
    closing = changed.where("__v is not null").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__v").alias("__closing"))
    on = history["version"] == closing["__closing"]
    for k in keys:
        on = on & history[k].eqNullSafe(closing[f"__{k}"])
    kept = history.join(closing, on, "left").withColumn("valid_to", F.when(F.col("__closing").isNotNull() & F.col("valid_to").isNull(), at).otherwise(F.col("valid_to")))
    return kept.select(*history.columns).unionByName(added.select(*history.columns))


def as_of(history: DataFrame, at: Column) -> DataFrame:
    return history.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def rerun(history: DataFrame, ids: DataFrame, changes: DataFrame, keys: list[str], at: Column, run: str) -> DataFrame:
    """What `run` wrote last for the ids is replaced by the changes, as far as they are of these ids; other rows stay."""
    mine = ids.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & history[k].eqNullSafe(mine[f"__{k}"])
    marked = history.join(mine.withColumn("__mine", F.lit(True)), on, "left").drop(*[f"__{k}" for k in keys])
    last = Window.partitionBy(*keys)
    marked = marked.withColumn("__gone", F.coalesce(F.col("__mine"), F.lit(False)) & (F.col("run") == run) & (F.col("version") == F.max("version").over(last)))
    marked = marked.withColumn("__open", F.max("__gone").over(last) & (F.col("version") == F.max("version").over(last) - 1))
    back = marked.where(~F.col("__gone")).withColumn("valid_to", F.when(~F.col("__open"), F.col("valid_to"))).select(*history.columns)
    return finalise(back, changes.join(ids.select(*keys).distinct(), keys, "left_semi"), keys, at, run)
