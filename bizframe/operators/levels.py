"""Ordered work: levels of a dependency graph, each of which is one job over all its rows.

A row's level is one more than the largest of those it depends on. Rows are settled in written rounds: those whose needs are
all settled form the next level; a round touches the edges of what is left. What never gets a level waits, directly or not,
for itself or for a row that is not there, and is reported. Within a level rows are ordered by priority, then id.

Defined cases: a row that depends on itself is a cycle; a need that is no row is reported as missing; needs named twice
count once; rows of one id are one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import interim


def levels(rows: DataFrame, needs: DataFrame, id_col: str = "id") -> DataFrame:
    """id, level (from 1; null: never ready), problem ('cycle', 'missing' or null). needs: id, needs."""
    ids, _ = interim.write(rows.select(F.col(id_col).alias("id")).where("id is not null").distinct(), "ids")
    edges, _ = interim.write(needs.select(F.col(id_col).alias("id"), "needs").where("needs is not null").distinct().join(ids, "id", "left_semi"), "edges")
    missing = edges.join(ids.select(F.col("id").alias("needs")), "needs", "left_anti").select("id").distinct()
    left, level, settled = ids, 0, []
    while True:
        level += 1
        ready, found = interim.write(left.join(edges.select("id"), "id", "left_anti"), "ready")
        if not found["n"]:
            break
        settled.append(ready.select("id", F.lit(level).alias("level")))
        left, _ = interim.write(left.join(ready, "id", "left_anti"), "left")
        edges, _ = interim.write(edges.join(ready.select(F.col("id").alias("needs")), "needs", "left_anti"), "edges")
    lost, found = interim.write(missing, "missing")
    if found["n"]:  # whoever waits for what is missing is missing too
        frontier = lost
        while found["n"]:
            frontier, found = interim.write(edges.join(frontier.select(F.col("id").alias("needs")), "needs", "left_semi").select("id").distinct().join(lost, "id", "left_anti"), "waiting")
            lost = lost.unionByName(frontier)
    never = left.join(lost.withColumn("__m", F.lit("missing")), "id", "left").select("id", F.lit(None).cast("int").alias("level"), F.coalesce("__m", F.lit("cycle")).alias("problem"))
    out = never
    for s in settled:
        out = out.unionByName(s.withColumn("problem", F.lit(None).cast("string")))
    return out


def run_levels(rows: DataFrame, leveled: DataFrame, run: Callable[[DataFrame, int], None], id_col: str = "id", priority: str = "priority") -> int:
    """Calls run with each level's rows, by priority and id; returns how many levels there were."""
    last = leveled.agg(F.max("level")).first()[0] or 0
    for level in range(1, last + 1):
        own = leveled.where(F.col("level") == level).select(F.col("id").alias(id_col))
        run(rows.join(own, id_col, "left_semi").orderBy(F.col(priority).asc_nulls_last(), id_col), level)
    return last
