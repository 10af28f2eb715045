"""Hierarchies of any size and depth: a table of ids and parents, walked in written rounds.

Rows that no other names as its parent are joined to their parents in the end; only the others, the inner ones, are walked.
A few rounds go level by level from the asked rows. What is left after them is walked by pointer doubling: every row that has rows below keeps a pointer to its ancestor 2^k
steps up, and a round joins the pointers with themselves, so that a chain of 200,000 rows takes 18 rounds; rows with none
below are joined to their parents in the end. A round reads and writes narrow rows by equi-joins whose right side is
unique, which Spark splits where many rows share a parent.

Defined cases: an id's parent is the smallest of its rows'; a null id is no row; a parent that is no row ends the chain as
a null one does; rows of a cycle have no root, and are below a mark only if the way up meets one before it comes round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import interim

#: Rounds by level before pointers are doubled.
LEVELS = 6


def _edges(df: DataFrame, id_col: str, parent_col: str) -> tuple[DataFrame, int]:
    """id, parent: one row an id."""
    rows = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")).where("id is not null")
    found, counts = interim.write(rows.groupBy("id").agg(F.min("parent").alias("parent")), "edges")
    return found, counts["n"]


def _parted(df: DataFrame, id_col: str, parent_col: str, marks: DataFrame | None) -> tuple[DataFrame, DataFrame, int]:
    """(id, parent, inner, marked) of every row, and (id, parent, marked) of the inner ones, which other rows name as parents: all
    that is walked. Also their number. marks: None: rows without a parent that is a row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")).where("id is not null")
    own = rows.groupBy("id").agg(F.min("parent").alias("parent"), F.lit(True).alias("own"))
    named = rows.where("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
    both = own.join(named, "id", "full_outer")
    if marks is not None:
        both = both.join(marks.select(F.col(marks.columns[0]).alias("id")).distinct().withColumn("marked", F.lit(True)), "id", "left")
    else:
        both = both.withColumn("marked", F.col("parent").isNull())
    both = both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("own", "inner", "marked")})
    written, counts = interim.write(both, "edges", lost=~F.col("own"))
    edges = written.where("own").drop("own")
    if counts["lost"]:  # parents that are no rows
        lost = written.where("not own").select(F.col("id").alias("parent"), F.lit(True).alias("lost"))
        edges = edges.join(lost, "parent", "left").select("id", F.when(F.col("lost").isNull(), F.col("parent")).alias("parent"), "inner", (F.col("marked") | F.col("lost").isNotNull() if marks is None else F.col("marked")).alias("marked"))
        edges, _ = interim.write(edges, "edges")
    inner, counts = interim.write(edges.where("inner").drop("inner"), "inner")
    return edges, inner, counts["n"]


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def nearest(df: DataFrame, id_col: str, parent_col: str, marks: DataFrame | None = None) -> DataFrame:
    """id, near, distance: of every row at or below a mark the nearest one and the steps up to it.

    marks: one column of ids; None: the rows without a parent, so that near is the root and distance the depth."""
    edges, inner, n = _parted(df, id_col, parent_col, marks)
    mark = lambda rows: rows.where("marked").select("id", F.col("id").alias("near"), F.lit(0).cast("bigint").alias("distance"))
    walked = inner.where("not marked and parent is not null").select("id", "parent")
    frontier, level, found = mark(inner), 0, {"n": n}
    solved = [frontier]
    while found["n"] and level < LEVELS:
        level += 1
        step = walked.join(frontier.select(F.col("id").alias("parent"), "near"), "parent").select("id", "near", F.lit(level).cast("bigint").alias("distance"))
        frontier, found = interim.write(step, "level")
        solved.append(frontier)
    targets = [_union(solved)]
    if found["n"]:
        pointers = walked.join(targets[0].select("id"), "id", "left_anti").select("id", F.col("parent").alias("jump"), F.lit(1).cast("bigint").alias("steps"))
        pointers, counts = interim.write(pointers, "pointers")
        length, none = 1, F.lit(None).cast(edges.schema["id"].dataType)
        while counts["n"] and length <= n:
            length *= 2
            there = _union([
                *[s.select(F.col("id").alias("jump"), "near", F.col("distance").alias("far"), none.alias("next")) for s in targets],
                pointers.select(F.col("id").alias("jump"), none.alias("near"), F.col("steps").alias("far"), F.col("jump").alias("next")),
            ])
            moved = pointers.join(there, "jump").select("id", "near", F.col("next").alias("jump"), (F.col("steps") + F.col("far")).alias("steps"))
            moved, counts = interim.write(moved, "pointers", open=F.col("near").isNull())
            targets.append(moved.where("near is not null").select("id", "near", F.col("steps").alias("distance")))
            pointers, counts = moved.where("near is null").select("id", "jump", "steps"), {"n": counts["open"]}
    reached = _union(targets)
    outer = edges.where("not inner")
    below = outer.where("not marked and parent is not null").select("id", "parent").join(reached.select(F.col("id").alias("parent"), "near", "distance"), "parent")
    return _union([reached, mark(outer), below.select("id", "near", (F.col("distance") + 1).alias("distance"))])


def _doubled(edges: DataFrame, n: int):
    """(id, up) for the ancestors 1, 2, 4, ... steps up of rows that have rows below, as written tables, until none has one; a
    cycle ends at n."""
    inner = edges.join(edges.select(F.col("parent").alias("id")), "id", "left_semi").where("parent is not null")
    ups, found = interim.write(inner.join(edges.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", F.col("parent").alias("up")), "up")
    length = 1
    while found["n"]:
        yield ups
        if length > n:
            return
        length *= 2
        ups, found = interim.write(ups.join(ups.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "up")


def ancestors(df: DataFrame, id_col: str, parent_col: str, starts: DataFrame) -> DataFrame:
    """id: all rows at or above the starts (one column of ids)."""
    edges, inner, n = _parted(df, id_col, parent_col, starts)
    known = edges.where("marked and not inner").select("id")
    frontier, found = inner.where("marked").select("id", "parent"), {"n": n}
    above = edges.where("marked and parent is not null").select(F.col("parent").alias("id")).distinct()
    seen, level = frontier.select("id"), 0
    while found["n"] and level < max(2, LEVELS):
        level += 1
        step = inner.select("id", "parent").join(above, "id", "left_semi").join(seen, "id", "left_anti")
        frontier, found = interim.write(step, "level")
        seen = seen.unionByName(frontier.select("id"))
        above = frontier.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    if found["n"]:
        for ups in _doubled(inner.select("id", "parent"), n):
            # what is seen holds all ancestors up to 2^k steps away, so these pointers double its reach
            higher = ups.join(seen, "id", "left_semi").select(F.col("up").alias("id")).distinct()
            new, found = interim.write(higher.join(seen, "id", "left_anti"), "above")
            seen = seen.unionByName(new)
    return known.unionByName(seen)


def closure(df: DataFrame, id_col: str, parent_col: str, starts: DataFrame | None = None, down: bool = False) -> DataFrame:
    """ancestor, id: every row (or the starts) with all rows at or above it; down: with all rows at or below."""
    if down and starts is not None:
        # rows by their nearest start, and the starts' own hierarchy
        near = nearest(df, id_col, parent_col, starts)
        parents = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("p")).where("p is not null").groupBy("id").agg(F.min("p").alias("p"))
        own = near.where("distance = 0").select("id").join(parents, "id", "left")
        small = own.join(near.select(F.col("id").alias("p"), F.col("near").alias("parent")), "p", "left").select("id", "parent")
        between = closure(small, "id", "parent")
        return near.select("id", "near").join(between.withColumnRenamed("id", "near"), "near").select("ancestor", "id")
    edges, n = _edges(df, id_col, parent_col)
    asked = edges if starts is None else edges.join(starts.select(F.col(starts.columns[0]).alias("id")), "id", "left_semi")
    above = edges.select(F.col("parent").alias("id")).where("id is not null").distinct()
    inner, outer = asked.join(above, "id", "left_semi"), asked.join(above, "id", "left_anti")
    # rows with none below have their parents' pairs
    first = inner.select("id").union(outer.select("parent")).distinct().join(edges, "id", "left_semi").select("id")
    pairs, _ = interim.write(first.select("id", F.col("id").alias("ancestor")), "pairs")
    length, cyclic = 1, False
    for ups in _doubled(edges, n):
        if length > n:  # only cycles come so far: their pairs are there already
            cyclic = True
            break
        higher = pairs.join(ups.select(F.col("id").alias("ancestor"), "up"), "ancestor").select("id", F.col("up").alias("ancestor"))
        pairs, _ = interim.write(pairs.unionByName(higher), "pairs")
        length *= 2
    own = pairs if starts is None else pairs.join(inner.select("id"), "id", "left_semi")
    by_parent = outer.select(F.col("id").alias("own"), F.col("parent").alias("id")).join(pairs, "id").select(F.col("own").alias("id"), "ancestor")
    found = _union([own, by_parent, outer.select("id", F.col("id").alias("ancestor"))]).select("ancestor", "id")
    return found.distinct() if cyclic else found  # the ways round a cycle give pairs again
