"""Sets of members as classes: which ids have the same set, without pairs of equal ones.

A set's mark is the number of its distinct members and two xors of their 64-bit hashes, which do not depend on an order and
combine before a shuffle, so a set of any size is a few numbers. Ids of one mark form a class, in which every member must be
held by all; should different sets share a mark, the class's ids are told apart by the sets themselves. Rows are dealt by id
to tasks whose number follows the rows'.

Defined cases: a null member is a value like others; an id without rows is in no class; repeated members count once; rows
of a null id form a set like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import interim


def fingerprint(members: list[str], seed: int) -> Column:
    return F.xxhash64(*members, F.lit(seed))


def set_classes(df: DataFrame, id_col: str, members: list[str], mark=fingerprint, rows: int | None = None) -> DataFrame:
    """id, class_id (the smallest id with the same set), class_size, set_size. rows: about how many df has, where that is known."""
    own = df.select(F.col(id_col).alias("__id"), F.struct(*members).alias("__m"))
    held, _ = interim.write(interim.spread(own, df.count() if rows is None else rows, "__id").distinct(), "members")
    parts = [f"__m.{m}" for m in members]
    sets = held.groupBy("__id").agg(F.bit_xor(mark(parts, 1)).alias("__x"), F.bit_xor(mark(parts, 2)).alias("__y"), F.count(F.lit(1)).alias("set_size"))
    sets, _ = interim.write(sets, "sets")
    same = ["__x", "__y", "set_size"]
    classes = sets.groupBy(*same).agg(F.min("__id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    marked, _ = interim.write(sets.join(classes, same).select("__id", "set_size", "class_id", "class_size"), "classes")
    # sets of one size are equal if each member of one is in all of them
    several = marked.where("class_size > 1").select(F.col("__id").alias("__i"), "class_id", "class_size")
    shared = held.join(several, F.col("__id").eqNullSafe(F.col("__i"))).groupBy("class_id", "class_size", "__m").agg(F.count(F.lit(1)).alias("__n"))
    wrong, counts = interim.write(shared.where("__n <> class_size").select("class_id").distinct(), "wrong")
    out = marked
    if counts["n"]:  # different sets under one mark
        mixed = marked.where("class_size > 1").join(wrong.select(F.col("class_id").alias("__c")), F.col("class_id").eqNullSafe(F.col("__c")), "left")
        asked = mixed.where("__c is not null or class_id is null").select(F.col("__id").alias("__i"), "set_size")
        exact = held.join(asked, F.col("__id").eqNullSafe(F.col("__i"))).groupBy("__id", "set_size").agg(F.array_sort(F.collect_set(F.to_json("__m"))).alias("__set"))
        apart = exact.groupBy("__set").agg(F.min("__id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
        kept = mixed.where("__c is null and class_id is not null").drop("__c").unionByName(marked.where("class_size = 1"))
        out = kept.unionByName(exact.join(apart, "__set").select("__id", "set_size", "class_id", "class_size"))
    return out.select(F.col("__id").alias(id_col), "class_id", "class_size", "set_size")


def same_set(a: DataFrame, b: DataFrame, a_id: str, b_id: str, members: list[str], rows: int | None = None) -> DataFrame:
    """a_id, the smallest b_id with the same set of members, and how many there are: one row for each id of a."""
    side = lambda df, key, mark: df.select(F.struct(F.lit(mark).alias("side"), F.col(key).alias("key")).alias("__owner"), *members)
    kind = a.schema[a_id].dataType
    classes = set_classes(side(a, a_id, 0).unionByName(side(b.withColumn(b_id, F.col(b_id).cast(kind)), b_id, 1)), "__owner", members, rows=rows)
    of_b = classes.where("__owner.side = 1").groupBy("class_id").agg(F.min("__owner.key").alias(b_id), F.count(F.lit(1)).alias("matches"))
    return classes.where("__owner.side = 0").join(of_b, "class_id", "left").select(F.col("__owner.key").alias(a_id), b_id, F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"))
