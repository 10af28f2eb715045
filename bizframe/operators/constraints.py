"""Appends under partial unique constraints: rows that would break one go to quarantine with its name.

A constraint is a key and a condition on rows; rows that meet the condition may not share the key. A row is refused if a
row that is there already holds its key, or a row of the batch that comes before it and is itself accepted. Rows may
depend on each other through several constraints, so the batch is settled in rounds over its claims (row, constraint,
key): who comes first in all of its claims is accepted, who shares a claim with an accepted row is refused, and the rest
goes on. A key that many rows claim costs one round, since its first row is settled at once or waits for another key.
Where no row of a batch makes two claims, as counted, nothing depends on anything and one pass settles all.
Keys are compared whole. Those of the table are met by a semi join, for which Spark makes Bloom filters of its own.

Defined cases: a row with a null in a key makes no claim under that constraint, nor does one whose condition is null; rows
of equal order are taken in the order of their content, repeated rows claim each for itself; no constraint accepts all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import interim
from .numbering import number_rows


@dataclass(frozen=True)
class Unique:
    name: str
    keys: tuple[str, ...]
    where: str = "true"


def _holds(c: Unique) -> Column:
    """That a row makes a claim under the constraint."""
    holds = F.expr(f"coalesce({c.where}, false)")
    for k in c.keys:
        holds = holds & F.col(k).isNotNull()
    return holds


def _claims(df: DataFrame, constraints: list[Unique], *keep: str) -> DataFrame:
    """keep, constraint, key: what each row claims."""
    rows = []
    for c in constraints:
        key = F.to_json(F.array(*[F.col(k).cast("string") for k in c.keys]))
        rows.append(F.when(_holds(c), F.struct(F.lit(c.name).alias("constraint"), key.alias("key"))))
    return df.select(*keep, F.inline(F.array_compact(F.array(*rows))))


def _at_once(rows: DataFrame, n: int, existing: DataFrame, columns: list[str], constraints: list[Unique], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Where no row claims two keys: of all that claim a key, those that are there counting as the first, the first has it. Claims
    meet in one shuffle, and which constraint a refused row breaks is read off the row. rows: with __row, any distinct number."""
    place = F.struct(F.lit(True).alias("mine"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.xxhash64(*columns).alias("tie"), F.col("__row").alias("row"))
    claims = _claims(rows.withColumn("__place", place), constraints, "__place")
    there = F.struct(F.lit(False).alias("mine"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in claims.schema["__place"].dataType.fields[1:]])
    both = claims.unionByName(_claims(existing.withColumn("__place", there), constraints, "__place"))
    first = interim.spread(both, n + existing.count(), "constraint", "key").groupBy("constraint", "key").agg(F.min("__place").alias("__place"))
    won, _ = interim.write(first.where("__place.mine").select(F.col("__place.row").alias("__row")), "won")
    claimed = F.coalesce(*[F.when(_holds(c), F.lit(c.name)) for c in constraints])
    judged = rows.withColumn("constraint", claimed)
    refused = judged.where("constraint is not null").join(won, "__row", "left_anti").select(*columns, "constraint")
    free = judged.where("constraint is null").select(*columns)
    return free.unionByName(judged.where("constraint is not null").join(won, "__row", "left_semi").select(*columns)), refused


def append_unique(existing: DataFrame, batch: DataFrame, constraints: list[Unique], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) rows of the batch in its columns; refused ones also say which constraint, the first by name."""
    if not constraints:
        return batch, batch.withColumn("constraint", F.lit(None).cast("string")).where("false")
    several = F.lit(0)
    for c in constraints:
        several = several + _holds(c).cast("int")
    rows, counts = interim.write(batch.withColumn("__row", F.monotonically_increasing_id()), "batch", many=several > 1)
    if not counts["many"]:
        return _at_once(rows, counts["n"], existing, batch.columns, constraints, order)
    hashed = rows.drop("__row").withColumn("__tie", F.xxhash64(*batch.columns))
    rows, _ = interim.write(number_rows(hashed, [*order, "__tie"], "__row").drop("__tie"), "batch")
    claims, found = interim.write(_claims(rows, constraints, "__row"), "claims")
    there = _claims(existing, constraints).distinct()
    lost, _ = interim.write(claims.join(there, ["constraint", "key"], "left_semi").groupBy("__row").agg(F.min("constraint").alias("constraint")), "lost")
    refused = [lost]
    left, found = interim.write(claims.join(lost.select("__row"), "__row", "left_anti"), "claims")
    while found["n"]:
        heads = left.groupBy("constraint", "key").agg(F.min("__row").alias("__head"))
        judged = left.join(heads, ["constraint", "key"]).groupBy("__row").agg(F.bool_and(F.col("__row") == F.col("__head")).alias("__first"))
        won, _ = interim.write(judged.where("__first").select("__row"), "won")
        held = left.join(won, "__row", "left_semi").select("constraint", "key")
        rest = left.join(won, "__row", "left_anti")
        lost, _ = interim.write(rest.join(held, ["constraint", "key"], "left_semi").groupBy("__row").agg(F.min("constraint").alias("constraint")), "lost")
        refused.append(lost)
        left, found = interim.write(rest.join(lost.select("__row"), "__row", "left_anti"), "claims")
    out = refused[0]
    for r in refused[1:]:
        out = out.unionByName(r)
    return rows.join(out.select("__row"), "__row", "left_anti").select(*batch.columns), rows.join(out, "__row").select(*batch.columns, "constraint")
