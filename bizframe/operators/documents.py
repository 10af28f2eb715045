"""Smaller operators on documents, transfers and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import idempotency_key
from ..functions.money import convert_quantity
from .numbering import number_rows


def columns_first_seen(rows: DataFrame, values: str, order: str) -> DataFrame:
    """The keys of all rows' maps, in the order in which they first occur: position, column."""
    keys = rows.select(F.col(order).alias("__o"), F.posexplode(F.map_keys(values)).alias("__p", "column"))
    first = keys.groupBy("column").agg(F.min(F.struct("__o", "__p")).alias("__at"))
    return number_rows(first, ["__at"], "position").select(F.col("position").cast("int").alias("position"), "column")


def merge_bundles(bundles: DataFrame, key: str, ids: str) -> DataFrame:
    """The union of several bundles' record ids, per model, sorted."""
    return bundles.select(key, F.explode(ids).alias("__id")).groupBy(key).agg(F.array_sort(F.collect_set("__id")).alias(ids))


def bucket_by_prefix(df: DataFrame, name: str, buckets: dict[str, list[str]], most: int = 20) -> DataFrame:
    """bucket, count and the first `most` names of every bucket; a name goes to the first bucket with a prefix of it."""
    of = F.coalesce(*[F.when(F.col(name).rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"), F.lit(b)) for b, prefixes in buckets.items()], F.lit("other"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(name))
    ranked = df.select(of.alias("bucket"), name).withColumn("__r", rank)
    return ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("__r") <= most, F.col(name)))).alias("names"))


def document_sets(documents: DataFrame, key: str, side: str, kind: str, doc: str) -> DataFrame:
    """Per transaction the documents of each side and kind, as sorted lists in one row."""
    cells = [(s, k) for s in ("source", "destination") for k in ("invoice", "refund", "payment")]
    of = lambda s, k: F.array_sort(F.collect_list(F.when((F.col(side) == s) & (F.col(kind) == k), F.col(doc))))
    return documents.groupBy(key).agg(*[of(s, k).alias(f"{s}_{k}") for s, k in cells])


def done_or_planned(moves: DataFrame, lines: DataFrame, key: str, planned: str, done: str) -> DataFrame:
    """The lines of a move with something done; a move without any gets one line of its planned quantity."""
    real = lines.where(F.col(done) != 0)
    rest = moves.join(real.select(key), key, "left_anti").select(key, F.col(planned).alias(done)).withColumn("synthetic", F.lit(True))
    return real.select(key, done).withColumn("synthetic", F.lit(False)).unionByName(rest)


def transfer_sides(lines: DataFrame, quantity: str, from_ratio: str, to_ratio: str) -> DataFrame:
    """A manual transfer as two pickings: the outgoing lines as they are, the incoming ones in the destination's unit."""
    out = lines.withColumn("direction", F.lit("outgoing"))
    into = lines.withColumn(quantity, convert_quantity(F.col(quantity), F.col(from_ratio), F.col(to_ratio))).withColumn("direction", F.lit("incoming"))
    return out.unionByName(into)


def follow_ups(records: DataFrame, existing: DataFrame, kind: str, reference: str, text: Column, needs_approval: Column, marker: str = "") -> DataFrame:
    """Work to create for records that have none yet, by idempotency key, with whether it waits for approval."""
    keyed = records.withColumn("note", text).withColumn("key", idempotency_key(F.lit(kind), reference, "note", F.lit(marker)))
    new = keyed.join(existing.select("key"), "key", "left_anti").dropDuplicates(["key"])
    return new.withColumn("action", F.when(needs_approval, "approval").otherwise("create"))


def first_document(df: DataFrame, on: DataFrame, ours: str, names: list[str], latest: str) -> DataFrame:
    """Each reference's newest document whose name or origin equals it."""
    sides = [on.select(F.col(n).alias("__k"), F.struct(latest, *[c for c in on.columns if c != latest]).alias("__d")) for n in names]
    both = sides[0]
    for s in sides[1:]:
        both = both.unionByName(s)
    best = both.where("__k is not null").groupBy("__k").agg(F.max("__d").alias("document"))
    return df.join(best, F.col(ours) == F.col("__k"), "left").drop("__k")


def parent_of(lines: DataFrame, parents: DataFrame, direct: str, line: str, key: str) -> DataFrame:
    """A parent by its own link, else by way of the lines' parents, the smallest."""
    via = parents.groupBy(F.col(line).alias("__l")).agg(F.min(key).alias("__via"))
    return lines.join(via, F.col(line) == F.col("__l"), "left").withColumn("parent", F.coalesce(direct, "__via")).drop("__l", "__via")


def planned_min(lines: DataFrame, key: str, day: str, kind: str) -> DataFrame:
    """The earliest date over lines that are no sections or notes."""
    return lines.groupBy(key).agg(F.min(F.when(~F.coalesce(F.col(kind).isin("line_section", "line_note"), F.lit(False)), F.col(day))).alias("planned"))


def kpi_catalog(spark, kpis: list, category: str | None = None) -> DataFrame:
    rows = [(k.code, k.category, k.model, k.op, k.field) for k in kpis if category is None or k.category == category]
    return spark.createDataFrame(rows, "code string, category string, model string, op string, field string")


def attachments(files: DataFrame, model: str, record: int, limit: int = 50) -> DataFrame:
    return files.where((F.col("res_model") == model) & (F.col("res_id") == record)).orderBy(F.desc("create_date"), F.desc("id")).limit(limit)
