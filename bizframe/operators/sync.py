"""Incremental record replication: keyset batches, identity maps, relation policies, translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import identity_lookup, missing_keys


def after(df: DataFrame, id_col: str, watermark: int | None, batch: int | None = None) -> DataFrame:
    """Rows past the watermark by id; the predicate reaches the scan. A batch is the next so many."""
    rows = df if watermark is None else df.where(F.col(id_col) > watermark)
    return rows if batch is None else rows.orderBy(id_col).limit(batch)


def checkpoint(df: DataFrame, id_col: str, job: str) -> DataFrame:
    """The job's new watermark: the last id read, whether its row was written or skipped."""
    return df.agg(F.lit(job).alias("job"), F.max(id_col).alias("last_source_id"), F.count(F.lit(1)).alias("n_read"))


def split_required(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Complete rows; and the others with the names of what they lack."""
    lost = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in required]))
    marked = df.withColumn("missing", lost)
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)


def plan_upsert(source: DataFrame, identity: DataFrame, model: str, key: str) -> DataFrame:
    """source with target_id and action (update where the map knows the record, else create)."""
    return identity_lookup(source, identity, model, key).withColumn("action", F.when(F.col("target_id").isNull(), "create").otherwise("update"))


def extend_map(identity: DataFrame, created: DataFrame, model: str, key: str, target_model: str, target: str) -> DataFrame:
    """The identity map with a row for each created record that it lacks."""
    new = created.select(F.lit(model).alias("source_model"), F.col(key).cast("string").alias("source_record_id"), F.lit(target_model).alias("target_model"), F.col(target).alias("target_record_id"), F.lit(True).alias("active"))
    return identity.unionByName(new.join(identity.where("active"), ["source_model", "source_record_id", "target_model"], "left_anti"))


def resolve_parent(source: DataFrame, identity: DataFrame, model: str, parent: str) -> DataFrame:
    """A self reference through the same map, after all rows are mapped; null where the parent is not."""
    return identity_lookup(source, identity, model, parent, out="parent_target_id")


def resolve_foreign(source: DataFrame, targets: DataFrame, key: str, target_key: str, policy: str) -> tuple[DataFrame, DataFrame]:
    return missing_keys(source, targets, key, target_key, policy)


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """current with changes laid over it: a changed row is replaced whole, a new one added."""
    return current.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def upsert_fields(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """current with the fields of changes that have a value; rows of either side stay. Keys are joined null-safe."""
    fields = [c for c in current.columns if c not in keys]
    right = changes.select(*[F.col(c).alias(f"__{c}") for c in changes.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    j = current.join(right, on, "full_outer")
    return j.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], *[(F.coalesce(f"__{c}", c) if f"__{c}" in right.columns else F.col(c)).alias(c) for c in fields])


def create_update_delete(current: DataFrame, key: str, ids: list, values: dict[str, object] | None = None, most: int = 200, delete: bool = False) -> DataFrame:
    """What a bulk write of at most `most` targets would do: key, action, and the new values; nothing is written."""
    chosen = current.where(F.col(key).isin(*ids[:most]))
    action = F.lit("delete" if delete else "update")
    return chosen.withColumns({k: F.lit(v) for k, v in (values or {}).items()}).withColumn("action", action)


def unpivot_translations(df: DataFrame, model: str, id_col: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """model, record, field, lang, value of each translated column: fields maps column -> (field, lang)."""
    long = df.unpivot([id_col], list(fields), "column", "value").where("value is not null")
    pick = lambda i: F.create_map(*[F.lit(x) for c, v in fields.items() for x in (c, v[i])])[F.col("column")]
    return long.select(F.lit(model).alias("model"), F.col(id_col).cast("string").alias("record"), pick(0).alias("field"), pick(1).alias("lang"), F.col("value").cast("string").alias("value"))


def pivot_translations(long: DataFrame, fields: list[str]) -> DataFrame:
    return long.groupBy("model", "record", "lang").pivot("field", fields).agg(F.first("value"))


def elide(values: Column) -> Column:
    """A map without its empty values."""
    return F.map_filter(values, lambda k, v: v.isNotNull() & ~v.isin("", "[]", "false"))


def queue(existing: DataFrame, new: DataFrame, keys: list[str], items: str) -> DataFrame:
    """Pending work by key: new items after the old ones, each once."""
    both = existing.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("__o", items))), lambda x: x[items])
    return both.groupBy(*keys).agg(F.array_distinct(F.flatten(lists)).alias(items))


def apply_queue(pending: DataFrame, identity: DataFrame, keys: list[str], items: str, model: str) -> DataFrame:
    """keys, ids of the queued items that are mapped now, and how many still wait."""
    e = pending.select(*keys, F.explode(items).alias("item"))
    j = identity_lookup(e, identity, model, "item")
    return j.groupBy(*keys).agg(F.array_sort(F.collect_list("target_id")).alias("ids"), F.count_if(F.col("target_id").isNull()).alias("waiting"))
