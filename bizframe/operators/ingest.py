"""Tabular import by template: typed mapping, error codes, upsert decisions, quarantine and re-import."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.convert import header_get, normal_headers, transform


@dataclass(frozen=True)
class Field:
    """A target column: where its value stands, how it is read, what counts when it is missing."""

    target: str
    header: str
    kind: str = "none"
    required: bool = False
    default: object = None
    sequence: int = 10
    deferred: bool = False


def mapped(rows: DataFrame, fields: list[Field], values: str = "values", row: str = "row_number") -> DataFrame:
    """row, source values, typed target columns, and errors: an array of (field, code) with 'required' and 'invalid'."""
    out, errors = {}, []
    rows = rows.withColumn("__heads", normal_headers(F.col(values)))  # once a row, not once a field
    for f in sorted(fields, key=lambda f: f.sequence):
        raw = F.nullif(F.trim(header_get(F.col(values), f.header, F.col("__heads"))), F.lit(""))
        value = transform(raw, f.kind)
        out[f.target] = value if f.default is None else F.coalesce(value, F.lit(f.default))
        code = F.when(raw.isNotNull() & value.isNull(), "invalid")
        if f.required and f.default is None:
            code = F.when(raw.isNull(), "required").otherwise(code)
        errors.append(F.when(code.isNotNull(), F.struct(F.lit(f.target).alias("field"), code.alias("code"))))
    return rows.select(row, F.col(values).alias("source_values"), *[v.alias(k) for k, v in out.items()], F.array_compact(F.array(*errors)).alias("errors"))


def blank(values: str = "values") -> Column:
    return ~F.exists(F.map_values(values), lambda v: F.length(F.trim(v)) > 0)


def upsert_action(exists: Column, mode: str, duplicates: str) -> Column:
    """create, update, skip or error, for a mode of create, update or create_update and a policy for what exists."""
    if mode == "create":
        return F.when(exists, {"skip": "skip", "update": "update", "error": "error"}[duplicates]).otherwise("create")
    if mode == "update":
        return F.when(exists, "update").otherwise("skip")
    return F.when(exists, {"skip": "skip", "update": "update", "error": "error"}[duplicates]).otherwise("create")


def decide(rows: DataFrame, existing: DataFrame, key: str, existing_key: str, id_col: str, mode: str = "create_update", duplicates: str = "update") -> DataFrame:
    """mapped rows with the existing id and action; rows with errors, or whose key several records have, are errors."""
    side = existing.groupBy(F.col(existing_key).alias("__k")).agg(F.min(id_col).alias("__id"), F.count(F.lit(1)).alias("__n"))
    j = rows.join(side, F.col(key) == F.col("__k"), "left")
    bad = F.size("errors") > 0
    action = F.when(bad | (F.col("__n") > 1), "error").otherwise(upsert_action(F.col("__id").isNotNull(), mode, duplicates))
    kind = F.when(bad, F.element_at("errors", 1)["code"]).when(F.col("__n") > 1, "duplicate").when(action == "error", "exists")
    return j.withColumns({"record_id": F.col("__id"), "action": action, "error_type": kind}).drop("__k", "__id", "__n")


def split(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to write, and the quarantine: row, source values, what was mapped as JSON, error type."""
    rest = [c for c in decided.columns if c not in ("row_number", "source_values", "errors", "action", "record_id", "error_type")]
    bad = decided.where("action = 'error'").select("row_number", "source_values", F.to_json(F.struct(*rest)).alias("mapped_values"), "error_type")
    return decided.where("action in ('create', 'update')"), bad


def reimport(quarantine: DataFrame, fixed: str = "fixed_values") -> DataFrame:
    """Quarantined rows as input again, with the corrected values where there are some."""
    return quarantine.select("row_number", F.coalesce(fixed, "source_values").alias("values"))


def until_first_error(decided: DataFrame) -> DataFrame:
    """Rows before the first one in error."""
    first = decided.agg(F.min(F.when(F.col("action") == "error", F.col("row_number"))).alias("__first"))
    return decided.crossJoin(first).where(F.col("__first").isNull() | (F.col("row_number") < F.col("__first"))).drop("__first")


def summary(decided: DataFrame) -> DataFrame:
    """success, failed, skipped and the state of the run."""
    s = decided.agg(F.count_if(F.col("action").isin("create", "update")).alias("success"), F.count_if(F.col("action") == "error").alias("failed"), F.count_if(F.col("action") == "skip").alias("skipped"))
    return s.withColumn("state", F.when(F.col("failed") == 0, "done").when(F.col("success") > 0, "partial").otherwise("failed"))


def skip_where(rows: DataFrame, condition: str, reason: str) -> DataFrame:
    """A row hook: skip_row and skip_reason by a SQL expression."""
    hit = F.expr(condition)
    return rows.withColumns({"skip_row": F.coalesce(hit, F.lit(False)), "skip_reason": F.when(hit, reason)})


def with_hooks(rows: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Columns set by SQL expressions, before mapping or before writing."""
    return rows.withColumns({k: F.expr(v) for k, v in expressions.items()})


def deferred(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """The second pass: record_id and the deferred columns, most urgent first."""
    return rows.select("record_id", *[f.target for f in sorted(fields, key=lambda f: f.sequence) if f.deferred])


def numbered(df: DataFrame, order: list[str], step: int = 1, keys: list[str] = ()) -> DataFrame:
    part = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return df.withColumn("sequence", F.row_number().over(part) * step)
