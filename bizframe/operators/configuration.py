"""Values to write, configurations and dimensions as rows: sanitised, checked, grouped.

Maps of written values are exploded only for what needs their keys as rows; checks are conditions over a configuration's
columns, so that all configurations are checked in one pass. Nothing here is refused by an exception: what is wrong is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a variant that are its structure and never copied, and what a group expression may ask of a date.
STRUCTURE = ["product_template_attribute_value_ids", "product_template_variant_value_ids", "combination_indices", "product_tmpl_id", "attribute_line_ids"]
GRAINS = {"day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def sanitise(df: DataFrame, values: str, kinds: dict[str, str], allowed: list[str] | None = None) -> DataFrame:
    """df with `clean`, `unknown`, `blocked`, `unreadable` in place of a map of texts: known and allowed fields with a value that
    their kind (a Spark type) can read, and the names of the others, sorted. Empty values are left out; a row with any name
    in the last three is not to be written."""
    known = F.array(*[F.lit(k) for k in kinds])
    may = known if not allowed else F.array(*[F.lit(k) for k in allowed])
    keys, v = F.map_keys(values), F.col(values)
    readable = lambda k, x: F.coalesce(*[F.when((k == name) & x.try_cast(kind).isNotNull(), True) for name, kind in kinds.items()], F.lit(False))
    usable = lambda k: F.array_contains(known, k) & F.array_contains(may, k)
    given = F.map_filter(v, lambda k, x: usable(k) & x.isNotNull() & (F.trim(x) != ""))
    return df.withColumns({
        "clean": F.map_filter(given, readable),
        "unknown": F.array_sort(F.filter(keys, lambda k: ~F.array_contains(known, k))),
        "blocked": F.array_sort(F.filter(keys, lambda k: F.array_contains(known, k) & ~F.array_contains(may, k))),
        "unreadable": F.array_sort(F.map_keys(F.map_filter(given, lambda k, x: ~readable(k, x)))),
    })


def template_issues(templates: DataFrame, mappings: DataFrame, fields: DataFrame) -> DataFrame:
    """template_id, issue. templates: template_id, model, header_row, data_row. mappings: template_id, target, header, column,
    default. fields: model, field."""
    t = templates.join(mappings.groupBy("template_id").agg(F.count(F.lit(1)).alias("__n")), "template_id", "left")
    own = F.array_compact(F.array(
        F.when((F.col("header_row") < 1) | (F.col("data_row") < 1), "rows_not_positive"),
        F.when(F.col("data_row") <= F.col("header_row"), "data_before_header"),
        F.when(F.col("__n").isNull(), "no_mapping"),
    ))
    j = mappings.join(templates.select("template_id", "model"), "template_id")
    given = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    empty = j.where(~(given("header") | given("column") | given("default"))).select("template_id", F.concat(F.lit("no_source:"), "target").alias("issue"))
    there = fields.select("model", F.col("field").alias("target")).distinct()
    lost = j.join(there, ["model", "target"], "left_anti").select("template_id", F.concat(F.lit("no_field:"), "target").alias("issue"))
    return t.select("template_id", F.explode(own).alias("issue")).unionByName(empty).unionByName(lost).distinct()


def rule_issues(rules: DataFrame, journals: DataFrame) -> DataFrame:
    """rule_id, issue of enabled reconciliation rules. rules: rule_id, enabled, date_tolerance, amount_tolerance,
    writeoff_tolerance, currency_strategy, currency, strategy, create_payments, auto_reconcile, auto_post, source_company,
    destination_company, source_clearing, destination_clearing (journals). journals: journal, company, kind."""
    payments = F.col("strategy") == "create_internal_payments"
    checks = [
        *[(F.col(f"{c}_tolerance") < 0, f"negative_{c}_tolerance") for c in ("date", "amount", "writeoff")],
        ((F.col("currency_strategy") == "configured_settlement_currency") & F.col("currency").isNull(), "no_currency"),
        (F.col("strategy") == "multilateral_clearing", "multilateral"),
        (F.col("create_payments") & ~payments, "payments_without_strategy"),
        (payments & ~F.col("create_payments"), "strategy_without_payments"),
        (F.col("auto_reconcile") & ~F.col("auto_post"), "reconcile_without_post"),
    ]
    df = rules.where("enabled")
    for side in ("source", "destination"):
        j = journals.select(F.col("journal").alias(f"__j_{side}"), F.col("company").alias(f"__c_{side}"), F.col("kind").alias(f"__k_{side}"))
        df = df.join(j, F.col(f"{side}_clearing") == F.col(f"__j_{side}"), "left")
        has = F.col(f"{side}_clearing").isNotNull()
        checks += [
            (has & ~F.col(f"__c_{side}").eqNullSafe(F.col(f"{side}_company")), f"{side}_clearing_company"),
            (has & F.col(f"__k_{side}").isNotNull() & (F.col(f"__k_{side}") != "general"), f"{side}_clearing_kind"),
        ]
    return df.select("rule_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), name) for on, name in checks]))).alias("issue"))


def dimension(expression: str, labels: dict[str, str] | None = None) -> Column:
    """A group expression as a column: `date_order:month` is the period's first day, others the field, with its label if it has one."""
    name, _, grain = expression.partition(":")
    if grain:
        if grain not in GRAINS:
            raise ValueError(f"unknown grain {grain!r}")
        return F.date_trunc(GRAINS[grain], F.col(name)).cast("date").alias(f"{name}_{grain}")
    c = F.col(name)
    if not labels:
        return c
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[c.cast("string")], c.cast("string")).alias(name)


def grouped_metric(df: DataFrame, op: str, field: str, by: list[str], labels: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """A metric (count, count_distinct, sum, avg, min, max) per dimension."""
    agg = {"count": F.count, "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op]
    return df.groupBy(*[dimension(e, (labels or {}).get(e)) for e in by]).agg(agg(field).alias("value"), F.count(F.lit(1)).alias("n"))


def refresh_generated(existing: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """existing with what is found: new keys are added as generated, the text of generated rows is renewed, others stay.
    Both: key, text; existing also generated."""
    new = found.groupBy(key).agg(F.max("text").alias("__text"))
    both = existing.join(new, key, "full_outer")
    made = F.coalesce(F.col("generated"), F.lit(True))
    return both.select(key, F.when(made & F.col("__text").isNotNull(), F.col("__text")).otherwise(F.col("text")).alias("text"), made.alias("generated"))


def still_valid(memory: DataFrame, now: DataFrame, same: list[str]) -> DataFrame:
    """memory with `valid`: whether its row of the same user has the present values in all of `same` (null equals null)."""
    n = now.select(F.col("user").alias("__user"), *[F.col(c).alias(f"__{c}") for c in same])
    j = memory.join(n, F.col("user") == F.col("__user"), "left")
    ok = F.col("__user").isNotNull()
    for c in same:
        ok = ok & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return j.withColumn("valid", ok).select(*memory.columns, "valid")


def row_map(headers: Column, cells: Column) -> Column:
    """A list of cells by header; headers without a cell are null, cells without a header are left out, a repeated header's last counts."""
    n = F.size(headers)
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(None).cast("string"), n)), F.lit(1), n)
    pairs = F.arrays_zip(headers.alias("h"), padded.alias("c"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(headers, i + 2, F.greatest(n - i, F.lit(0))), p["h"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["h"], p["c"])))


def without_structure(values: Column, keys: list[str] | None = None) -> Column:
    drop = [F.lit(k) for k in (STRUCTURE if keys is None else keys)]
    return F.map_filter(values, lambda k, _: ~k.isin(*drop))
