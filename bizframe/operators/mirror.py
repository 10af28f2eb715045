"""Documents mirrored between companies: line builds, order and stock drivers, link-back, and the gates of settlements.

Each builder is a projection over lines joined to what they map to (products, units, accounts, taxes), so it shuffles only
where a mapping is too large to broadcast. Flags of a rule are columns: rows of different rules are built together. Nulls
in a flag count as off; a line without a mapped product has a null product and the error `no_product`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that carry text only, and the lines that the commercial part of a document consists of.
TEXT_LINES = ["line_section", "line_subsection", "line_note"]
COMMERCIAL_LINES = ["product", *TEXT_LINES]
#: Account types of open items, states of a settlement that is over, and moves that can be matched.
OPEN_TYPES = ["asset_receivable", "liability_payable"]
FINAL_STATES = ["posted", "reversed", "cancelled"]
MATCHABLE = ["out_invoice", "out_refund", "in_invoice", "in_refund"]


def is_on(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def commercial_lines(lines: DataFrame, kind: str = "display_type") -> DataFrame:
    return lines.where(F.col(kind).isin(COMMERCIAL_LINES))


def invoice_lines(lines: DataFrame, products: DataFrame, accounts: DataFrame) -> DataFrame:
    """Counterpart lines of an invoice.

    lines: line_id, line_key, sequence, name, display_type, product_id, quantity, price_unit, discount, account_id, version,
    sync_quantities, sync_discounts. products, accounts: source_id, target_id. Text lines keep their name and kind only.
    """
    j = lines.join(products.select(F.col("source_id").alias("product_id"), F.col("target_id").alias("__product")), "product_id", "left")
    j = j.join(accounts.select(F.col("source_id").alias("account_id"), F.col("target_id").alias("__account")), "account_id", "left")
    text = F.coalesce(F.col("display_type").isin(TEXT_LINES), F.lit(False))
    item = lambda c: F.when(~text, c)
    return j.select(
        F.col("line_id").alias("origin_line_id"), "line_key", "sequence", "name",
        F.when(text, F.col("display_type")).otherwise("product").alias("display_type"),
        (F.col("version") + 1).alias("version"),
        item(F.col("__product")).alias("product_id"),
        item(F.when(is_on(F.col("sync_quantities")), F.col("quantity")).otherwise(1.0)).alias("quantity"),
        item(F.col("price_unit")).alias("price_unit"),
        item(F.when(is_on(F.col("sync_discounts")), F.col("discount")).otherwise(0.0)).alias("discount"),
        item(F.coalesce("__account", "account_id")).alias("account_id"),
        item(F.when(F.col("__product").isNull(), "no_product")).alias("error"),
    )


def order_lines(lines: DataFrame, products: DataFrame, quantity: str, target_quantity: str, planned: str | None = None) -> DataFrame:
    """Counterpart lines of an order, sale to purchase or back.

    lines: line_key, sequence, name, display_type, product_id, ratio (of the line's unit), price_unit, discount,
    sync_descriptions, sync_discounts, own_prices (the destination's price list decides), and the quantity and planned columns
    (with sync_planned_dates). products: source_id, target_id, target_name, target_ratio. A quantity is converted between units.
    """
    target = products.select(F.col("source_id").alias("product_id"), F.col("target_id").alias("__product"), F.col("target_name").alias("__name"), F.col("target_ratio").alias("__ratio"))
    j = lines.join(target, "product_id", "left")
    text = F.col("display_type").isNotNull()
    item = lambda c: F.when(~text, c)
    scale = F.col("ratio") / F.col("__ratio")
    more = [item(F.when(is_on(F.col("sync_planned_dates")), F.col(planned))).alias("date_planned")] if planned else []
    return j.select(
        "line_key", "sequence", "display_type",
        F.when(text | is_on(F.col("sync_descriptions")), F.col("name")).otherwise(F.col("__name")).alias("name"),
        item(F.col("__product")).alias("product_id"),
        item(F.round(F.col(quantity) * scale, 4)).alias(target_quantity),
        item(F.when(~is_on(F.col("own_prices")), F.round(F.col("price_unit") / scale, 4))).alias("price_unit"),
        item(F.when(is_on(F.col("sync_discounts")), F.col("discount"))).alias("discount"),
        *more,
        item(F.when(F.col("__product").isNull(), "no_product")).alias("error"),
    )


def sync_documents(sources: DataFrame, existing: DataFrame, line_errors: DataFrame, key: str, eligible: Column) -> DataFrame:
    """One row per source document: action (skip, update, create), and outcome (skipped, failed, success) with its error.

    existing: key, counterpart_id, state; a cancelled counterpart does not count. line_errors: key, error of built lines;
    a document fails with its smallest error, so that reruns agree.
    """
    live = existing.where(F.coalesce(F.col("state"), F.lit("")) != "cancel").groupBy(key).agg(F.max("counterpart_id").alias("counterpart_id"))
    bad = line_errors.where("error is not null").groupBy(key).agg(F.min("error").alias("error"))
    j = sources.withColumn("__go", F.coalesce(eligible, F.lit(False))).join(live, key, "left").join(bad, key, "left")
    action = F.when(~F.col("__go"), "skip").when(F.col("counterpart_id").isNotNull(), "update").otherwise("create")
    outcome = F.when(~F.col("__go"), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("success")
    return j.select(key, action.alias("action"), outcome.alias("outcome"), "counterpart_id", F.when(F.col("__go"), F.col("error")).alias("error"))


def link_back(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, left_id, right_id, link: lines of two documents by their shared key; each side stores the other's id. A line
    key that stands on one side only is left_only or right_only."""
    both = left.select(key, "left_id").join(right.select(key, "right_id"), key, "full_outer")
    state = F.when(F.col("right_id").isNull(), "left_only").when(F.col("left_id").isNull(), "right_only").otherwise("linked")
    return both.select(key, "left_id", "right_id", state.alias("link"))


def move_lines(done: DataFrame, moves: DataFrame, digits: int = 2) -> DataFrame:
    """Counterpart lines of a stock move from what was done: the quantity in the destination's unit, halves away from zero;
    lot, owner and package go along where the rule says so, and lines of nothing are left out.

    done: move_id, quantity, ratio, category, lot_name, owner_id, package. moves: move_id, target_product, target_ratio,
    target_category, sync_lots, sync_owners, sync_packages. Units of different categories give the error `unit`.
    """
    j = done.join(moves, "move_id")
    same = F.col("category").eqNullSafe(F.col("target_category"))
    quantity = F.round(F.col("quantity") * F.col("ratio") / F.col("target_ratio"), digits)
    carried = lambda flag, c: F.when(is_on(F.col(flag)), F.col(c)).alias(c)
    out = j.select(
        "move_id", F.col("target_product").alias("product_id"), F.when(same, quantity).alias("quantity"),
        carried("sync_lots", "lot_name"), carried("sync_owners", "owner_id"), carried("sync_packages", "package"),
        F.when(~same, "unit").alias("error"),
    )
    return out.where("error is not null or quantity <> 0")


def open_items(lines: DataFrame, rounding: float = 0.01) -> DataFrame:
    """Posted receivable and payable lines that are not reconciled or still have a residual."""
    left = F.abs(F.coalesce(F.col("amount_residual"), F.lit(0.0))) >= rounding / 2
    return lines.where((F.col("parent_state") == "posted") & F.col("account_type").isin(OPEN_TYPES) & (~is_on(F.col("reconciled")) | left))


def violations(df: DataFrame, id_col: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """id, check for every check that a row violates; a check whose condition is null is violated."""
    hit = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks]))
    return df.select(id_col, F.explode(hit).alias("check"))


def match_checks(c=F.col) -> list[tuple[str, Column]]:
    """The integrity of a match as conditions over its columns: companies, states, kinds and lines of both sides."""
    sides = ("source", "destination")
    return [
        *[(f"{s}_company_is_the_rules", c(f"{s}_company") == c(f"rule_{s}_company")) for s in sides],
        *[(f"{s}_move_is_the_companys", c(f"{s}_move_company") == c(f"{s}_company")) for s in sides],
        ("both_posted", (c("source_state") == "posted") & (c("destination_state") == "posted")),
        *[(f"{s}_kind", c(f"{s}_kind").isin(MATCHABLE)) for s in sides],
        ("lines_on_both_sides", (c("source_lines") > 0) & (c("destination_lines") > 0)),
        *[(f"{s}_lines_are_the_moves", c(f"{s}_foreign_lines") == 0) for s in sides],
    ]


def ready_to_post() -> Column:
    """Why a settlement cannot be posted, the first reason; null where it can. Reads enabled, state, n_lines, dual,
    source_approved, destination_approved, manager."""
    source, target = is_on(F.col("source_approved")), is_on(F.col("destination_approved"))
    return (
        F.when(~is_on(F.col("enabled")), "disabled")
        .when(F.col("state").isin(FINAL_STATES), "final")
        .when(F.coalesce(F.col("n_lines"), F.lit(0)) == 0, "no_lines")
        .when(is_on(F.col("dual")) & ~(source & target), "dual_approval")
        .when(~is_on(F.col("dual")) & ~(source | target | is_on(F.col("manager"))), "approval")
    )


def single_account_type(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, account_type, error: each side of a payment must have one account type."""
    kinds = lines.groupBy(*keys).agg(F.count_distinct("account_type").alias("n"), F.min("account_type").alias("account_type"))
    return kinds.select(*keys, F.when(F.col("n") == 1, F.col("account_type")).alias("account_type"), F.when(F.col("n") != 1, "account_types").alias("error"))


def internal_metrics(companies: DataFrame, sales: DataFrame, ages: DataFrame, stock: DataFrame, moves: DataFrame, staff: DataFrame) -> DataFrame:
    """company_id, metric, value: a company's own baselines; metrics that have no value are left out.

    sales: company_id, amount_total, amount_tax. ages: company_id, days. stock: company_id, value. moves: company_id, cost.
    staff: company_id. The margin is what is left of the total without tax, the turns are costs over stock.
    """
    total = lambda df, *names: df.groupBy("company_id").agg(*[F.sum(n).alias(n) for n in names])
    j = companies.select("company_id").distinct()
    j = j.join(total(sales, "amount_total", "amount_tax"), "company_id", "left")
    j = j.join(ages.groupBy("company_id").agg(F.round(F.avg("days"), 1).alias("ar_days")), "company_id", "left")
    j = j.join(total(stock, "value"), "company_id", "left").join(total(moves, "cost"), "company_id", "left")
    j = j.join(staff.groupBy("company_id").agg(F.count(F.lit(1)).cast("double").alias("employee_count")), "company_id", "left")
    revenue = F.col("amount_total")
    margin = F.when(revenue != 0, F.round((revenue - F.coalesce("amount_tax", F.lit(0.0))) / revenue * 100, 2))
    turns = F.when(F.col("value") != 0, F.round(F.coalesce("cost", F.lit(0.0)) / F.col("value"), 2))
    named = {"revenue": revenue, "margin": margin, "ar_days": F.col("ar_days"), "inventory_turns": turns, "employee_count": F.col("employee_count")}
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in named.items()])
    return j.select("company_id", F.inline(pairs)).where("value is not null")


def benchmark_context(latest: DataFrame, categories: list[str], country: str | None, industry: str | None) -> DataFrame:
    """Of each wanted category the latest snapshot that fits the slice: series without a period do not count, and a series
    without a country or an industry fits every one. latest: category, series, period_date, value, country, industry."""
    fits = lambda c, v: F.col(c).isNull() if v is None else F.col(c).isNull() | (F.col(c) == v)
    rows = latest.where(F.col("category").isin(categories) & F.col("period_date").isNotNull() & fits("country", country) & fits("industry", industry))
    newest = Window.partitionBy("category").orderBy(F.desc("period_date"), "series")
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def first_fitting(documents: DataFrame, rules: DataFrame, id_col: str, same: list[str], open_: list[str], order: list[str]) -> DataFrame:
    """Each document with its rule: equal in `same`, equal or left open by the rule in `open_`, the first by order.

    The join is on `same`, so rules that are left open meet only the documents of their kind."""
    r = rules.select(*[F.col(c).alias(f"__{c}") for c in rules.columns])
    j = documents.join(r, [F.col(c) == F.col(f"__{c}") for c in same])
    j = j.where(reduce(lambda a, b: a & b, [F.col(f"__{c}").isNull() | (F.col(f"__{c}") == F.col(c)) for c in open_], F.lit(True)))
    best = j.groupBy(id_col).agg(F.min(F.struct(*[f"__{c}" for c in order])).alias("__first"))
    return documents.join(best, id_col, "left").select(*documents.columns, *[F.col(f"__first.__{c}").alias(f"rule_{c}") for c in order])


def union_of(*frames: DataFrame) -> DataFrame:
    """Rows of any of the frames, each once."""
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def gap_text(name: Column, gap: Column) -> Column:
    """'<name>: +1.5% above' for a gap in percent; null for none."""
    side = F.when(gap >= 0, "above").otherwise("below")
    return F.format_string("%s: %+.1f%% %s", name, gap, side)


def narrative_heads(lines: DataFrame, keys: list[str], words: list[str], least: int = 3, window: int = 4) -> DataFrame:
    """keys, line: the first line from which `window` lines together hold at least `least` of the head words."""
    order = Window.partitionBy(*keys).orderBy("line")
    joined = F.lower(F.concat_ws(" ", *[F.lead("text", i).over(order) if i else F.col("text") for i in range(window)]))
    hits = reduce(lambda a, w: a + joined.contains(w.lower()).cast("int"), words, F.lit(0))
    return lines.withColumn("__hits", hits).where(F.col("__hits") >= least).groupBy(*keys).agg(F.min("line").alias("line"))
