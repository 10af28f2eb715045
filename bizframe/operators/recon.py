"""Two-sided documents: line differences, tolerance, allocation, clearing, states, mirrored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_issues(a: DataFrame, b: DataFrame, doc: str, key: str, quantity: str, kind: str, tolerance: float = 0.0001) -> DataFrame:
    """Per document: lines missing on either side, of another kind, or whose quantities differ, by a full outer join of line keys."""
    side = lambda df, p: df.select(doc, key, F.col(quantity).alias(f"q{p}"), F.col(kind).alias(f"k{p}"), F.lit(1).alias(f"in{p}"))
    j = side(a, "a").join(side(b, "b"), [doc, key], "full_outer")
    both = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    return j.groupBy(doc).agg(
        F.count_if(F.col("inb").isNull()).alias("missing_in_b"),
        F.count_if(F.col("ina").isNull()).alias("missing_in_a"),
        F.count_if(both & ~F.col("ka").eqNullSafe(F.col("kb"))).alias("kind_mismatch"),
        F.count_if(both & (F.abs(F.col("qa") - F.col("qb")) > tolerance)).alias("quantity_mismatch"),
    )


def normalized(df: DataFrame, c: str) -> Column:
    """A field as differences compare it: numbers to six digits, lists sorted."""
    kind = df.schema[c].dataType.simpleString()
    if kind in ("float", "double") or kind.startswith("decimal"):
        return F.round(c, 6).cast("string")
    if kind.startswith("array"):
        return F.array_join(F.array_sort(F.col(c).cast("array<string>")), ",")
    return F.col(c).cast("string")


def field_changes(source: DataFrame, target: DataFrame, keys: list[str], fields: list[str], destructive: tuple[str, ...] = ()) -> DataFrame:
    """keys, action (create, update, delete), field, old, new, destructive: what makes target equal to source."""
    pack = lambda df, name: df.select(*keys, F.map_from_entries(F.array(*[F.struct(F.lit(c), normalized(df, c)) for c in fields])).alias(name))
    j = pack(source, "new").join(pack(target, "old"), keys, "full_outer")
    action = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").otherwise("update")
    rows = j.withColumn("action", action).select(*keys, "action", "old", "new", F.explode(F.array(*[F.lit(c) for c in fields])).alias("field"))
    rows = rows.select(*keys, "action", "field", F.col("old")[F.col("field")].alias("old"), F.col("new")[F.col("field")].alias("new"))
    risky = (F.col("action") == "delete") | ((F.col("action") == "update") & F.col("field").isin(*destructive) if destructive else F.lit(False))
    return rows.where((F.col("action") != "update") | ~F.col("old").eqNullSafe(F.col("new"))).withColumn("destructive", risky)


def guard(changes: DataFrame, keys: list[str], create: bool = True, delete: bool = False) -> tuple[DataFrame, DataFrame]:
    """Changes that the rule allows, and one violation row per key and kind that it does not."""
    denied = F.when((F.col("action") == "create") & (not create), "creation_not_allowed").when((F.col("action") == "delete") & (not delete), "deletion_not_allowed")
    marked = changes.withColumn("violation", denied)
    return marked.where("violation is null").drop("violation"), marked.where("violation is not null").select(*keys, "violation").distinct()


def conflict(source_at: Column, target_at: Column, synced_at: Column, policy: str) -> Column:
    """Both sides changed since the last sync: block, or the side the policy names; else the side that changed."""
    s, t = source_at > synced_at, target_at > synced_at
    return F.when(s & t, policy).when(s, "source").when(t, "destination").otherwise("none")


def match_metrics(pairs: DataFrame, amount_tolerance: float, days: int) -> DataFrame:
    """pairs (amount_a, amount_b, date_a, date_b, ccy_a, ccy_b) with differences, flags and the basis of the match."""
    c = F.col
    gap = F.round(F.abs(c("amount_a") - c("amount_b")), 2)
    late = F.abs(F.datediff("date_a", "date_b"))
    amount_ok, date_ok, ccy_ok = gap <= amount_tolerance, late.isNull() | (late <= days), c("ccy_a") == c("ccy_b")
    basis = F.when(~ccy_ok, "currency_mismatch").when(~amount_ok, "amount_difference").when(~date_ok, "date_difference").when(gap == 0, "exact").otherwise("within_tolerance")
    return pairs.withColumns({"amount_gap": gap, "day_gap": late, "within": amount_ok & date_ok & ccy_ok, "basis": basis})


def allocate(lines: DataFrame, keys: list[str], open_col: str, target_col: str, order: list[str]) -> DataFrame:
    """Greedy: a document's target goes down its open lines in order; lines that take something, with `allocated`."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(target_col) - F.coalesce(F.sum(open_col).over(before), F.lit(0))
    return lines.withColumn("allocated", F.round(F.greatest(F.lit(0.0), F.least(F.col(open_col), left)), 2)).where("allocated > 0")


def clearing_entries(allocations: DataFrame, keys: list[str], kind: str, accounts: dict[str, str]) -> DataFrame:
    """Balanced entries: each allocation on its own line's reverse side, and one counter line per kind (receivable, payable)."""
    receivable = F.col(kind) == "receivable"
    amount = F.col("allocated")
    zero = F.lit(0.0)
    detail = allocations.select(*keys, kind, F.lit("line").alias("role"), F.col(kind).alias("account"), F.when(receivable, zero).otherwise(amount).alias("debit"), F.when(receivable, amount).otherwise(zero).alias("credit"))
    counter = F.create_map(*[F.lit(x) for pair in accounts.items() for x in pair])
    sums = allocations.groupBy(*keys, kind).agg(F.round(F.sum("allocated"), 2).alias("allocated"))
    against = sums.select(*keys, kind, F.lit("counter").alias("role"), counter[F.col(kind)].alias("account"), F.when(receivable, amount).otherwise(zero).alias("debit"), F.when(receivable, zero).otherwise(amount).alias("credit"))
    return detail.unionByName(against)


def balance(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(F.round(F.sum("debit"), 2).alias("debit"), F.round(F.sum("credit"), 2).alias("credit")).withColumn("balanced", F.abs(F.col("debit") - F.col("credit")) < 0.005)


def reversal(entries: DataFrame) -> DataFrame:
    return entries.withColumns({"debit": F.col("credit"), "credit": F.col("debit")})


def internal_payments(allocations: DataFrame, keys: list[str], side: str, kind: str) -> DataFrame:
    """One payment per side: inbound for receivables."""
    way = F.when(F.col(kind) == "receivable", "inbound").otherwise("outbound")
    return allocations.groupBy(*keys, side, kind).agg(F.round(F.sum("allocated"), 2).alias("amount")).withColumn("payment_type", way)


def match_state(cancelled: Column, settled: Column, proposed: Column, differs: Column) -> Column:
    return F.when(cancelled, "cancelled").when(settled, "settled").when(proposed, "proposed").when(differs, "mismatch").otherwise("draft")


def post_outcome(source_ok: Column, target_ok: Column) -> Column:
    return F.when(source_ok & target_ok, "posted").when(source_ok, "partially_posted").otherwise("failed")


def proposal(residual_a: Column, residual_b: Column, ccy_a: Column, ccy_b: Column, partial: bool) -> tuple[Column, Column]:
    """The amount both sides can settle, and why there is none."""
    amount = F.least(residual_a, residual_b)
    error = F.when(ccy_a != ccy_b, "currency").when(amount <= 0, "nothing_open").when((residual_a != residual_b) & (not partial), "partial_not_allowed")
    return F.when(error.isNull(), amount), error


def approved(source: Column, target: Column, dual: Column) -> Column:
    return F.when(dual, source & target).otherwise(source | target)


def moves_with_counts(a: DataFrame, b: DataFrame, move: str) -> DataFrame:
    """How often each move stands on either side of a match."""
    return a.select(F.col(move).alias("move")).unionAll(b.select(F.col(move).alias("move"))).groupBy("move").agg(F.count(F.lit(1)).alias("n"))


def totals_in(df: DataFrame, keys: list[str], amounts: list[str], currency: str) -> DataFrame:
    """Sums of converted amounts, and whether more than one currency met."""
    return df.groupBy(*keys).agg(*[F.round(F.sum(a), 2).alias(a) for a in amounts], (F.count_distinct(currency) > 1).alias("currency_mismatch"))


#: A document's kind as its counterpart has it.
INVERSE = {"out_invoice": "in_invoice", "in_invoice": "out_invoice", "out_refund": "in_refund", "in_refund": "out_refund"}


def inverse_kind(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair])[c]


def document_role(side: Column, kind: Column) -> Column:
    return F.concat(side, F.lit("_"), F.when(kind.endswith("_refund"), "refund").when(kind.endswith("_invoice"), "invoice").otherwise("entry"))


def counterpart(header: DataFrame, reference: str, kind: str, source: str, target: str) -> DataFrame:
    """The mirrored header: kind inverted, companies swapped, the source's reference kept."""
    return header.withColumns({kind: inverse_kind(F.col(kind)), source: F.col(target), target: F.col(source), "origin": F.col(reference)})


def create_or_link(wanted: DataFrame, existing: DataFrame, key: str, id_col: str, state: str, posted_editable: bool = False) -> DataFrame:
    """wanted with counterpart id and action: create, link, or read_only for a posted one; cancelled ones do not count."""
    live = existing.where(F.col(state) != "cancel").groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(id_col, state), id_col).alias("__x"))
    j = wanted.join(live, F.col(key) == F.col("__k"), "left")
    fixed = (F.col(f"__x.{state}") == "posted") & (not posted_editable)
    return j.select(*wanted.columns, F.col(f"__x.{id_col}").alias("counterpart"), F.when(F.col("__x").isNull(), "create").when(fixed, "read_only").otherwise("link").alias("action"))


def done_quantities(moves: DataFrame, key: str, quantity: str, ratio: str) -> DataFrame:
    """Per key the converted quantity done, where it is not zero."""
    return moves.groupBy(key).agg(F.round(F.sum(F.col(quantity) * F.col(ratio)), 4).alias("done")).where("done <> 0")


def apply_delivery(planned: Column, delivered: Column) -> Column:
    return F.greatest(planned, F.coalesce(delivered, planned))


def snapshot(df: DataFrame, fields: list[str]) -> Column:
    """The fields as JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(fields)))
