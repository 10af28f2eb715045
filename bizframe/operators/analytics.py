"""Health metrics and scores, trends, forecasts, scenarios, benchmarks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import signed_round

#: Fixed weights of the overall score and grade limits.
WEIGHTS = {"liquidity": 0.20, "growth": 0.20, "execution": 0.20, "pipeline": 0.15, "fulfillment": 0.15, "receivable": 0.10}
GRADES = [(90, "A"), (75, "B"), (60, "C"), (45, "D")]
SENSITIVITY = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)


def month_bounds(as_of: date) -> dict[str, date]:
    """Start of month and year, and the comparison window: from the same month a year before to the end of last month."""
    start = as_of.replace(day=1)
    return {"month": start, "year": as_of.replace(month=1, day=1), "ly_from": start.replace(year=start.year - 1), "before": start}


def health_metrics(orders: DataFrame, as_of: date, keys: list[str], amount: str, day: str, state: str, sold: str = "F", open_: str = "O", due_days: int = 30) -> DataFrame:
    """One pass: revenue of the month, year and comparison window, receivables, and open, late and due counts per key."""
    b, d, v, s = month_bounds(as_of), F.col(day).cast("date"), F.col(amount), F.col(state)
    total = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0)), 2)
    due = F.date_add(d, due_days)
    return orders.where(d <= F.lit(as_of)).groupBy(*keys).agg(
        total((s == sold) & (d >= F.lit(b["month"]))).alias("revenue_mtd"),
        total((s == sold) & (d >= F.lit(b["year"]))).alias("revenue_ytd"),
        total((s == sold) & (d >= F.lit(b["ly_from"])) & (d < F.lit(b["before"]))).alias("revenue_same_month_last_year"),
        total(s == open_).alias("ar_total"),
        F.count_if((s == open_) & (due < F.lit(as_of))).alias("overdue_ar"),
        F.count_if((s == "P") & (due < F.lit(as_of))).alias("late_deliveries"),
        F.count_if((s == "P") & (due >= F.lit(as_of))).alias("deliveries_today"),
        F.count_if(s == "P").alias("open_opportunities"),
        total(s == "P").alias("pipeline_value"),
        F.count_if((s != sold) & (due < F.lit(as_of))).alias("overdue_activities"),
    )


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def domain_scores(metrics: DataFrame) -> DataFrame:
    """metrics with six scores of 0 to 100, to one decimal, the weighted overall score and its grade."""
    m = F.col
    growth = 50.0 + (m("revenue_mtd") - m("revenue_same_month_last_year")) / m("revenue_same_month_last_year") * 100
    deliveries = m("late_deliveries") + m("deliveries_today")
    scores = {
        "liquidity": F.when(m("ar_total") > 0, F.greatest(F.lit(0.0), 100.0 - m("overdue_ar") / F.greatest(m("ar_total"), F.lit(1.0)) * 200)).otherwise(75.0),
        "growth": F.when(m("revenue_same_month_last_year") > 0, _clamp(growth)).otherwise(F.when(m("revenue_mtd") > 0, 50.0).otherwise(30.0)),
        "execution": F.when(deliveries > 0, F.greatest(F.lit(0.0), 100.0 - m("late_deliveries") / deliveries * 100)).otherwise(80.0),
        "pipeline": F.when((m("open_opportunities") > 0) & (m("pipeline_value") > 0), F.least(F.lit(100.0), 50.0 + m("open_opportunities") / 10.0 + m("pipeline_value") / 10000.0)).otherwise(30.0),
        "fulfillment": F.greatest(F.lit(0.0), 100.0 - F.least(m("late_deliveries"), F.lit(50)) * 2),
        "receivable": F.greatest(F.lit(0.0), 100.0 - F.least(m("overdue_ar"), F.lit(50)) * 2),
    }
    out = metrics.withColumns({k: F.round(v, 1) for k, v in scores.items()})
    overall = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("overall", F.round(overall, 1))
    grade = F.lit("F")
    for limit, letter in reversed(GRADES):
        grade = F.when(F.col("overall") >= limit, letter).otherwise(grade)
    return out.withColumn("grade", grade)


def warnings(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, domain, severity for every limit that is passed."""
    c = F.col
    #: Fixed limits.
    rules = [("liquidity", "high", c("liquidity") < 40), ("growth", "high", c("growth") < 30), ("fulfillment", "medium", c("late_deliveries") > 5), ("execution", "low", c("overdue_activities") > 10), ("pipeline", "medium", c("pipeline") < 35)]
    rows = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(d).alias("domain"), F.lit(s).alias("severity"))) for d, s, cond in rules]))
    return scored.select(*keys, F.inline(rows))


def receivable_age(df: DataFrame, as_of: date, keys: list[str], day: str) -> DataFrame:
    """Mean days since the date, to one decimal; a missing date counts as today."""
    days = F.datediff(F.lit(as_of), F.coalesce(F.col(day).cast("date"), F.lit(as_of)))
    return df.groupBy(*keys).agg(F.round(F.avg(days), 1).alias("ar_days"))


def trailing_buckets(df: DataFrame, as_of: date, keys: list[str], day: str, amount: str, months: int = 12) -> DataFrame:
    """keys, n (0 is the oldest), period (first of its month), value: windows of a month that start on as_of's day."""
    d = F.col(day).cast("date")
    windows = df.sparkSession.range(months).select(
        F.col("id").cast("int").alias("n"), F.add_months(F.lit(as_of), F.col("id").cast("int") - months).alias("start"), F.add_months(F.lit(as_of), F.col("id").cast("int") - months + 1).alias("stop")
    )
    first, last = F.add_months(F.lit(as_of), -months), F.lit(as_of)
    near = df.where((d >= first) & (d < last))
    back = F.floor(F.months_between(d, first)).cast("int")
    n = F.when(d < F.add_months(first, back), back - 1).when(d >= F.add_months(first, back + 1), back + 1).otherwise(back)
    sums = near.withColumn("n", n).groupBy(*keys, "n").agg(F.sum(amount).alias("value"))
    every = df.select(*keys).distinct().crossJoin(windows)  # months, a fixed number
    return every.join(sums, [*keys, "n"], "left").select(*keys, "n", F.trunc("start", "month").alias("period"), F.coalesce("value", F.lit(0.0)).alias("value"))


def forecast(buckets: DataFrame, keys: list[str], periods: int = 3) -> DataFrame:
    """keys, step, period, value, low, high: a line through the buckets, 1.96 standard deviations either side, floored at 0."""
    g = buckets.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.regr_slope("value", "n").alias("slope"), F.regr_intercept("value", "n").alias("cut"), F.regr_syy("value", "n").alias("syy"), F.regr_sxy("value", "n").alias("sxy"), F.max("period").alias("last")
    )
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.coalesce(F.col("slope"), F.lit(0.0)) * F.col("sxy"))
    g = g.where("n >= 2").withColumn("sd", F.sqrt(rest / F.greatest(F.col("n") - 2, F.lit(1))))
    steps = g.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    raw = F.greatest(F.col("cut") + F.col("slope") * (F.col("n") - 1 + F.col("step")), F.lit(0.0))
    steps = steps.withColumn("raw", raw)
    return steps.select(
        *keys, "step", F.trunc(F.add_months("last", F.col("step")), "month").alias("period"), F.round("raw", 2).alias("value"),
        F.round(F.greatest(F.col("raw") - 1.96 * F.col("sd"), F.lit(0.0)), 2).alias("low"), F.round(F.col("raw") + 1.96 * F.col("sd"), 2).alias("high"),
    )


#: What a scenario moves; any other kind moves all metrics that are not zero.
SCENARIOS = {"price_change": ["revenue_mtd", "pipeline_value"], "volume_change": ["revenue_mtd", "revenue_ytd", "pipeline_value"], "customer_churn": ["revenue_mtd", "pipeline_value"]}
BASELINE = ["revenue_mtd", "revenue_ytd", "ar_total", "pipeline_value", "open_opportunities", "late_deliveries"]


def scenario(metrics: DataFrame, keys: list[str], kind: str, percent: float = 10.0, increase: bool = True) -> DataFrame:
    """keys, metric, baseline, projected, delta, delta_pct."""
    sign = -1 if kind == "customer_churn" or not increase else 1
    names = SCENARIOS.get(kind, BASELINE)
    long = metrics.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("baseline")) for n in names])).alias("x")).select(*keys, "x.*")
    long = long if kind in SCENARIOS else long.where("baseline <> 0")
    new = F.col("baseline") * (1 + sign * percent / 100)
    return long.select(*keys, "metric", "baseline", F.round(new, 2).alias("projected"), F.round(new - F.col("baseline"), 2).alias("delta"), F.lit(float(sign * percent)).alias("delta_pct"))


def sensitivity(metrics: DataFrame, keys: list[str], percent: float = 10.0, increase: bool = True) -> DataFrame:
    sign = 1 if increase else -1
    rows = metrics.select(*keys, "revenue_mtd", F.explode(F.array(*[F.lit(percent * f) for f in SENSITIVITY])).alias("pct"))
    return rows.select(*keys, F.round("pct", 1).alias("change_pct"), F.round(F.col("revenue_mtd") * (1 + sign * F.col("pct") / 100), 2).alias("revenue_impact"))


def floor_percentile(values: Column, p: float) -> Column:
    """Of an array: the value at floor(p / 100 * (n - 1)) of the sorted ones."""
    return F.try_element_at(F.array_sort(values), (F.floor((F.size(values) - 1) * (p / 100)) + 1).cast("int"))


def company_benchmark(per_company: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, quartiles (floor index), sample size and confidence over companies; per_company has one row each."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    n = F.count(value).over(Window.partitionBy(*keys))
    ranked = per_company.where(F.col(value).isNotNull()).withColumns({"__r": rank - 1, "__n": n})
    at = lambda p: F.max(F.when(F.col("__r") == F.floor((F.col("__n") - 1) * p), F.col(value)))
    g = ranked.groupBy(*keys).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), at(0.25).alias("p25"), at(0.75).alias("p75"), F.count(value).alias("sample_size"))
    return g.withColumn("confidence", F.when(F.col("sample_size") >= 5, "high").when(F.col("sample_size") >= 2, "medium").otherwise("low"))


def quartile_band(value: Column, p25: Column, median: Column, p75: Column) -> Column:
    return F.when(value >= p75, "top_quartile").when(value >= median, "above_median").when(value >= p25, "below_median").otherwise("bottom_quartile")


def compare_benchmark(values: DataFrame, benchmark: DataFrame, keys: list[str], value: str) -> DataFrame:
    """values with gap_pct to the median, band and a line of text."""
    j = values.join(benchmark, keys, "left")
    gap = signed_round((F.col(value) - F.col("median")) / F.abs("median") * 100, 1)
    side = F.when(F.col("gap_pct") >= 0, "above").otherwise("below")
    return j.withColumn("gap_pct", gap).withColumn("band", quartile_band(F.col(value), F.col("p25"), F.col("median"), F.col("p75"))).withColumn("gap_text", F.format_string("%+.1f%% %s", "gap_pct", side))


def latest(df: DataFrame, keys: list[str], period: str, filters: dict[str, object] | None = None) -> DataFrame:
    """Each series' newest row; a slice filter lets through rows of that value or of none."""
    for c, v in (filters or {}).items():
        df = df.where(F.col(c).isNull() | (F.col(c) == v))
    rest = [c for c in df.columns if c not in keys]
    return df.where(F.col(period).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(period)).alias("__x")).select(*keys, "__x.*")


def sync_due(frequency: Column, last: Column, as_of: Column) -> Column:
    limit = F.when(frequency == "daily", 1).when(frequency == "weekly", 7).when(frequency == "monthly", 30)
    return last.isNull() | (F.datediff(as_of, last) >= limit)


def next_execution(at: Column, unit: str, number: int) -> Column:
    """The time one interval on; months and years keep the day where they can."""
    if unit in ("month", "year"):
        return F.timestamp_add("MONTH", F.lit(number * (12 if unit == "year" else 1)), at)
    return F.timestamp_add(unit.upper(), F.lit(number), at)


class Kpi:
    """A metric by code: model, field, aggregate, domain; bound to a registry's models."""

    def __init__(self, code: str, model: str | None, field: str, op: str, domain: list = (), category: str = "", date_field: str | None = None):
        self.code, self.model, self.field, self.op, self.domain, self.category, self.date_field = code, model, field, op, list(domain), category, date_field

    def request(self, since: date | None = None, until: date | None = None) -> dict:
        if not self.model:
            raise ValueError(f"{self.code} is bound to no model")
        window = [[self.date_field, ">=", since]] * bool(since and self.date_field) + [[self.date_field, "<", until]] * bool(until and self.date_field)
        return {"model": self.model, "field": self.field, "op": self.op, "domain": [*self.domain, *window]}

    def compute(self, access, since: date | None = None, until: date | None = None) -> DataFrame:
        return access.aggregate(**self.request(since, until)).select(F.lit(self.code).alias("code"), "value", "row_count")


def ratio(access, above: Kpi, below: Kpi) -> DataFrame:
    """One KPI over another; null over zero."""
    a, b = (k.compute(access).select(F.col("value").cast("double").alias(n)) for k, n in ((above, "a"), (below, "b")))
    return a.crossJoin(b).select(F.try_divide("a", "b").alias("value"))
