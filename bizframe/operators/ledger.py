"""Transactions and their append-only events: retry, health, retention, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states a transaction may go to.
TRANSITIONS = {"draft": ["pending", "cancelled"], "pending": ["done", "failed", "warning", "cancelled"], "failed": ["pending", "cancelled"], "warning": ["pending", "done", "cancelled"], "done": [], "cancelled": []}


def retry_due(transactions: DataFrame, rules: DataFrame, as_of: Column, limit: int = 50) -> DataFrame:
    """Failed transactions whose time has come and whose rule retries, oldest first."""
    auto = rules.where("auto_retry").select("rule_id", "max_retry_count")
    due = (F.col("state") == "failed") & (F.col("next_retry_at") <= as_of)
    return transactions.where(due).join(auto, "rule_id").where("retry_count < max_retry_count").orderBy("next_retry_at", "transaction_id").limit(limit)


def schedule_retry(transactions: DataFrame, as_of: Column, delay_minutes: Column) -> DataFrame:
    """The next attempt's time while attempts are left, and one attempt more."""
    more = F.col("retry_count") < F.col("max_retry_count")
    return transactions.withColumns({"next_retry_at": F.when(more, F.timestamp_add("MINUTE", delay_minutes, as_of)), "retry_count": F.col("retry_count") + more.cast("int")})


def retry_outcome(result: Column) -> Column:
    """What a handler gave back, as a state: true, a warning, or anything else."""
    return F.when(result == "true", "done").when(result == "warning", "warning").otherwise("failed")


def allowed_transition(old: Column, new: Column) -> Column:
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return F.coalesce(F.array_contains(table[old], new), F.lit(False))


def event_counts(events: DataFrame, key: str, kind: str, error: list[str], warning: list[str]) -> DataFrame:
    """All, error and warning events per key, in one pass."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col(kind).isin(*error)).alias("n_errors"), F.count_if(F.col(kind).isin(*warning)).alias("n_warnings"))


def attempts(events: DataFrame, key: str, kind: str, retry: str) -> DataFrame:
    return events.groupBy(key).agg(F.count_if(F.col(kind) == retry).alias("attempts"))


def append_events(ledger: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """The ledger with events whose id it lacks: events are never changed."""
    return ledger.unionByName(new.join(ledger.select(id_col), id_col, "left_anti"), allowMissingColumns=True)


def resolve_events(ledger: DataFrame, resolved: DataFrame, id_col: str, at: Column) -> DataFrame:
    """Resolution columns set where the id is among the resolved; all else stays."""
    flag = resolved.select(id_col).distinct().withColumn("__hit", F.lit(True))
    j = ledger.join(flag, id_col, "left")
    return j.withColumns({"resolved": F.coalesce(F.col("resolved") | F.col("__hit"), F.col("resolved"), F.lit(False)), "resolved_at": F.when(F.col("__hit") & F.col("resolved_at").isNull(), at).otherwise(F.col("resolved_at"))}).drop("__hit")


def open_issues(events: DataFrame, key: str, kind: str, bad: list[str]) -> DataFrame:
    return events.groupBy(key).agg(F.bool_or(F.col(kind).isin(*bad) & ~F.col("resolved")).alias("open_issue"))


def retain(df: DataFrame, ts: str, as_of: Column, days: int, payload: list[str]) -> DataFrame:
    """Payload columns nulled where the row is older than so many days."""
    old = F.col(ts) < F.timestamp_add("DAY", F.lit(-days), as_of)
    return df.withColumns({c: F.when(~old, F.col(c)) for c in payload})


def expire(df: DataFrame, state: str, until: str, as_of: Column) -> DataFrame:
    return df.withColumn(state, F.when((F.col(state) == "active") & (F.col(until) <= as_of), "expired").otherwise(F.col(state)))


def health_issues(checks: dict[str, DataFrame], key: str) -> DataFrame:
    """key, issue: the rows of every check's frame under its name."""
    rows = [df.select(F.col(key).cast("string").alias(key), F.lit(name).alias("issue")) for name, df in checks.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def health_state(issues: DataFrame, all_keys: DataFrame, key: str) -> DataFrame:
    """Each key's issues as one message, and warning or healthy."""
    text = issues.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("issue")), "; ").alias("message"))
    return all_keys.select(F.col(key).cast("string").alias(key)).distinct().join(text, key, "left").withColumn("health", F.when(F.col("message").isNull(), "healthy").otherwise("warning"))


def applicable_rules(documents: DataFrame, rules: DataFrame, doc: str) -> DataFrame:
    """Per document the rule by company pair and trigger, partner rules before open ones; several equals are an error."""
    on = (documents["source_company"] == rules["source_company"]) & (documents["destination_company"] == rules["destination_company"]) & (rules["trigger"] == documents["trigger"]) & (rules["partner"].isNull() | (rules["partner"] == documents["partner"]))
    j = documents.join(rules.where("active"), on).select(documents[doc], rules["rule_id"], F.when(rules["partner"].isNotNull(), 0).otherwise(1).alias("rank"))
    best = j.withColumn("best", F.min("rank").over(Window.partitionBy(doc))).where("rank = best")
    return best.groupBy(doc).agg(F.min("rule_id").alias("rule_id"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


def supersede(memory: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows valid, the valid ones of the same keys superseded."""
    hit = new.select(*keys).distinct().withColumn("__hit", F.lit(True))
    old = memory.join(hit, keys, "left").withColumn("state", F.when((F.col("state") == "valid") & F.col("__hit"), "superseded").otherwise(F.col("state"))).drop("__hit")
    return old.unionByName(new.withColumn("state", F.lit("valid")))
