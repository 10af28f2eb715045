"""Governed reading: filter, project, page, count, aggregate and group under a policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.domain import GATEWAY_OPERATORS, TOOL_OPERATORS, apply
from ..plans.registry import AGGREGATES, DEFAULT_LIMIT, MAX_LIMIT, Policy, Registry, aggregatable, groupable


def order_columns(order: str | None) -> list[Column]:
    """'amount desc, id' as columns."""
    out = []
    for part in (order or "").split(","):
        name, _, way = part.strip().partition(" ")
        if name:
            out.append(F.col(name).desc_nulls_last() if way.strip().lower() == "desc" else F.col(name).asc_nulls_first())
    return out


class Access:
    """A registry seen through a policy."""

    def __init__(self, registry: Registry, policy: Policy | None = None, operators: tuple[str, ...] = TOOL_OPERATORS):
        self.registry, self.policy, self.operators = registry, policy, operators

    def _policy(self, model: str) -> Policy:
        return self.policy if self.policy and self.policy.model == model else Policy(model)

    def rows(self, model: str, domain: list = (), active_only: bool = False) -> DataFrame:
        """All rows of the model that the domain, the company scope and the active flag let through."""
        m, policy = self.registry.models[model], self._policy(model)
        df = apply(self.registry, model, list(domain), self.operators)
        scope = policy.scope(m)
        df = df if scope is None else df.where(scope)
        return df.where(F.col(m.active)) if active_only and m.active else df

    def project(self, df: DataFrame, model: str, fields: list[str] | None = None) -> DataFrame:
        """Requested fields that are allowed; id and label if none is."""
        m = self.registry.models[model]
        allowed = self._policy(model).fields(df, m)
        picked = [c for c in fields if c in allowed] if fields else allowed
        return df.select(*(picked or list(dict.fromkeys([m.id, m.label]))))

    def search_read(self, model: str, domain: list = (), fields: list[str] | None = None, limit: int = DEFAULT_LIMIT, order: str | None = None, offset: int = 0) -> DataFrame:
        m, most = self.registry.models[model], min(MAX_LIMIT, self._policy(model).limit)
        df = self.rows(model, domain).orderBy(*order_columns(order), F.col(m.id))
        return self.project(df.offset(max(0, offset)).limit(max(0, min(limit, most))), model, fields)

    def bundle(self, model: str, domain: list = (), fields: list[str] | None = None, limit: int = DEFAULT_LIMIT, order: str | None = None) -> tuple[DataFrame, list[str]]:
        """The rows, and the requested fields that the policy hides."""
        shown = set(self._policy(model).fields(self.registry.frame(model), self.registry.models[model]))
        return self.search_read(model, domain, fields, limit, order), [c for c in fields or [] if c not in shown]

    def get(self, model: str, record_id, fields: list[str] | None = None) -> DataFrame:
        return self.project(self.rows(model, [[self.registry.models[model].id, "=", record_id]]), model, fields)

    def name_search(self, model: str, term: str, limit: int = 10) -> DataFrame:
        m = self.registry.models[model]
        return self.rows(model, [[m.label, "ilike", term]]).select(m.id, m.label).orderBy(m.label, m.id).limit(min(limit, 50))

    def term_search(self, model: str, term: str, fields: list[str], extra: list = (), limit: int = DEFAULT_LIMIT) -> DataFrame:
        """Any of the fields holds the term, and the extra domain holds."""
        hit = reduce(lambda a, b: a | b, [F.col(c).cast("string").ilike(f"%{term}%") for c in fields])
        return self.rows(model, extra).where(hit).orderBy(self.registry.models[model].id).limit(limit)

    def recent(self, model: str, limit: int = 5) -> DataFrame:
        m = self.registry.models[model]
        return self.rows(model).orderBy(F.col(m.date).desc_nulls_last(), F.col(m.id).desc()).limit(limit)

    def with_provenance(self, df: DataFrame, model: str) -> DataFrame:
        m = self.registry.models[model]
        return df.withColumn("provenance", F.struct(F.lit(model).alias("model"), F.col(m.id).cast("string").alias("record")))

    def count(self, model: str, domain: list = ()) -> DataFrame:
        return self.rows(model, domain).agg(F.count(F.lit(1)).alias("count"))

    def aggregate(self, model: str, field: str, op: str, domain: list = ()) -> DataFrame:
        """value (0 where there is nothing) and row_count."""
        df = self.rows(model, domain)
        if not aggregatable(df, field, op):
            raise ValueError(f"{op}({field}) is not possible")
        return df.agg(F.coalesce(AGGREGATES[op](field), F.lit(0)).alias("value"), F.count(F.lit(1)).alias("row_count"))

    def group(self, model: str, keys: list[str], specs: list[str] = (), domain: list = (), limit: int = MAX_LIMIT, order: str | None = None, undefined: str | None = None) -> DataFrame:
        """specs like 'amount:sum', named amount_sum; without any, row_count. The last one, largest first, orders."""
        df = self.rows(model, domain)
        if bad := [k for k in keys if not groupable(df, k)]:
            raise ValueError(f"cannot group by {bad}")
        parts = [s.split(":") for s in specs]
        if bad := [s for s in parts if len(s) != 2 or not aggregatable(df, *s)]:
            raise ValueError(f"cannot aggregate {bad}")
        aggregates = [AGGREGATES[op](c).alias(f"{c}_{op}") for c, op in parts] or [F.count(F.lit(1)).alias("row_count")]
        if undefined is not None:
            df = df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit(undefined)) for k in keys})
        last = f"{parts[-1][0]}_{parts[-1][1]}" if parts else "row_count"
        by = order_columns(order) or [F.col(last).desc_nulls_last()]
        return df.groupBy(*keys).agg(*aggregates).orderBy(*by, *keys).limit(min(limit, MAX_LIMIT))


def gateway(registry: Registry, policy: Policy | None = None) -> Access:
    return Access(registry, policy, GATEWAY_OPERATORS)


def keep_order(df: DataFrame, visible: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """The rows whose ids are still visible, in the order they had."""
    return df.join(visible.select(id_col).distinct(), id_col, "left_semi").orderBy(order_col)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def newest_versions(df: DataFrame, version_col: str, keep: int) -> DataFrame:
    """The rows of the newest `keep` versions."""
    wanted = df.select(version_col).where(F.col(version_col).isNotNull()).distinct().orderBy(F.col(version_col).desc()).limit(keep)
    return df.join(F.broadcast(wanted) if keep <= 10_000 else wanted, version_col, "left_semi")


def model_ranking(models: DataFrame, score: Column, order: str = "sequence", key: str = "model", limit: int = 5) -> DataFrame:
    return models.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), order, key).limit(limit)
