"""Models (named DataFrames with relations), what they mean, and what a policy lets be seen of them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, NumericType

#: Fixed limits.
DEFAULT_LIMIT, MAX_LIMIT = 25, 200
#: The module a model belongs to, by prefix.
ROLES = {"sale": "sales", "crm": "sales", "account": "finance", "purchase": "procurement", "stock": "inventory", "hr": "people", "project": "projects"}
#: Words that tell state values apart.
CLOSED_TERMS = ("done", "closed", "paid", "posted", "won")
INACTIVE_TERMS = ("cancel", "lost", "reject", "archive")


@dataclass(frozen=True)
class Relation:
    """A field that leads to another model: many2one on a key here, or one2many on a key there."""

    model: str
    key: str
    kind: str = "many2one"


@dataclass(frozen=True)
class Model:
    name: str
    table: str
    id: str
    label: str
    parent: str | None = None
    company: str | None = None
    active: str | None = None
    amount: str | None = None
    date: str | None = None
    state: str | None = None
    relations: dict[str, Relation] = field(default_factory=dict)
    keywords: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    """Of one model: fields that may be seen, limits, and which companies' rows."""

    model: str
    allowed: tuple[str, ...] | None = None
    blocked: tuple[str, ...] = ()
    limit: int = MAX_LIMIT
    companies: tuple[int, ...] | None = None
    sequence: int = 10
    full_access: bool = False

    def fields(self, df: DataFrame, model: Model) -> list[str]:
        """Allowed less blocked less binary; the label always counts."""
        names = df.columns if self.allowed is None or self.full_access else [c for c in df.columns if c in self.allowed]
        seen = [c for c in names if c not in self.blocked and not isinstance(df.schema[c].dataType, BinaryType)]
        return seen if model.label in seen else [*seen, model.label]

    def scope(self, model: Model) -> Column | None:
        if self.companies is None or model.company is None:
            return None
        return F.col(model.company).isin(*self.companies)


def effective_policy(policies: list[Policy], model: str) -> Policy | None:
    """Full access first, then the earliest by sequence."""
    own = [p for p in policies if p.model == model]
    return min(own, key=lambda p: (not p.full_access, p.sequence), default=None)


class Registry:
    def __init__(self, models: list[Model], load: Callable[[str], DataFrame]):
        self.models = {m.name: m for m in models}
        self.load = load

    def frame(self, name: str) -> DataFrame:
        return self.load(self.models[name].table)

    def checksum(self) -> str:
        """Of all schemas and relations; the same while nothing changed."""
        spec = {n: (json.loads(self.frame(n).schema.json()), sorted(m.relations)) for n, m in sorted(self.models.items())}
        return hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()

    def catalog(self, spark: SparkSession) -> DataFrame:
        rows = [(m.name, m.table, role_of(m.name), len(self.frame(m.name).columns), len(m.relations)) for m in self.models.values()]
        return spark.createDataFrame(rows, "model string, table string, role string, n_fields int, n_relations int")

    def describe(self, spark: SparkSession, name: str, policy: Policy | None = None, most: int = 24) -> DataFrame:
        """field, type, relation, semantic, for the fields a policy shows."""
        m, df = self.models[name], self.frame(name)
        seen = (policy or Policy(name)).fields(df, m)[:most]
        means = {v: k for k, v in (("title", m.label), ("amount", m.amount), ("date", m.date), ("state", m.state), ("owner", m.company)) if v}
        to = {r.key: r.model for r in m.relations.values() if r.kind == "many2one"}
        return spark.createDataFrame([(i, c, df.schema[c].dataType.simpleString(), to.get(c), means.get(c)) for i, c in enumerate(seen)], "position int, field string, type string, relation string, semantic string")

    def counts(self, spark: SparkSession) -> DataFrame:
        rows = [(n, c, c in {r.key for r in m.relations.values()}) for n, m in self.models.items() for c in self.frame(n).columns]
        fields = spark.createDataFrame(rows, "model string, field string, is_relation boolean")
        return fields.groupBy("model").agg(F.count(F.lit(1)).alias("n_fields"), F.count_if("is_relation").alias("n_relations"))

    def snapshot(self, spark: SparkSession, version: int) -> DataFrame:
        """One row per field, as versions of a schema are kept."""
        checksum = self.checksum()
        rows = [(version, checksum, n, c.name, c.dataType.simpleString()) for n in self.models for c in self.frame(n).schema]
        return spark.createDataFrame(rows, "version int, checksum string, model string, field string, type string")


def role_of(name: str) -> str:
    return ROLES.get(name.split(".")[0], "other")


def groupable(df: DataFrame, c: str) -> bool:
    return c in df.columns and df.schema[c].dataType.simpleString() not in ("binary",) and not df.schema[c].dataType.simpleString().startswith(("array", "map", "struct"))


def aggregatable(df: DataFrame, c: str, op: str) -> bool:
    if op not in AGGREGATES or c not in df.columns:
        return False
    return op in ("count", "count_distinct", "min", "max") or isinstance(df.schema[c].dataType, NumericType)


AGGREGATES: dict[str, Callable[[str], Column]] = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct,
}


def state_groups(values: list[str]) -> dict[str, list[str]]:
    """State values as open, closed or inactive, by the words in them."""
    out: dict[str, list[str]] = {"open": [], "closed": [], "inactive": []}
    for v in values:
        low = v.lower()
        out["inactive" if any(t in low for t in INACTIVE_TERMS) else "closed" if any(t in low for t in CLOSED_TERMS) else "open"].append(v)
    return out


def auto_mapping(source: DataFrame, target: DataFrame) -> dict[str, str]:
    """Fields of one name whose types agree: equal, or a number into a wider one, or anything plain into text."""
    width = ["tinyint", "smallint", "int", "bigint", "float", "double"]

    def fits(a: str, b: str) -> bool:
        return a == b or b == "string" or (a in width and b in width and width.index(a) <= width.index(b))

    kinds = {f.name: f.dataType.simpleString() for f in target.schema}
    return {f.name: f.name for f in source.schema if f.name in kinds and fits(f.dataType.simpleString(), kinds[f.name])}


def detect_transform(field_type: str, relation: Relation | None, model: str) -> str:
    """How a synced field is carried over."""
    if relation is None:
        return "binary" if field_type == "binary" else "copy"
    if relation.kind != "many2one":
        return "x2many_map"
    return "m2o_self_hierarchy" if relation.model == model else "m2o_name"
