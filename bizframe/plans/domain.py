"""Predicates as prefix lists, such as ['|', ['state', '=', 'F'], ['amount', '>', 10]], made into Columns.

Leaves without a connective are joined by 'and'. A dotted field follows registered relations: a many2one adds its
column by a join, a one2many asks for any row there by a semi join. child_of and parent_of walk a
hierarchy. Leaves with an unknown field or operator are an error; `lenient` drops them and their connective.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hierarchy
from .registry import Registry

#: The operators of the tool interface and of the gateway, and the gateway's longest value list.
TOOL_OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "in", "not in", "ilike", "like", "not ilike", "not like", "=like", "=ilike", "child_of", "parent_of")
GATEWAY_OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "in", "not in", "ilike", "like", "not ilike", "not like")
GATEWAY_VALUES = 30


def compare(c: Column, op: str, value, strict_null: bool = False) -> Column:
    """One leaf. No value means null; '!=' and 'not in' hold for null unless strict_null."""
    absent = value is None or value is False
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    or_null = lambda x: x if strict_null else (c.isNull() | x)
    like = lambda f, v: f(c.cast("string"), v)
    part = f"%{value}%"
    return {
        "=": lambda: c.isNull() if absent else c == value,
        "!=": lambda: c.isNotNull() if absent else or_null(c != value),
        ">": lambda: c > value,
        ">=": lambda: c >= value,
        "<": lambda: c < value,
        "<=": lambda: c <= value,
        "in": lambda: c.isin(*values),
        "not in": lambda: or_null(~c.isin(*values)),
        "like": lambda: like(Column.like, part),
        "ilike": lambda: like(Column.ilike, part),
        "not like": lambda: or_null(~like(Column.like, part)),
        "not ilike": lambda: or_null(~like(Column.ilike, part)),
        "=like": lambda: like(Column.like, value),
        "=ilike": lambda: like(Column.ilike, value),
    }[op]()


def closure(df: DataFrame, id_col: str, parent_col: str, start: list | None = None, down: bool = False) -> DataFrame:
    """ancestor, id: every row (or those in start) with all rows above it, itself included; down: with all rows below."""
    return hierarchy.closure(df, id_col, parent_col, None if start is None else _ids(df, id_col, start), down)


def _ids(df: DataFrame, id_col: str, values: list) -> DataFrame:
    """The rows' ids that are among the values."""
    return df.where(F.col(id_col).isin(*values)).select(id_col)


def apply(registry: Registry, model: str, domain: list, operators: tuple[str, ...] = TOOL_OPERATORS, lenient: bool = False, strict_null: bool = False) -> DataFrame:
    """The model's rows that meet the domain, with the model's own columns."""
    df = registry.frame(model)
    own = df.columns
    flags = 0

    def leaf(field: str, op: str, value) -> Column | None:
        nonlocal df, flags
        if op not in operators:
            if lenient:
                return None
            raise ValueError(f"operator {op!r} is not allowed")
        if operators is GATEWAY_OPERATORS and isinstance(value, (list, tuple)):
            if len(value) > GATEWAY_VALUES:
                raise ValueError(f"a list of more than {GATEWAY_VALUES} values is not allowed")
        m = registry.models[model]
        if op in ("child_of", "parent_of"):
            target, key = (m, m.id) if field == m.id else (registry.models[m.relations[field].model], m.relations[field].key)
            values = list(value) if isinstance(value, (list, tuple)) else [value]
            rows = registry.frame(target.name)
            walk = hierarchy.nearest if op == "child_of" else hierarchy.ancestors
            return mark(walk(rows, target.id, target.parent, _ids(rows, target.id, values)).select(F.col("id").alias("__k")), F.col(key))
        first, _, rest = field.partition(".")
        if rest:
            r = m.relations[first]
            there = apply(registry, r.model, [[rest, op, value]], operators, lenient, strict_null)
            if r.kind == "many2one":
                return mark(there.select(F.col(registry.models[r.model].id).alias("__k")).distinct(), F.col(r.key))
            return mark(there.select(F.col(r.key).alias("__k")).distinct(), F.col(m.id))
        if field not in own:
            if lenient:
                return None
            raise ValueError(f"{model} has no field {field!r}")
        return compare(F.col(field), op, value, strict_null)

    def mark(ids: DataFrame, key: Column) -> Column:
        """A flag column: whether the key is among the (distinct) ids."""
        nonlocal df, flags
        flags += 1
        name = f"__in{flags}"
        df = df.join(ids.withColumnsRenamed({"__k": f"{name}k"}).withColumn(name, F.lit(True)), key == F.col(f"{name}k"), "left").drop(f"{name}k")
        return F.coalesce(F.col(name), F.lit(False))

    tokens = list(domain)

    def term() -> Column | None:
        t = tokens.pop(0)
        if t == "!":
            x = term()
            return None if x is None else ~x
        if t in ("&", "|"):
            a, b = term(), term()
            if a is None or b is None:
                return b if a is None else a
            return a & b if t == "&" else a | b
        return leaf(t[0], str(t[1]).strip().lower(), t[2])

    found = []
    while tokens:
        x = term()
        if x is not None:
            found.append(x)
    if found:
        df = df.where(reduce(lambda a, b: a & b, found))
    return df.select(*own)
