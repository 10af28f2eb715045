"""Lookups as joins: identity maps, cascades, first match, unique match, as-of rates, hierarchies.

No lookup side is broadcast by hint: Spark does so by measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contains import contains_join
from .numbering import get_or_create as get_or_create
from .sets import set_classes


def identity_lookup(df: DataFrame, identity: DataFrame, model: str, key: str, out: str = "target_id") -> DataFrame:
    """df with the target id of a source key, null where the map has none. One active row per key counts, the smallest id."""
    own = identity.where((F.col("source_model") == model) & F.col("active")).groupBy(F.col("source_record_id").alias("__k")).agg(F.min("target_record_id").alias(out))
    return df.join(own, F.col(key).cast("string") == F.col("__k"), "left").drop("__k")


def cascade(df: DataFrame, steps: list[tuple[DataFrame, str, str]], id_col: str, out: str = "match_id", fold: bool = True) -> DataFrame:
    """df with the id of the first step that has a match: steps are (candidates, their column, df's column), in order of
    preference; of several matches of a step the smallest id, `matched_by` the step's number from 1."""
    norm = (lambda c: F.lower(F.trim(c.cast("string")))) if fold else (lambda c: c.cast("string"))
    found = []
    for n, (candidates, theirs, ours) in enumerate(steps):
        side = candidates.where(F.col(theirs).isNotNull()).groupBy(norm(F.col(theirs)).alias(f"__k{n}")).agg(F.min(id_col).alias(f"__m{n}"))
        df = df.join(side, norm(F.col(ours)) == F.col(f"__k{n}"), "left").drop(f"__k{n}")
        found.append(F.col(f"__m{n}"))
    by = reduce(lambda w, n: w.when(found[n].isNotNull(), n + 1), range(1, len(found)), F.when(found[0].isNotNull(), 1))
    return df.withColumn(out, F.coalesce(*found)).withColumn("matched_by", by).drop(*[f"__m{n}" for n in range(len(found))])


def unique_match(df: DataFrame, candidates: DataFrame, ours: str, theirs: str, id_col: str, out: str = "match_id") -> DataFrame:
    """df with the only match's id; match_error says 'none' or 'several' else."""
    side = candidates.groupBy(F.col(theirs).alias("__k")).agg(F.min(id_col).alias("__id"), F.count(F.lit(1)).alias("__n"))
    joined = df.join(side, F.col(ours) == F.col("__k"), "left")
    return (
        joined.withColumn(out, F.when(F.col("__n") == 1, F.col("__id")))
        .withColumn("match_error", F.when(F.col("__n").isNull(), "none").when(F.col("__n") > 1, "several"))
        .drop("__k", "__id", "__n")
    )


def first_rule(df: DataFrame, rules: DataFrame, on: Column, key: str, out: dict[str, str], order: tuple[str, ...] = ("sequence", "rule_id")) -> DataFrame:
    """df with columns of the first rule that applies, by order; rules: active ones count, `out` names rule columns anew."""
    rank = F.min_by(F.struct(*out), F.struct(*order))
    matched = df.join(rules.where("active"), on).groupBy(key).agg(rank.alias("__first"))
    picked = matched.select(F.col(key).alias("__key"), *[F.col(f"__first.{c}").alias(name) for c, name in out.items()])
    return df.join(picked, F.col(key) == F.col("__key"), "left").drop("__key")


def first_scoped_rule(df: DataFrame, rules: DataFrame, ours: list[str], out: dict[str, str], scope: str = "scope", everyone: str = "all", order: tuple[str, ...] = ("sequence", "rule_id")) -> DataFrame:
    """df with columns of the first active rule by order among those whose scope is `everyone` or equals one of df's columns.

    Each scope's own first rule is found beforehand, so a row meets one rule a column by an equi-join, and none is multiplied."""
    best = F.min_by(F.struct(*out), F.struct(*order))
    firsts = rules.where("active").groupBy(F.col(scope).alias("__scope")).agg(F.min(F.struct(*order)).alias("__order"), best.alias("__rule"))
    found = []
    for n, c in enumerate([None, *ours]):
        key = F.lit(everyone) if c is None else F.col(c).cast("string")
        side = firsts.where(F.col("__scope") == everyone) if c is None else firsts
        side = side.select(F.col("__scope").alias(f"__s{n}"), F.struct("__order", "__rule").alias(f"__r{n}"))
        df = df.withColumn(f"__k{n}", key).join(side, F.col(f"__k{n}") == F.col(f"__s{n}"), "left").drop(f"__k{n}", f"__s{n}")
        found.append(f"__r{n}")
    first = F.array_min(F.array_compact(F.array(*[F.struct(F.col(f"{r}.__order").alias("o"), F.col(f"{r}.__rule").alias("r")) if len(found) == 1 else F.when(F.col(r).isNotNull(), F.struct(F.col(f"{r}.__order").alias("o"), F.col(f"{r}.__rule").alias("r"))) for r in found])))
    return df.withColumn("__first", first).withColumns({name: F.col(f"__first.r.{c}") for c, name in out.items()}).drop("__first", *found)


def resolve_many(df: DataFrame, id_col: str, keys: Column, targets: DataFrame, key_col: str, target_id: str) -> DataFrame:
    """Each row's list of keys as ids in order, and the keys without a target."""
    exploded = df.select(F.col(id_col), F.posexplode_outer(keys).alias("__pos", "__key"))
    joined = exploded.join(targets.select(F.col(key_col).alias("__k"), F.col(target_id).alias("__t")), F.col("__key") == F.col("__k"), "left")
    pairs = F.array_sort(F.collect_list(F.when(F.col("__t").isNotNull(), F.struct("__pos", "__t"))))
    lost = F.array_sort(F.collect_list(F.when(F.col("__t").isNull() & F.col("__key").isNotNull(), F.struct("__pos", "__key"))))
    return joined.groupBy(id_col).agg(F.transform(pairs, lambda x: x["__t"]).alias("ids"), F.transform(lost, lambda x: x["__key"]).alias("missing"))


def set_equality(a: DataFrame, b: DataFrame, a_id: str, b_id: str, members: list[str]) -> DataFrame:
    """Pairs (a_id, b_id) whose sets of members are the same, from classes of equal sets; sets.same_set() has one row an id."""
    side = lambda df, key, mark: df.select(F.struct(F.lit(mark).alias("side"), F.col(key).alias("key")).alias("__owner"), *members)
    classes = set_classes(side(a, a_id, 0).unionByName(side(b, b_id, 1)), "__owner", members)
    of = lambda mark, key: classes.where(F.col("__owner.side") == mark).select("class_id", F.col("__owner.key").alias(key))
    return of(0, a_id).join(of(1, b_id), "class_id").select(a_id, b_id)


def missing_keys(df: DataFrame, targets: DataFrame, key: str, target_key: str, policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """df with keys resolved or treated by policy, and the stubs to create: skip nulls the key, create lists stubs, stop fails when read."""
    lost = df.where(F.col(key).isNotNull()).join(targets.select(F.col(target_key).alias(key)), key, "left_anti")
    stubs = lost.select(F.col(key).alias(target_key)).distinct()
    known = targets.select(F.col(target_key).alias("__t")).distinct()
    joined = df.join(known, F.col(key) == F.col("__t"), "left")
    bad = F.col(key).isNotNull() & F.col("__t").isNull()
    value = {
        "skip": F.when(~bad, F.col(key)),
        "create": F.col(key),
        "stop": F.when(bad, F.raise_error(F.lit(f"unresolved {key}")).cast(df.schema[key].dataType)).otherwise(F.col(key)),
    }[policy]
    return joined.withColumn(key, value).drop("__t"), stubs if policy == "create" else stubs.limit(0)


def rate_intervals(rates: DataFrame) -> DataFrame:
    """from_ccy, to_ccy, rate, valid_from, valid_to: each rate until the next one of its pair."""
    following = F.lead("valid_from").over(Window.partitionBy("from_ccy", "to_ccy").orderBy("valid_from"))
    return rates.withColumn("valid_to", following)


#: Rates up to which they are broadcast, as counted.
FEW_RATES = 100_000


def as_of_convert(df: DataFrame, rates: DataFrame, amount: str, currency: str, to: str, on: str, out: str, digits: int = 2, few: int = FEW_RATES) -> DataFrame:
    """df with the amount in the target currency by the last rate on or before the date; null without one.

    A few currencies carry all rows, so they are no key to shuffle by: up to `few` rates are broadcast, and beyond that rows
    and rates meet by currency and month, a rate standing in every month of its interval."""
    r = rate_intervals(rates).where(F.col("to_ccy") == to).select("from_ccy", "rate", "valid_from", "valid_to")
    day = F.col(on).cast("date")
    hit = (F.col(currency) == F.col("from_ccy")) & (day >= F.col("valid_from")) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))
    if r.count() <= few:
        joined = df.join(F.broadcast(r), hit, "left")
    else:
        last = df.agg(F.max(day)).first()[0]
        month = lambda c: F.trunc(c, "MM")
        end = F.greatest(F.col("valid_from"), F.coalesce("valid_to", F.lit(last)))
        r = r.withColumn("__month", F.explode(F.sequence(month(F.col("valid_from")), month(end), F.expr("INTERVAL 1 MONTH"))))
        joined = df.withColumn("__of", month(day)).join(r, (F.col("__of") == F.col("__month")) & hit, "left").drop("__of", "__month")
    value = F.when(F.col(currency) == to, F.col(amount)).otherwise(F.round(F.col(amount) * F.col("rate"), digits))
    return joined.withColumn(out, value).drop("from_ccy", "rate", "valid_from", "valid_to")


#: Parts over which texts are dealt to meet phrases that all of them hold.
DEAL = 32


def contains_match(df: DataFrame, text: str, examples: DataFrame, needle: str) -> DataFrame:
    """Rows whose text holds an example's needle, beside the example, by an index of grams. An empty needle is in every text:
    those meet by a dealt number, not by their contents."""
    found = contains_join(df, text, examples, needle)
    dealt = df.where(F.col(text).isNotNull()).withColumn("__deal", F.pmod(F.xxhash64(text), F.lit(DEAL)))
    empty = examples.where(F.col(needle) == "").withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DEAL - 1).cast("bigint"))))
    return found.unionByName(dealt.join(empty, "__deal").drop("__deal"))


def pair_by_position(a: DataFrame, b: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The n-th row of either side per key as a_<order>, b_<order>; sides of different size are marked."""
    w = Window.partitionBy(*keys)
    number = lambda df, p: df.select(*keys, F.row_number().over(w.orderBy(order)).alias("n"), F.count(F.lit(1)).over(w).alias(f"{p}_n"), F.col(order).alias(f"{p}_{order}"))
    return number(a, "a").join(number(b, "b"), [*keys, "n"], "full_outer").withColumn("sizes_agree", F.coalesce(F.col("a_n") == F.col("b_n"), F.lit(False)))


def either_side(df: DataFrame, model: str, a: str = "source_model", b: str = "target_model") -> DataFrame:
    return df.where((F.col(a) == model) | (F.col(b) == model))


def remap_shares(df: DataFrame, id_col: str, shares: str, mapping: DataFrame) -> DataFrame:
    """A map of account shares with its keys rewritten (source_key -> target_key); shares that meet are added."""
    e = df.select(id_col, F.explode(shares).alias("k", "v"))
    m = e.join(mapping.select("source_key", "target_key"), F.col("k") == F.col("source_key"), "left")
    summed = m.groupBy(id_col, F.coalesce("target_key", "k").alias("k")).agg(F.sum("v").alias("v"))
    return summed.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(shares))
