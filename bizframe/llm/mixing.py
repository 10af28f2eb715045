"""Mixing sources to target weights by Sainte-Lague apportionment, native Spark only.

1. Targets. Every source asks for its weight's part of the mix; a target stops at max_repeat times the source's size and
   the excess goes to the others by weight until none is above (closed form over the sources ordered by size per weight).
2. Quotas. The mix is a number of equal blocks of block_words words. Sources receive blocks by highest quotients
   target / (2k + 1); each source's blocks go to its shards the same way, votes being the shards' sizes. Only the
   quotients near the cut are listed: with n parties, n / 2 above and below the proportional share bound every quota.
3. Selection. A shard lays its documents end to end in seeded order and takes that many blocks, starting over when it
   reaches the end. A document may be cut where a block ends; none is taken more than max_repeat times.

A source has about sqrt(size / (16 * block_words)) shards, so both the shards of a source and the documents of a shard
stay small as the data grow, and a source that holds a third of all rows is spread over many tasks.

Defined cases: null text is of size 0 and never taken; a null source is a source of its own, ordered last; an empty
table gives an empty mix; equal seeds give equal mixes; repeated rows are documents of their own, ties in the seeded
order broken by id and size; ids are integers; a long text is cut where a block ends and never taken more often than
max_repeat; extra columns go along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, whole_text

BLOCK_WORDS = 32
#: Multiplier of the shard rule; ids are taken modulo 2**31 before, so products stay below 2**63.
SPREAD = 2654435761


def text_size(text_col: str = "text") -> Column:
    return F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")


def apportion(parties: DataFrame, within: list[str], party: list[str], votes: str, total: str, seats: str) -> DataFrame:
    """Sainte-Lague: adds the column quota. votes of a group sum to its total, and seats is equal within a group."""
    group = Window.partitionBy(*within)
    n = F.count(F.lit(1)).over(group)
    low = F.greatest(F.lit(0.0), F.floor(F.col(votes) * (F.col(seats) - n / 2) / F.col(total) + 0.5) - 1)
    high = F.floor(F.col(votes) * (F.col(seats) + n / 2) / F.col(total) + 0.5) + 1
    bounds = parties.where(F.col(votes) > 0).select(
        *within, *party, votes, seats, low.cast("long").alias("__low"), high.cast("long").alias("__high")
    )
    bounds = bounds.withColumn("__given", F.sum("__low").over(group))
    listed = bounds.withColumn("__k", F.explode(F.sequence(F.col("__low"), F.col("__high"))))
    quotient = F.col(votes) / (2 * F.col("__k") + 1)
    rank = F.row_number().over(group.orderBy(quotient.desc(), *[F.col(p).asc_nulls_last() for p in party]))
    won = listed.withColumn("__won", rank <= F.col(seats) - F.col("__given"))
    return won.groupBy(*within, *party).agg((F.first("__low") + F.count_if("__won")).alias("quota"))


def source_targets(sources: DataFrame, weights: list[float], share: float, max_repeat: int) -> DataFrame:
    """sources (source, source_size) with target and mix_size. Weights repeat over the sources by code point, null last."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * max_repeat
    picked = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("__w", F.get(picked, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    all_rows = Window.partitionBy(F.lit(0))
    s = s.withColumn("mix_size", F.sum("source_size").over(all_rows) * F.lit(share))
    by_room = Window.partitionBy(F.lit(0)).orderBy(cap / F.col("__w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("mix_size") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("__w").over(onward)
    s = s.withColumn("__level", level)
    #: The first source whose room is not exceeded sets the level of all after it.
    free = F.min(F.when(F.col("__level") * F.col("__w") <= cap, F.struct(cap / F.col("__w"), "__level"))).over(all_rows)
    s = s.withColumn("__free", free["__level"])
    target = F.least(cap.cast("double"), F.coalesce(F.col("__w") * F.col("__free"), cap.cast("double")))
    return s.select("source", "source_size", "mix_size", target.alias("target"))


def mix(
    df: DataFrame,
    weights: list[float],
    share: float,
    max_repeat: int = 2,
    seed: int = 0,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
) -> DataFrame:
    """df with __size, __source_size, __target and __taken, the words that the mix takes of each row."""
    size = text_size() if size is None else size
    named = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"),
        F.col(id_col).alias("__id"),
        F.col(source_col).alias("source"),
        size.alias("__size"),
    )
    sizes = materialize(named.select("__id", "source", "__size"), "sizes")
    sources = source_targets(sizes.groupBy("source").agg(F.sum("__size").alias("source_size")), weights, share, max_repeat)
    sources = sources.withColumn("__blocks", F.round(F.col("mix_size") / block_words).cast("long")).withColumn("__all", F.lit(0))
    blocks = apportion(sources, ["__all"], ["source"], "target", "mix_size", "__blocks")
    shards_of = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("source_size") / (16 * block_words)))).cast("long")
    plan = (
        sources.alias("s")
        .join(blocks.select(F.col("source").alias("__s"), "quota"), F.col("source").eqNullSafe(F.col("__s")), "left")
        .select("source", "source_size", "target", F.coalesce("quota", F.lit(0)).alias("__blocks"), shards_of.alias("__shards"))
    )
    plan = materialize(plan, "sources")

    mixed = ((F.pmod(F.coalesce(F.col("__id"), F.lit(0)), F.lit(2147483648)) + seed) * SPREAD) % 4294967296
    shard = F.floor(mixed / 65536).cast("long") % F.col("__shards")

    def placed(rows: DataFrame) -> DataFrame:
        there = plan.select(F.col("source").alias("__s"), "source_size", "target", "__blocks", "__shards")
        return rows.join(there, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("__shard", shard)

    shards = (
        placed(sizes)
        .groupBy("source", "__shard")
        .agg(F.sum("__size").alias("__votes"), F.first("source_size").alias("__total"), F.first("__blocks").alias("__seats"))
    )
    quotas = apportion(shards, ["source"], ["__shard"], "__votes", "__total", "__seats")
    quotas = materialize(quotas.select(F.col("source").alias("__qs"), F.col("__shard").alias("__q"), "quota"), "quotas")

    rows = placed(named).join(
        quotas, F.col("source").eqNullSafe(F.col("__qs")) & (F.col("__shard") == F.col("__q")), "left"
    )
    in_shard = Window.partitionBy("source", "__shard")
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit("null"))).cast("binary"))
    laid = in_shard.orderBy(seeded, "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.coalesce("quota", F.lit(0)) * block_words
    rows = rows.withColumn("__before", F.coalesce(F.sum("__size").over(laid), F.lit(0)))
    rows = rows.withColumn("__span", F.sum("__size").over(in_shard)).withColumn("__words", words)
    passes = F.when(F.col("__span") > 0, F.floor(F.col("__words") / F.col("__span"))).otherwise(0)
    rest = F.col("__words") - passes * F.col("__span")
    partial = F.least(F.col("__size"), F.greatest(F.lit(0), rest - F.col("__before")))
    taken = F.least(passes * F.col("__size") + partial, F.col("__size") * max_repeat).cast("long")
    return rows.select(
        "__row.*",
        "__size",
        F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"),
        taken.alias("__taken"),
    )


def mix_documents(df: DataFrame, **how) -> DataFrame:
    """The mix as rows: each row of df once for every whole time it is taken; a rest of half the row or more counts as one."""
    times = F.floor(F.col("__taken") / F.col("__size") + 0.5).cast("int")
    picked = mix(df, **how).where(F.col("__taken") > 0)
    copies = picked.withColumn("__copy", F.explode(F.sequence(F.lit(0), times))).where(F.col("__copy") < times)
    return copies.select(*[F.col(f"`{c}`") for c in df.columns])
