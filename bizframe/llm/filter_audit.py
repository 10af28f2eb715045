"""Filter interaction audit: what each filter of a cleaning chain removes, under every order of the filters.

Every document becomes a mask with a bit for each filter it fails. Masks meet in cells (part, mask) with counts, which are
few whatever the corpus is. The cells are unpivoted against the steps of every order; a running bit-or over the steps tells
which filters came before, conditional sums over the cells give the metrics of a step, and a window over a part's rows of a
filter gives its total over all orders.

Copies fail too: of equal texts in the whole table all rows but those of the smallest id. Texts meet by SHA-256, and copies
collapse to one narrow row per task, part and pair of labels before they are shuffled, so a group of copies of any size
costs a few rows. Only ids, hashes and masks are shuffled, never texts.

Defined cases: a null text counts as empty; a null id never fails as a copy and makes no other row fail; rows repeated
under one id are judged each for itself and are no copies of each other; a null part is ''; documents without labels
count as neither good nor toxic, and with several label rows the flag holds if one row has it; an empty table gives an
empty table; a text of any length is read whole, its words as one array; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

#: The filter that fails copies; the others are conditions on a row.
COPIES = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions: too short, repetitive, shouting, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_cells(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column], part: Column, flags: dict[str, Column], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(part, mask, the flags, n): how many documents share a mask. flags are conditions on labels; bit k of mask is the
    k-th filter, and the last one, after those given, is that of the copies."""
    copy_bit = 1 << len(filters)
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filters.values())), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("__id"),
        # rows without an id find no label; they are dealt by text so that they don't meet in one task
        F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0)).alias("__deal"),
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole_text(text_col), 256)).alias("__text"),
        mask.alias("mask"),
    )
    known = (
        labels.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"), F.lit(0).cast("bigint").alias("__deal"))
        .agg(*[F.max(F.coalesce(on, F.lit(False))).alias(name) for name, on in flags.items()])
    )
    yes = [F.coalesce(F.col(name), F.lit(False)).alias(name) for name in flags]
    joined = rows.join(known, ["__id", "__deal"], "left").select("__id", "__deal", "part", "__text", "mask", *yes)
    ids = joined.groupBy("__id", "__deal", "part", "__text", "mask", *flags).agg(F.count(F.lit(1)).alias("__n"))
    first = F.struct("__id", "__n")
    same = ids.groupBy("__text", "part", "mask", *flags).agg(
        F.sum("__n").alias("__n"),
        F.coalesce(F.sum(F.when(F.col("__id").isNotNull(), F.col("__n"))), F.lit(0)).alias("__named"),
        F.min(F.when(F.col("__id").isNotNull(), first)).alias("__first"),
    )
    least = F.min("__first.__id").over(Window.partitionBy("__text"))
    stays = F.when(F.col("__first.__id") == F.col("__least"), F.col("__first.__n")).otherwise(F.lit(0))
    failing = same.withColumn("__least", least).withColumn("__copies", F.when(F.col("__named") > 0, F.col("__named") - stays).otherwise(F.lit(0)))
    two = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("__n") - F.col("__copies")).alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(copy_bit)).alias("mask"), F.col("__copies").alias("n")),
    )
    return failing.select("part", *flags, F.inline(two)).where("n > 0").groupBy("part", "mask", *flags).agg(F.sum("n").alias("n"))


def audit(cells: DataFrame, filters: str, flags: Sequence[str], orders: Sequence[str] | None = None) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, <flag>_lost of each flag, shapley.

    filters: a letter for each bit of the mask. orders: strings of these letters, by default all permutations."""
    orders = ["".join(p) for p in permutations(filters)] if orders is None else list(orders)
    lost = [F.sum(F.when(F.col(f), F.col("n")).otherwise(F.lit(0))).alias(f"{f}_n") for f in flags]
    few = cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), *lost)
    long = few.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders]))).select(
        "*", F.posexplode(F.split("filter_order", "(?<=.)(?=.)")).alias("__at", "__filter")
    )
    bits = F.array(*[F.lit(1 << k) for k in range(len(filters))])
    long = long.withColumn("__bit", F.element_at(bits, F.instr(F.lit(filters), F.col("__filter"))))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("mask").bitwiseAND(F.col("__bit"))
    long = long.withColumn("__own", own).withColumn("__earlier", F.coalesce(F.bit_or("__own").over(before), F.lit(0)))
    fails, gone = F.col("__own") != 0, F.col("__earlier") != 0
    total = lambda on, c="n": F.sum(F.when(on, F.col(c)).otherwise(F.lit(0)))
    steps = long.groupBy("part", "filter_order", (F.col("__at") + 1).cast("int").alias("step"), "__filter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("__bit")).alias("unique_fails"),
        *[total(fails & ~gone, f"{f}_n").alias(f"{f}_lost") for f in flags],
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "__filter"))).drop("__filter")
