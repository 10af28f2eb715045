"""Exact deduplication by 128-bit content hash, native Spark only.

Two texts are equal when their bytes are. Rows meet by MD5 (128 bits); the classes are formed by grouping on the text
itself next to the hash, so bytes are compared inside every hash group, and copies collapse to one row per task before
they are shuffled (a text that a third of all rows share costs one row per task). Only classes of several rows are
joined back, by hashes: broadcast where a count shows them to be few, else by a shuffle whose hot keys Spark can split.

Defined cases: null text counts as empty; all empty texts form one class; a null id is kept only where its class has no
other id; rows repeated under one id are one document, and where it stays one of its rows does, any of them; an empty
table gives an empty table; texts of any length are hashed and compared whole; extra columns are carried untouched
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize_counted, small_or_shuffled, whole_text


def _keys(text_col: str) -> list:
    text = whole_text(text_col)
    return [F.md5(text.cast("binary")).alias("__md5"), F.sha2(text.cast("binary"), 256).alias("__sha")]


def content_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per distinct text: __md5, __sha, keep_id, group_size.

    keep: which id of a class stays, 'smallest' or 'largest'. Texts that share an MD5 but differ in bytes stay apart
    through their SHA-256; two different texts under both hashes would end the job rather than merge.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    texts = (
        df.select(F.col(id_col).alias("__id"), whole_text(text_col).alias("__text"), *_keys(text_col))
        .groupBy("__md5", "__sha", "__text")
        .agg(best("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
        .drop("__text")
    )
    classes = texts.groupBy("__md5", "__sha").agg(
        best("__keep").alias("keep_id"), F.sum("__n").alias("group_size"), F.count(F.lit(1)).alias("__texts")
    )
    one = F.when(F.col("__texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("different texts share both content hashes")).cast("long")
    )
    return classes.select("__md5", "__sha", "keep_id", one.alias("group_size"))


def mark_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256."""
    rows = df.select(F.col(id_col), *_keys(text_col))
    several = materialize_counted(content_classes(df, id_col, text_col, keep).where("group_size > 1"), "classes")
    marked = rows.join(small_or_shuffled(*several), ["__md5", "__sha"], "left")
    marked = marked.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")))
    return marked.select(
        id_col,
        "keep_id",
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """df without the rows whose text another row keeps; all columns of df, in order."""
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *_keys(text_col))
    several = materialize_counted(content_classes(df, id_col, text_col, keep).where("group_size > 1"), "classes")
    marked = keyed.join(small_or_shuffled(*several), ["__md5", "__sha"], "left")
    alone = marked.where("group_size is null")
    best = marked.where(F.col("group_size").isNotNull() & F.col("__row")[id_col].eqNullSafe(F.col("keep_id")))
    return alone.unionByName(best.dropDuplicates(["__md5", "__sha"])).select("__row.*")
