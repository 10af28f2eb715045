"""The corpus pipeline: documents in, encoded training documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.

Defined cases, for every stage: an empty table gives an empty one; a null text counts as empty where a stage reads it,
and language ID drops it, with empty texts and those without a letter; null sources and languages are values like others;
repeated rows are judged each for itself, and exact dedup leaves one of them; a text of any length is read whole; extra
columns of documents go along, and names that begin with two underscores are kept for the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizframe.llm import exact_dedup, langid, minhash, mixing
from bizframe.llm.common import materialize
from bizframe.llm.queries import MIX, bpe_digest

#: A document goes if its best language has less than this probability.
MIN_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a likely language."""
    net = langid.fit(docs, F.lit(True))
    said = langid.predict(docs, net, keep=docs.columns, lang_out="__lang", score_out="__score")
    return said.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= MIN_SCORE)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays; of rows that share it, one."""
    return exact_dedup.drop_duplicates(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the smallest doc_id stays; rows without an id stay."""
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents not taken go, documents taken twice stand twice."""
    return mixing.mix_documents(docs, **MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded."""
    return bpe_digest(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Language ID, near-dedup and encoding are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
