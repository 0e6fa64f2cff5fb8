"""Corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns documents; its output is written to the shared folder as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, mixing, near_dedup, quality, sharding
from millrace.llm.common import read, settle
from millrace.llm.queries import SHARD_BYTES


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the thresholds of their language and source.

    A null or blank text fails the base rules. Null languages and sources are groups like any other; each row is judged by itself, so repeated rows and
    keys share their verdict. A very long text is measured in pieces. An empty table stays empty; extra columns are kept."""
    # rows travel as one column, so that none of theirs meets a measure's name
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    measured = settle(quality.measure(docs.select(whole, "text", "lang", "source"), keep_text=False), "measured")
    return quality.judge(measured, quality.thresholds(quality.sketch(measured))).where("kept").select("row_.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies.

    Texts without words and null ids are in no group and stay; rows with one id are one document and stay or go together. Empty tables stay empty; extra columns are kept."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item.

    Texts without words hold none, nor do rows with a null id get judged: all these stay. Rows with one id go together. An empty table or benchmark removes nothing; extra columns are kept."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole documents and the parts that blocks cut, as often as they are taken.

    Texts without words are never taken. The null source is one of its own. Repeated ids of one size are taken as often as all of them together. An empty table gives an empty mix; extra columns are kept."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shards.

    A null text has 0 bytes. A row above the limit is a shard alone; repeated rows are numbered and spread. An empty table has no shards; extra columns are kept, but for those named as the new ones, which are replaced."""
    return sharding.shard(docs, SHARD_BYTES)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", minhash_near_dedup),
    ("decontamination", benchmark_decontamination),
    ("mixing", mix_to_targets),
    ("sharding", shards),
]

#: Mixing and sharding draw by hashes that SQL elsewhere doesn't have; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
