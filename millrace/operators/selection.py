"""Splits, quotas and samples in a reproducible order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import drawn


def top_by_rank(df: DataFrame, within: list[str], order: list[Column], k: Column | int, out: str = "rank") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return df.withColumn(out, rank.cast("long")).where(F.col(out) <= k)


def ranked(df: DataFrame, key: str, within: list[str], seed: int, order: Column | None = None) -> DataFrame:
    """``df`` with _rank (by a hash order of ``key``, or by ``order``, a text that starts with a hash) and _n (rows) within groups.

    A group is ranked by cells of its hash prefix, 4096 at most, whose counts are known beforehand; so even a group of all rows is spread over many tasks."""
    d = df.withColumn("_d", drawn(seed, F.col(key)) if order is None else order).withColumn("_cell", F.substring("_d", 1, 3))
    groups = [F.col(w) for w in within]
    cells = d.groupBy(*within, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*groups)
    cells = cells.withColumn("_before", F.sum("_c").over(whole.orderBy("_cell")) - F.col("_c")).withColumn("_n", F.sum("_c").over(whole))
    same = F.col("d._cell") == F.col("c._cell")
    for w in within:
        same = same & F.col(f"d.{w}").eqNullSafe(F.col(f"c.{w}"))
    j = d.alias("d").join(cells.alias("c"), same).select("d.*", "c._before", "c._n")
    place = F.row_number().over(Window.partitionBy(*groups, "_cell").orderBy("_d", key))
    return j.withColumn("_rank", F.col("_before") + place).select(*df.columns, "_rank", "_n")


def random_split(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """split: the first ``ratio`` of the rows, one at least, by a hash order are val."""
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))
    return ranked(df, key, [], seed).withColumn("split", F.when(F.col("_rank") <= k, "val").otherwise("train")).drop("_rank", "_n")


def stratified_split(df: DataFrame, key: str, stratum: str, ratio: float, seed: int) -> DataFrame:
    """split: of each stratum a share, rounded half to even and one at least, is val."""
    k = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(ratio)))
    return ranked(df, key, [stratum], seed).withColumn("split", F.when(F.col("_rank") <= k, "val").otherwise("train")).drop("_rank", "_n")


def quota_sample(df: DataFrame, key: str, stratum: str, least: int, cap: int, seed: int) -> DataFrame:
    """``least`` rows of each stratum, then others in one order up to ``cap`` in all."""
    d = ranked(df, key, [stratum], seed).withColumn("picked_as", F.when(F.col("_rank") <= least, "quota").otherwise("fill"))
    return d.orderBy((F.col("picked_as") == "quota").desc(), drawn(seed, F.col(key)), key).limit(cap).drop("_rank", "_n")


def group_split(df: DataFrame, group: str, parts: int, seed: int) -> DataFrame:
    """split by a hash of the group, so that no group is on both sides."""
    return df.withColumn("split", F.when(F.conv(F.substring(drawn(seed, F.col(group)), 1, 6), 16, 10).cast("long") % parts == 0, "val").otherwise("train"))


def overlap(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """One row: how many distinct keys are on both sides."""
    return left.select(*cols).intersect(right.select(*cols)).agg(F.count(F.lit(1)).alias("n_overlap"))


def duplicates(df: DataFrame, value: Column) -> DataFrame:
    """One row: rows, distinct values, and rows beyond the first of each value."""
    each = df.groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))
