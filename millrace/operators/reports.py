"""Scorecards, latency statistics, slices, comparisons of runs and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.quantiles import quantiles


def rate(cond: Column) -> Column:
    """Share of rows for which ``cond`` holds, of all rows, to four digits."""
    return F.round(F.sum(F.when(cond, 1.0).otherwise(0.0)) / F.count(F.lit(1)), 4)


def scorecard(cases: DataFrame, by: list[str]) -> DataFrame:
    """Rates of protocol, task and effective passes and critical errors of ``cases`` (protocol, task, critical)."""
    effective = F.col("protocol") & (F.col("task") >= 0.95) & ~F.col("critical")
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rate(F.col("protocol")).alias("protocol_rate"), F.round(F.avg("task"), 4).alias("task_mean"),
        rate(F.col("critical")).alias("critical_rate"), rate(effective).alias("effective_rate"),
    )


def latency(events: DataFrame, by: list[str]) -> DataFrame:
    """Counts, and mean, median and 95th percentile (interpolated) over positive values of successful events; null where a group has none."""
    good = F.when((F.col("event_type") != "error") & (F.col("value") > 0), F.col("value"))
    counts = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_failed"), F.round(F.avg(good), 4).alias("mean"))
    found = quantiles(events, by, good, {"p50": 0.5, "p95": 0.95}).alias("q")
    same = reduce(lambda x, y: x & y, [F.col(f"c.`{k}`").eqNullSafe(F.col(f"q.`{k}`")) for k in by], F.lit(True))
    return counts.alias("c").join(found, same, "left").select("c.*", F.round("q.p50", 4).alias("p50"), F.round("q.p95", 4).alias("p95"))


def nearest_rank(events: DataFrame, by: list[str], p: float) -> DataFrame:
    """The value of rank ceil(p n) of each group."""
    return quantiles(events.where("event_type <> 'error'"), by, F.col("value"), {"p95": p}, nearest=True).withColumnRenamed("_n", "n").select(*by, "p95", "n")


def throughput(tokens: Column, latency_ms: Column, first_ms: Column, native: Column) -> tuple[Column, Column]:
    """Tokens a second and where the figure comes from: the server's own if positive, else from the clock."""
    clock = (latency_ms > first_ms) & (tokens > 1)
    rate_ = F.when(native > 0, native).when(clock, (tokens - 1) / ((latency_ms - first_ms) / 1000))
    return F.round(rate_, 4), F.when(native > 0, "server").when(clock, "clock")


def deltas(cells: DataFrame, key: str, pairs: DataFrame, metrics: list[str]) -> DataFrame:
    """Differences child - parent of ``metrics`` for each pair (parent, child), to four digits; null where a side is missing."""
    a, b = cells.alias("a"), cells.alias("b")
    j = pairs.join(a, F.col("parent") == F.col(f"a.{key}"), "left").join(b, F.col("child") == F.col(f"b.{key}"), "left")
    return j.select("parent", "child", *[F.round(F.col(f"b.{m}") - F.col(f"a.{m}"), 4).alias(f"d_{m}") for m in metrics])


def case_diff(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """improved, regressed, unchanged and net for each pair (parent, child) of runs over ``cases`` (run, case_id, passed)."""
    a, b = cases.alias("a"), cases.alias("b")
    j = pairs.join(a, F.col("parent") == F.col("a.run")).join(b, (F.col("child") == F.col("b.run")) & (F.col("a.case_id") == F.col("b.case_id")))
    up, down = F.count_if(~F.col("a.passed") & F.col("b.passed")), F.count_if(F.col("a.passed") & ~F.col("b.passed"))
    return j.groupBy("parent", "child").agg(up.alias("improved"), down.alias("regressed"), (F.count(F.lit(1)) - up - down).alias("unchanged"), (up - down).alias("net"))


def best(cells: DataFrame, order: list[Column]) -> DataFrame:
    return cells.orderBy(*order).limit(1)
