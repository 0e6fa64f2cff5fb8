"""Exact quantiles of groups of any size, by counted cells.

For each wanted rank of a group a range that holds it is cut into equal cells; rows of a cell are counted by partial aggregation, and the cell that holds the rank, shrunk
to its least and greatest value, is the next range. A range of one value is the answer. So a group of all rows is never in one buffer or sort: what a task keeps are cells, and the
rounds are few (each narrows a range some four thousand times). Every round reads the values again; a caller whose values are costly settles them first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.shared import settle

CELLS = 4096


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys], F.lit(True))


def at_ranks(values: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """``wanted`` (by, _rank from 0) with _value: that of the row of this rank of its group among ``values`` (by, _value: finite doubles)."""
    ends = values.groupBy(*by).agg(F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    open_ = wanted.alias("w").join(ends.alias("e"), _same("w", "e", by)).select("w.*", "e._lo", "e._hi", F.lit(0).cast("long").alias("_before"))
    open_ = settle(open_, "ranks")
    found, ranges = None, [*by, "_lo", "_hi"]
    while True:
        done = open_.where("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_value"))
        found = done if found is None else found.union(done)
        rest = open_.where("_lo < _hi")
        if rest.isEmpty():
            return found
        of = rest.select(*ranges).distinct()
        # halves first, so that the width of a range is always finite; it may come out as nothing, then all but the least are one cell
        width = F.col("r._hi") / 2 - F.col("r._lo") / 2
        place = F.when(width > 0, F.try_divide(F.col("v._value") / 2 - F.col("r._lo") / 2, width)).otherwise((F.col("v._value") > F.col("r._lo")).cast("double"))
        hit = values.alias("v").join(of.alias("r"), _same("v", "r", by) & F.col("v._value").between(F.col("r._lo"), F.col("r._hi")))
        cells = hit.select(*[F.col(f"r.`{c}`") for c in ranges], F.col("v._value").alias("_v"), F.least(F.floor(place * CELLS), F.lit(CELLS - 1)).alias("_cell")).groupBy(*ranges, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.sum("_n").over(Window.partitionBy(*ranges).orderBy("_cell"))
        cells = cells.withColumn("_upto", upto)
        j = rest.alias("t").join(cells.alias("c"), _same("t", "c", ranges) & (F.col("t._rank") - F.col("t._before") < F.col("c._upto")) & (F.col("t._rank") - F.col("t._before") >= F.col("c._upto") - F.col("c._n")))
        open_ = settle(j.select(*[F.col(f"t.`{k}`") for k in by], "t._rank", F.col("c._least").alias("_lo"), F.col("c._most").alias("_hi"), (F.col("t._before") + F.col("c._upto") - F.col("c._n")).alias("_before")), "ranks")


def quantiles(df: DataFrame, by: list[str], value: Column, shares: dict[str, float], nearest: bool = False) -> DataFrame:
    """A row for each group with _n (rows that have a value) and a column for each of ``shares``.

    Quantiles are interpolated between the two rows around share * (n - 1), or with ``nearest`` are the value of rank ceil(share * n). Null and non-finite values are left out; a group without any other has no row."""
    values = df.select(*by, value.cast("double").alias("_value")).where(F.abs("_value") < F.lit(float("inf")))
    counts = settle(values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "group-counts")
    ranks = {}
    for name, p in shares.items():
        at = F.greatest(F.ceil(F.col("_n") * F.lit(p)) - 1, F.lit(0)).cast("double") if nearest else (F.col("_n") - 1) * F.lit(p)
        ranks[name] = (F.floor(at), F.ceil(at), at - F.floor(at))
    every = F.array_distinct(F.array(*[r.cast("long") for low, high, _ in ranks.values() for r in (low, high)]))
    got = at_ranks(values, by, counts.select(*by, F.explode(every).alias("_rank"))).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    j = counts.alias("n").join(got.alias("g"), _same("n", "g", by)).select("n.*", "g._at")
    at = lambda rank: F.col("_at")[rank.cast("long")]
    return j.select(*by, "_n", *[(at(low) + (at(high) - at(low)) * part).alias(name) for name, (low, high, part) in ranks.items()])
