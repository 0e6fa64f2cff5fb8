"""Quotas of pairs by kind, with validation sources that belong to one kind only and never meet training.

Kinds come in an order, and each has the sources of its pairs in a seeded order. Kind by kind, the first free sources become its validation sources: a matching in which
every source prefers the earlier kind. It is found in rounds over tables: each kind claims its first sources that it hasn't lost, a source claimed by several stays
with the earliest, and the others have lost it for good. After round k the first k kinds are settled, mostly it takes two or three rounds; nothing is decided on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import drawn
from millrace.operators.selection import ranked
from millrace.shared import discard, settle


def exclusive_sources(sources: DataFrame, quota: int, seed: int) -> DataFrame:
    """Rows (kind, source): for each kind (in the order of ``place``) its first ``quota`` sources by hash that no earlier kind has.

    ``sources`` has distinct rows (kind, place, source). A kind with too few free sources gets what there is."""
    lost = None
    while True:
        free = sources if lost is None else sources.join(lost, ["kind", "source"], "left_anti")
        # a hash of kind and source, so that kinds don't all want the same sources
        order = drawn(seed, F.concat_ws("|", F.col("kind"), F.col("source").cast("string")))
        claims = settle(ranked(free, "source", ["kind"], seed, order).where(F.col("_rank") <= quota).select("kind", "place", "source"), "claims")
        first = claims.groupBy("source").agg(F.min("place").alias("_first"))
        gone = claims.join(first, "source").where("place > _first").select("kind", "source")
        if gone.isEmpty():
            if lost is not None:
                discard(lost)
            return claims.select("kind", "source")
        before, lost = lost, settle(gone if lost is None else lost.union(gone), "lost-sources")
        discard(claims, *([before] if before is not None else []))


def quota_split(pairs: DataFrame, kinds: list[str], val: int, train: int, per_source: int, seed: int) -> DataFrame:
    """The chosen pairs (pair, source, kind) with their split.

    Each kind of ``kinds`` gets up to ``val`` validation pairs, one of each of its validation sources, then up to ``train`` training pairs, at most ``per_source`` of a source, in a seeded order of
    sources and pairs. No validation source of any kind is in training. Repeated rows are one; pairs of other kinds, and rows with a null, are left out."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    known = pairs.select("pair", "source", "kind").where(F.col("pair").isNotNull() & F.col("source").isNotNull() & F.col("kind").isin(*kinds)).distinct()
    by_source = Window.partitionBy("kind", "source").orderBy(drawn(seed, F.col("pair")), "pair")
    # of a source no more pairs than it may give are ever looked at
    few = settle(known.withColumn("_of_source", F.row_number().over(by_source)).where(F.col("_of_source") <= max(1, per_source)), "pairs-of-sources")
    held = settle(exclusive_sources(few.where("_of_source = 1").select("kind", place.alias("place"), "source"), val, seed), "val-sources")
    chosen = few.where("_of_source = 1").join(held, ["kind", "source"], "left_semi").select("pair", "source", "kind", F.lit("val").alias("split"))
    rest = few.where(F.col("_of_source") <= per_source).join(held.select("source").distinct(), "source", "left_anti")
    order = F.concat(drawn(seed, F.concat_ws("|", F.col("kind"), F.col("source").cast("string"))), F.lit("|"), drawn(seed, F.col("pair")))
    taken = ranked(rest, "pair", ["kind"], seed, order).where(F.col("_rank") <= train)
    return chosen.union(taken.select("pair", "source", "kind", F.lit("train")))


def quota_report(split: DataFrame, kinds: list[str], val: int, train: int) -> DataFrame:
    """A row (kind, split, wanted, got, short, n_leaks) for each kind and side; n_leaks counts sources of the side that are on the other side of any kind."""
    wanted = split.sparkSession.createDataFrame([(k, s, n) for k in kinds for s, n in (("val", val), ("train", train))], "kind string, split string, wanted long")
    sources = split.select("kind", "split", "source").distinct()
    other = split.select(F.when(F.col("split") == "val", "train").otherwise("val").alias("split"), "source").distinct()
    leaks = sources.join(other, ["split", "source"], "left_semi").groupBy("kind", "split").agg(F.count(F.lit(1)).alias("n_leaks"))
    got = split.groupBy("kind", "split").agg(F.count(F.lit(1)).alias("got"))
    all_ = wanted.join(got, ["kind", "split"], "left").join(leaks, ["kind", "split"], "left").na.fill(0, ["got", "n_leaks"])
    return all_.select("kind", "split", "wanted", "got", (F.col("wanted") - F.col("got")).alias("short"), "n_leaks")
