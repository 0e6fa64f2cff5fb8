"""Picks that cover labels first, within the caps of their buckets, and repairs of what stays uncovered.

The walk is sequential: bucket by bucket, label by label, the first item in order that has the label and isn't taken; then the first others. Labels that no bucket covers are then
brought in, at the cost of an item that isn't the only one to cover a label. What it can ever look at is little: as many first items of a label, of a bucket's label and
of a bucket as all caps allow. These are found by ranking with limits in every task; the walk itself takes a table bounded by caps and labels, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An item of the walk: its place, bucket and labels.
Item = tuple[int, str, frozenset]


def walk(items: list[Item], caps: dict[str, int], preferred: dict[str, list[str]], required: list[str]) -> tuple[dict[str, list[int]], dict[str, str | None]]:
    """Places picked for each bucket, and for each required label whether it was ``picked``, came in by ``repair`` or is ``missing``. ``items`` are in order."""
    picks: dict[str, list[Item]] = {b: [] for b in caps}
    taken: set[int] = set()

    def take(bucket: str, item: Item) -> None:
        picks[bucket].append(item)
        taken.add(item[0])

    for bucket, cap in caps.items():
        own = [i for i in items if i[1] == bucket]
        for label in preferred.get(bucket, []):
            if len(picks[bucket]) < cap and (found := next((i for i in own if i[0] not in taken and label in i[2]), None)):
                take(bucket, found)
        for item in own:
            if len(picks[bucket]) < cap and item[0] not in taken:
                take(bucket, item)
    how: dict[str, str | None] = {}
    for label in required:
        chosen = [i for of in picks.values() for i in of]
        if any(label in i[2] for i in chosen):
            how.setdefault(label, "picked")
            continue
        found = next((i for i in items if i[0] not in taken and label in i[2] and caps.get(i[1], 0) > 0), None)
        how[label] = "repair" if found else "missing"
        if not found:
            continue
        of = picks[found[1]]
        if len(of) < caps[found[1]]:
            take(found[1], found)
            continue
        spare = next((k for k in range(len(of) - 1, -1, -1) if all(any(x in o[2] for o in chosen if o[0] != of[k][0]) for x in required if x in of[k][2])), len(of) - 1)
        taken.discard(of[spare][0])
        of[spare] = found
        taken.add(found[0])
    return {b: [i[0] for i in of] for b, of in picks.items()}, how


def coverage_pick(items: DataFrame, labels: DataFrame, key: str, bucket: str, caps: dict[str, int], preferred: dict[str, list[str]], required: list[str]) -> DataFrame:
    """The picked items (key, bucket, place): up to ``caps`` of each bucket, ``place`` from 1 within it.

    ``items`` has a row for each key, ordered by it; ``labels`` rows (key, label), repeated ones harmless. For each preferred label of a bucket its first free item is picked, then the bucket is filled with its first others. A
    required label that nothing covers replaces the last item that isn't the only one of a required label, or else the last. Buckets without a cap and rows with a null are left out; so are labels that no list names."""
    named = sorted({*required, *(x for of in preferred.values() for x in of)})
    most = sum(caps.values()) + 1
    rows = items.select(F.col(key).alias("key"), F.col(bucket).alias("bucket")).where(F.col("key").isNotNull() & F.col("bucket").isin(*caps)).distinct()
    known = labels.select(F.col(key).alias("key"), F.col("label")).where(F.col("key").isNotNull() & F.col("label").isin(*named)).distinct()
    tagged = rows.join(known, "key")

    def first(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("_r") <= most).select("key", "bucket")

    # the walk passes over no more than it takes, so it never looks beyond these
    seen = first(rows, "bucket").union(first(tagged, "bucket", "label")).union(first(tagged, "label")).distinct()
    # one task takes these rows only: coalescing would draw the labels of all items into it
    seen = seen.join(known.groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("labels")), "key", "left").repartition(1).sortWithinPartitions("key")
    schema = T.StructType([T.StructField(key, items.schema[key].dataType), T.StructField(bucket, T.StringType()), T.StructField("place", T.IntegerType())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        all_ = pa.Table.from_batches(parts)
        keys = all_.column("key").combine_chunks()
        of = list(zip(range(len(keys)), all_.column("bucket").to_pylist(), (frozenset(x or ()) for x in all_.column("labels").to_pylist()), strict=True))
        picks, _ = walk(of, caps, preferred, required)
        at = [(i, b, n) for b, places in picks.items() for n, i in enumerate(places, 1)]
        yield pa.record_batch([keys.take(pa.array([i for i, *_ in at], pa.int64())), pa.array([b for _, b, _ in at], pa.string()), pa.array([n for *_, n in at], pa.int32())], [key, bucket, "place"])

    return seen.mapInArrow(pick, schema)


def coverage_report(picked: DataFrame, labels: DataFrame, key: str, required: list[str]) -> DataFrame:
    """A row (label, n_available, n_picked) for each required label."""
    wanted = picked.sparkSession.createDataFrame([(x,) for x in required], "label string")
    known = labels.select(key, "label").distinct()
    count = lambda df, name: df.groupBy("label").agg(F.count(F.lit(1)).alias(name))
    out = wanted.join(count(known, "n_available"), "label", "left").join(count(known.join(picked.select(key), key, "left_semi"), "n_picked"), "label", "left")
    return out.na.fill(0, ["n_available", "n_picked"])
