"""Sharding by extendible hashing.

A shard is a prefix of the bits of a row's hash. The directory starts with the empty prefix; only a shard over its byte limit is split
on the next bit, until every shard fits. Splitting needs no rows, only bytes by prefix: cells of a fixed number of bits give the
upper levels, and the few cells that are still too large are opened further, a step of bits at a time.

A shard with a single row isn't split: a row larger than the limit ends alone in a shard that is marked as oversized. Rows equal in all that is
hashed are numbered, and the number is hashed too, so they spread like any others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import settle

#: Bits of a hash; bits that a too large cell is opened by at a time; copies of a row numbered by one task.
BITS, STEP, CHUNK = 60, 12, 1000


def row_hash(docs: DataFrame) -> Column:
    """MD5 over all columns, each as ``n`` for null or else ``v``, its length, a colon and its text."""
    one = lambda c: F.when(F.col(f"`{c}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(F.col(f"`{c}`").cast("string")), F.lit(":"), F.col(f"`{c}`").cast("string")))
    return F.md5(F.concat(*map(one, docs.columns)))


def _prefix(bits: int, depth: Column) -> Column:
    """The first ``depth`` bits of a code of ``bits`` bits, as a number."""
    return F.call_function("shiftright", F.col("code"), (F.lit(bits) - depth).cast("int"))


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """The leaf of each of the ``cells`` (code of ``high`` bits, bytes, n): depth, bytes and n; null where even the cell is too large.

    A cell counts towards its prefixes of low to high bits; the shortest prefix that fits is its leaf. The rows of the
    join are cells times levels, so they grow with the number of shards, not of documents."""
    up = cells.select("code", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("prefix", _prefix(high, F.col("depth")))
    fits = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).where((F.col("bytes") <= limit) | (F.col("n") == 1))
    leaf = up.select("code", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("code").agg(F.min(F.struct("depth", "bytes", "n")).alias("leaf"))
    if high == BITS:  # equal hashes: nothing is left to split by
        own = F.struct(F.lit(BITS).alias("depth"), "bytes", "n")
        return cells.join(leaf, "code", "left").select("code", F.coalesce("leaf", own).alias("leaf"))
    return cells.select("code").join(leaf, "code", "left")


def assign(docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: all its columns' hash, copy (from 1, among equal rows), n_bytes, shard, depth, shard_bytes and oversized.

    A shard is named by its bits; the name is empty where all rows fit one. Its bytes are at most ``limit``, but for a row that is
    larger by itself (oversized). Null texts have 0 bytes. An empty table has no shards."""
    spark = docs.sparkSession
    slim = docs.select(row_hash(docs).alias("hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    slim = slim.groupBy("hash", "n_bytes").agg(F.count(F.lit(1)).alias("n"))
    chunks = slim.select("hash", "n_bytes", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {CHUNK}"))).alias("chunk"))
    first = F.col("chunk") * CHUNK + 1
    rows = chunks.select("hash", "n_bytes", F.explode(F.sequence(first, F.least(first + CHUNK - 1, F.col("n")))).alias("copy"))
    rows = settle(rows.withColumn("code", F.conv(F.substring(F.md5(F.concat("hash", F.lit(":"), "copy")), 1, 15), 16, 10).cast("long")), "shard-rows")

    total = rows.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + 6)
    still, out, leaf = rows.select("code", F.col("n_bytes").alias("bytes")), rows, F.lit(None)
    while True:
        cells = still.groupBy(_prefix(BITS, F.lit(high)).alias("code")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        found = settle(_leaves(cells, low, high, limit), "shard-directory")
        out = out.withColumn("_cell", _prefix(BITS, F.lit(high))).join(found.select(F.col("code").alias("_cell"), F.col("leaf").alias(f"_leaf{high}")), "_cell", "left").drop("_cell")
        leaf = F.coalesce(*([leaf] if low else []), F.col(f"_leaf{high}"))
        full = found.where("leaf is null").select("code")
        if high == BITS or full.isEmpty():
            break
        still = still.join(full.select(F.col("code").alias("_full")), _prefix(BITS, F.lit(high)) == F.col("_full"), "left_semi")
        low, high = high + 1, min(BITS, high + STEP)
    depth = F.col("leaf.depth")
    name = F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(_prefix(BITS, depth)), depth, F.lit("0")))
    return out.withColumn("leaf", leaf).select("hash", "copy", "n_bytes", name.alias("shard"), depth.cast("int").alias("depth"), F.col("leaf.bytes").alias("shard_bytes"), (F.col("leaf.bytes") > limit).alias("oversized"))


def shard(docs: DataFrame, limit: int, text: str = "text") -> DataFrame:
    """``docs`` with copy, n_bytes, shard, depth, shard_bytes and oversized; columns of these names are replaced.

    Texts are moved once, by the hash of their row; equal rows travel as one with their number."""
    placed = assign(docs, limit, text)
    own = [c for c in docs.columns if c not in ("copy", "n_bytes", "shard", "depth", "shard_bytes", "oversized")]
    one = docs.select(row_hash(docs).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")).groupBy("hash").agg(F.first("_row").alias("_row"))
    return one.join(placed, "hash").select("_row.*", "copy", "n_bytes", "shard", "depth", "shard_bytes", "oversized")
