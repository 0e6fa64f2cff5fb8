"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of a source form a stream, in an order given by a seeded hash, that is dealt to shards and cut into blocks of nearly
equal size. Blocks are apportioned to sources, and the blocks of each source to its shards, by highest
quotients weight / (2 k - 1). A shard takes whole rounds of its blocks, then as many of the remaining quota as follow a
seeded block, around the end of the stream. Being a run in a stream that is already in random
order, those blocks cut two documents of a shard at most.

Only DataFrame expressions. Rows are moved once, without texts (a key, the size and the source); everything else has a row
for each source or shard. A hot source is spread over many shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import settle, word_count, words

#: Words of a block and words of a shard at least. A source of n words has no more than sqrt(n) shards, so neither a shard nor a source's list of shards gets too long for a task.
BLOCK, SHARD = 64, 131_072


def apportion(parties: DataFrame, within: list[str], weight: str, seats: str, order: list[str], out: str = "quota") -> DataFrame:
    """Adds to each row of ``parties`` its integer share of ``seats`` by highest quotients weight / (2 k - 1).

    ``seats`` is the same in all rows of a group (``within``); ties go by ``order``; a weight of zero gets none. Rounding at a divisor that
    is a little too large gives each party seats that it has for certain, and a little too small one more than it can get;
    only the quotients in between, about as many as there are parties, are ranked."""
    group = Window.partitionBy(*within)
    p = parties.withColumns({"_all": F.sum(F.col(weight).cast("double")).over(group), "_n": F.count(F.lit(1)).over(group)})
    # the sum of rounded shares is off by half a seat for each party at most
    share = lambda extra: F.when(F.col("_all") > 0, F.col(weight) * F.greatest(F.col(seats) + extra * (F.col("_n") / 2 + 1), F.lit(0)) / F.col("_all")).otherwise(0.0)
    p = p.withColumns({"_low": F.floor(share(F.lit(-1)) + 0.5).cast("long"), "_high": F.ceil(share(F.lit(1)) + 0.5).cast("long")})
    p = p.withColumns({"_low": F.greatest(F.col("_low") - 1, F.lit(0)), "_high": F.when(F.col(weight) > 0, F.col("_high") + 1).otherwise(0)})
    p = p.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    keys = [*within, *order]
    open_ = p.where("_high > _low").select(*keys, "_left", F.col(weight).alias("_w"), F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy((F.col("_w") / (2 * F.col("_k") - 1)).desc(), *order, "_k"))
    won = open_.withColumn("_rank", rank).where("_rank <= _left").groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = p.alias("p").join(won.alias("w"), cond, "left")
    return joined.select(*[F.col(f"p.{c}").alias(c) for c in parties.columns], (F.col("p._low") + F.coalesce(F.col("w._won"), F.lit(0))).alias(out))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with the target of each source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all words; a target stops at ``most`` times its
    source's size and what is over goes to the others by weight, until none is above. In the order of
    limit / weight those that stop come first, so running sums give the level of the others."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    line = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    s = s.withColumn("level", (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("stops", F.col("limit") <= F.col("level") * F.col("weight"))
    # past the first that doesn't stop the levels only fall
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(Window.partitionBy())
    return s.select("source", "source_size", F.when(F.col("stops"), F.col("limit")).otherwise(level * F.col("weight")).alias("target"))


def plan_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """One row for each row of ``docs``: key, source, size, source_size, target, rounds, start, end, cuts and taken.

    The row's words are taken ``rounds`` times whole, and once more in each span of ``cuts`` (from, to; counted from 0 within the row).
    taken is the sum and never above 2 x size. Null sources are a source of their own, after all others.
    Rows without words take nothing; equal keys and repeated rows are separate rows of the stream, ordered by key and
    size, so that reruns agree. An empty table, or one without words, gives rows with target and taken 0. Other columns are ignored."""
    size = word_count(F.col("text")) if size is None else size
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    rows = settle(rows.withColumn("draw", F.xxhash64(F.lit(seed), F.col("key"), F.col("size"))), "sizes")  # texts are read once
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    blocks = F.greatest(F.lit(1), F.round(F.sum("source_size").over(Window.partitionBy()) * F.lit(float(min(share, most))) / BLOCK)).cast("long")
    aims = aims.withColumn("seats", blocks).withColumn("_one", F.lit(0))
    aims = apportion(aims, ["_one"], "target", "seats", ["source"], "source_quota").drop("_one", "seats")
    aims = aims.withColumn("n_shards", F.ceil(F.least(F.greatest(F.col("source_size"), F.lit(1)) / SHARD, F.sqrt(F.greatest(F.col("source_size"), F.lit(1))))).cast("int"))

    r = rows.alias("r").join(aims.alias("a"), F.col("r.source").eqNullSafe(F.col("a.source"))).select("r.key", "r.source", "r.size", "r.draw", "a.source_size", "a.target", "a.source_quota", F.pmod("r.draw", "a.n_shards").alias("shard"))
    stream = Window.partitionBy("source", "shard").orderBy(F.xxhash64("draw"), "key", "size")
    r = r.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))

    shards = rows.alias("r").join(aims.alias("a"), F.col("r.source").eqNullSafe(F.col("a.source"))).select("a.source", "a.source_quota", F.pmod("r.draw", "a.n_shards").alias("shard"), "r.size")
    shards = shards.groupBy("source", "source_quota", "shard").agg(F.sum("size").alias("words"))
    shards = apportion(shards, ["source"], "words", "source_quota", ["shard"])
    n = F.greatest(F.lit(1), F.round(F.col("words") / BLOCK)).cast("long")
    shards = shards.withColumn("n", n).withColumn("quota", F.least("quota", 2 * F.col("n")))
    shards = shards.withColumns({"rounds": F.floor(F.col("quota") / F.col("n")), "rest": F.col("quota") % F.col("n"), "first": F.pmod(F.xxhash64(F.lit(seed), F.lit("first"), "source", "shard"), F.col("n"))})
    edge = lambda k: F.floor(k * F.col("words") / F.col("n")).cast("long")  # noqa: E731  where block k begins
    last = F.col("first") + F.col("rest")
    shards = shards.select(
        "source", "shard", "rounds",
        edge(F.col("first")).alias("from1"), edge(F.least(last, F.col("n"))).alias("to1"),
        F.lit(0).cast("long").alias("from2"), edge(F.greatest(last - F.col("n"), F.lit(0))).alias("to2"),
    )
    j = r.alias("r").join(shards.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.shard") == F.col("s.shard")))
    begin = F.col("r.end") - F.col("r.size")
    cut = lambda k: F.struct((F.greatest(f"s.from{k}", begin) - begin).alias("from"), (F.least(f"s.to{k}", "r.end") - begin).alias("to"))
    cuts = F.filter(F.array(cut(2), cut(1)), lambda c: c["to"] > c["from"])
    j = j.select("r.key", "r.source", "r.size", "r.source_size", "r.target", "s.rounds", cuts.alias("cuts"))
    taken = F.col("rounds") * F.col("size") + F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + c["to"] - c["from"])
    return j.withColumn("taken", taken).withColumnsRenamed({"key": key, "source": source})


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **kind) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a row for each whole round and each cut of a document.

    A cut of less than the document keeps its words with single spaces between them. ``key`` must tell
    rows apart; rows that share one are taken as often as any of them is."""
    plan = plan_mix(docs, key, source, word_count(F.col(text)), **kind).where("taken > 0")
    whole = F.struct(F.lit(0).cast("long").alias("from"), F.col("size").alias("to"))
    pieces = plan.select(F.col(key).alias("of"), "size", F.explode(F.concat(F.array_repeat(whole, F.col("rounds").cast("int")), "cuts")).alias("cut"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("of"), F.col(f"`{text}`").alias("text"), word_count(F.col(f"`{text}`")).alias("size"))
    j = row.alias("d").join(pieces.alias("p"), F.col("d.of").eqNullSafe(F.col("p.of")) & (F.col("d.size") == F.col("p.size"))).select("row", "text", "d.size", "cut")
    part = F.array_join(F.slice(words(F.col("text")), F.col("cut.from").cast("int") + 1, (F.col("cut.to") - F.col("cut.from")).cast("int")), " ")
    j = j.withColumn("text", F.when(F.col("cut.to") - F.col("cut.from") == F.col("size"), F.col("text")).otherwise(part))
    new = {text: F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return j.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
