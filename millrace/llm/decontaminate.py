"""Benchmark decontamination by MinHash containment search over size partitions.

A short item is hardly visible in the minima of a long document, so both sides keep all hashes of shingles below a bound rather than a fixed
number of minima (scaled MinHash). The bound depends on the item's size: items are partitioned by powers of two, and a partition keeps the share that
leaves some ``SKETCH`` hashes of each item, all of a short one. The sketches of a document for the partitions are nested, so it keeps one: that of the greatest share that an item has. The share of an item's kept hashes that a document
has estimates the containment whatever the document's size. Candidates are then verified on all shingles.

Only DataFrame expressions. Items are the small side: their sketches are broadcast if they are counted and found small, else shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import settle, small, words

#: Words of a shingle; per cent of an item's shingles that make a leak; hashes of an item that a sketch keeps; share of them that makes a candidate.
SHINGLE, PER_CENT, SKETCH, CANDIDATE = 5, 75, 48, 0.3
_SCALE = 1 << 20


def _place(shingle: Column) -> Column:
    """Where a shingle's hash lies below ``_SCALE``: a sketch keeps those below its share."""
    return F.pmod(F.xxhash64(F.lit(3), shingle), F.lit(_SCALE))


def _shingles(w: Column) -> Column:
    """Distinct hashes of the shingles of the word hashes ``w``; with too few words, of all of them as one; without any, none."""
    n = F.size(w)
    each = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, F.array_distinct(each)).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def shingled(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """name and its distinct shingles s.

    The words are bound as the element of a one-element array: else the optimizer may put their expression into the
    lambda, where it would run once for each shingle."""
    hashed = F.transform(words(F.lower(F.col(text))), lambda x: F.xxhash64(x))
    return df.select(F.col(key).alias(name), F.transform(F.array(hashed), _shingles)[0].alias("s"))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row (key, item, n_shared, n_item) for each document and item of whose distinct shingles the document has 75 % or more.

    A null, empty or blank text has no shingle: such an item leaks nowhere. An item with fewer words than a shingle is one shingle and fits only
    documents of just those words. Rows with one key count as one document, in which at least one row must hold the item; of items with one id the
    longest counts. Rows with a null key and items with a null id are left out. Empty tables give an empty result. Other columns are ignored."""
    sets = shingled(items.where(F.col(item).isNotNull()), item, item_text, "item").groupBy("item").agg(F.max(F.struct(F.size("s").alias("n"), "s")).alias("x")).select("item", F.col("x.n").alias("n_item"), F.col("x.s").alias("of_item")).where("n_item > 0")
    share = F.least(F.lit(1.0), SKETCH / F.pow(F.lit(2.0), F.ceil(F.log2("n_item"))))
    kept = F.filter("of_item", lambda x: _place(x) < F.col("share") * _SCALE)
    # an item whose sketch came out empty is looked up by all it has
    sets = sets.withColumn("share", share).withColumn("kept", kept)
    empty = F.size("kept") == 0
    sets = sets.withColumns({"kept": F.when(empty, F.col("of_item")).otherwise(F.col("kept")), "share": F.when(empty, 1.0).otherwise(F.col("share"))})
    sets = settle(sets.select("item", "n_item", "of_item", "kept", "share", F.size("kept").alias("n_kept")), "item-sets")
    largest = sets.agg(F.coalesce(F.max("share"), F.lit(0.0))).first()[0]
    sketch = settle(sets.select("item", "n_kept", F.explode("kept").alias("s")), "item-sketches")

    known = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text")).where("doc is not null")
    seen = shingled(known, "doc", "text", "doc").select("doc", F.explode(F.filter("s", lambda x: _place(x) < largest * _SCALE)).alias("s"))
    hits = seen.join(small(sketch), "s").groupBy("doc", "item", "n_kept").agg(F.count_distinct("s").alias("hits"))
    candidates = settle(hits.where(F.col("hits") >= CANDIDATE * F.col("n_kept")).select("doc", "item"), "candidates")

    ids = settle(candidates.select("doc").distinct(), "candidate-ids")
    full = shingled(known.join(small(ids), "doc", "left_semi"), "doc", "text", "doc")
    pairs = full.join(candidates, "doc").join(small(sets, "item", "n_item", "of_item"), "item")
    shared = pairs.select("doc", "item", "n_item", F.size(F.array_intersect("s", "of_item")).alias("n"))
    found = shared.groupBy("doc", "item", "n_item").agg(F.max("n").alias("n_shared")).where(100 * F.col("n_shared") >= PER_CENT * F.col("n_item"))
    return found.select(F.col("doc").alias(key), F.col("item").alias(item), F.col("n_shared").cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"))


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", **columns) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    gone = settle(find_leaks(docs, items, key, **columns).select(key).distinct(), "leaked")
    return docs.join(small(gone), key, "left_anti")
