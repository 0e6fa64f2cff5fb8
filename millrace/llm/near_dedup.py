"""Near-duplicate documents: MinHash, banding, signature check, exact check, connected components.

Documents with equal shingle sets form a class, found by the set's digest; only one node for each class goes on. Its signature has
the minima of ``BANDS * ROWS`` universal hashes, cut into bands. Two sets of similarity 0.75 share no
band with a probability of (1 - 0.75**5)**48 = 2e-6.

Nodes that share a band are not paired with each other. First each node is held against one hub: the node of its bands that most others meet in
theirs, which is the centre of a group of copies. That is one pair for each node at most, and nearly all copies fall into components. Bands that still
join several components are then settled for good:

- A band of ``FEW`` nodes at most gives its pairs, which are at most (FEW - 1) / 2 for each of its rows.
- Larger bands that share nodes make a family. A family is dealt to blocks of bounded size, and each task holds the sets of two blocks against
  each other: only nodes outside the most common component, one at a time against all sets of the other block. No pair becomes a row; only links come out, those that
  join two components. This is the one step whose work isn't linear: nodes outside of a family's large component, times the family.

Nothing is capped, and nodes of one component need no test. Pairs of the first two kinds pass if their signatures agree often enough, and then if the full sets,
made anew from the texts, have the similarity; texts are sent to the node that they are held against, and a node with many partners gets them in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import discard, settle, small, word_lists
from millrace.llm.components import connected_components

#: Words of a shingle; bands and rows of a band; similarity in per cent; share of equal minima below which a pair can't have it.
SHINGLE, BANDS, ROWS, PER_CENT, AGREE = 5, 48, 5, 75, 0.6
#: Partners of a node in one task; nodes of a band that gives its pairs; shingles of the sets in a block of a family (8 MB).
SALT, FEW, BLOCK = 1000, 8, 1 << 20

_draw = np.random.default_rng(7)
_A = (_draw.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _draw.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of k words, A-Z lower-cased; with fewer words, of all of them as one; without any, none."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    lists = [np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws)) for ws in word_lists(data)]
    h = np.concatenate(lists) if lists else np.empty(0, np.uint64)
    k = min(k, len(h))
    if not k:
        return h
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc = _mix(acc + h[j : len(h) - k + 1 + j])
    return np.unique(acc)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of all hashes, as 16 bits of each."""
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full((len(_A), 1), 2**32 - 1, np.uint32)
    for at in range(0, len(x), 512):
        least = np.minimum(least, (_A * x[None, at : at + 512] + _B).min(axis=1, keepdims=True))
    return ((least[:, 0] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            ["doc", "n_shingles", "digest", "signature"],
        )


@F.arrow_udf(T.DoubleType())
def agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal minima of two signatures."""
    x, y = (np.frombuffer(b"".join(s.to_pylist()), "<u2").reshape(len(s), BANDS * ROWS) for s in (a, b))
    return pa.array((x == y).mean(axis=1))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (at, salt, role): holds every text of role 1 against those of role 0 before it."""
    now, against = None, []
    for batch in batches:
        found = []
        for at, salt, role, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (at, salt) != now:
                now, against = (at, salt), []
            s = shingle_set(text)
            if role == 0:
                against.append(s)
            elif any(100 * (both := len(np.intersect1d(s, x, assume_unique=True))) >= PER_CENT * (len(s) + len(x) - both) and both for x in against):
                found.append((doc, at))
        yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field("doc").type) for x in (zip(*found, strict=True) if found else ([], []))], ["a", "b"])


def _verified(texts: DataFrame, pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar: by signatures, then by full sets."""
    sig = lambda x: signatures.select(F.col("node").alias(x), F.col("signature").alias(f"of_{x}"))
    likely = pairs.join(sig("a"), "a").join(sig("b"), "b").where(agreement("of_a", "of_b") >= AGREE).select("a", "b")
    likely = settle(likely, "likely")
    hubs = likely.groupBy(F.col("b").alias("at")).agg(F.ceil(F.count(F.lit(1)) / SALT).alias("salts"))
    members = likely.join(hubs, likely.b == hubs.at).select(F.col("a").alias("doc"), "at", F.pmod(F.xxhash64("a"), "salts").alias("salt"), F.lit(1).alias("role"))
    need = settle(members.union(hubs.select("at", "at", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), F.lit(0))), "held-against")
    sent = texts.join(small(need), "doc").select("at", "salt", "role", "doc", "text")
    kind = T.StructType([T.StructField(c, texts.schema["doc"].dataType) for c in "ab"])
    found = settle(sent.repartition("at", "salt").sortWithinPartitions("at", "salt", "role", "doc").mapInArrow(_similar, kind), "similar")
    discard(likely, need)
    return found


def _bands(signature: Column) -> Column:
    """An array with a key for each band."""
    return F.array(*[F.xxhash64(F.lit(i), F.substring(signature, 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, texts = batch.columns
        yield pa.RecordBatch.from_arrays([*keys, pa.array([shingle_set(t.as_py()).tobytes() for t in texts], pa.binary())], [*batch.schema.names[:-1], "shingles"])


class _Blocks:
    """The sets of one or two blocks of a family, and the links that join their components."""

    def __init__(self, nodes: list, comps: list, sides: list[int], sets: list[bytes]):
        each = [np.frombuffer(s, np.uint64) for s in sets]
        self.nodes, self.n = nodes, np.array([len(s) for s in each])
        self.start = np.cumsum(self.n) - self.n
        known, self.ids = np.unique(np.concatenate(each), return_inverse=True)
        self.mark = np.zeros(len(known), bool)
        self.comp = np.unique(np.array([str(c) for c in comps]), return_inverse=True)[1]
        sides = np.array(sides)
        most = np.bincount(self.comp).argmax()
        left, right, odd = np.flatnonzero(sides == 0), np.flatnonzero(sides == sides.max()), self.comp != most
        self.links: list[tuple] = []
        self.hold(left[odd[left]], right)
        if sides.max():
            self.hold(right[odd[right]], left[~odd[left]])

    def hold(self, some: np.ndarray, others: np.ndarray) -> None:
        """Each of ``some`` against all ``others``; found components become one."""
        if not len(some) or not len(others):
            return
        n, ends = self.n[others], np.cumsum(self.n[others])
        ids = self.ids[np.repeat(self.start[others] - (ends - n), n) + np.arange(ends[-1])]
        for x in some:
            own = self.ids[self.start[x] : self.start[x] + self.n[x]]
            self.mark[own] = True
            both = np.add.reduceat(self.mark[ids], ends - n, dtype=np.int64)
            self.mark[own] = False
            like = others[100 * both >= PER_CENT * (n + self.n[x] - both)]
            for c, first in zip(*np.unique(self.comp[like], return_index=True), strict=True):
                if c != self.comp[x]:
                    self.links.append((self.nodes[x], self.nodes[like[first]]))
                    self.comp[self.comp == c] = self.comp[x]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (family, lo, hi): links of each two blocks."""
    now, rows = None, []

    def links(kind: pa.DataType) -> pa.RecordBatch:
        found = _Blocks(*map(list, zip(*rows, strict=True))).links if rows else []
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x in (zip(*found, strict=True) if found else ([], []))], ["a", "b"])

    for batch in batches:
        kind = batch.schema.field("node").type
        for family, lo, hi, side, comp, node, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (family, lo, hi) != now:
                yield links(kind)
                now = (family, lo, hi)
            rows.append((node, comp, side, shingles))
    if now:
        yield links(kind)


def _family_links(texts: DataFrame, bands: DataFrame) -> DataFrame:
    """Links between components that share ``bands`` (band, node, comp, n_shingles)."""
    hubs = bands.groupBy("band").agg(F.min("node").alias("hub"))
    stars = settle(connected_components(bands.join(hubs, "band").select(F.col("node").alias("a"), F.col("hub").alias("b"))), "families")
    nodes = bands.select("node", "comp", "n_shingles").distinct().join(stars, "node", "left").select("node", "comp", "n_shingles", F.coalesce("component", "node").alias("family"))
    nodes = settle(nodes, "family-nodes")
    blocks = nodes.groupBy("family").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("blocks"))
    kind = T.StructType([T.StructField("node", texts.schema["doc"].dataType), T.StructField("shingles", T.BinaryType())])
    ids = settle(nodes.select(F.col("node").alias("doc")).distinct(), "family-ids")
    sets = settle(texts.join(small(ids), "doc").select(F.col("doc").alias("node"), "text").mapInArrow(_sets, kind), "family-sets")
    each = nodes.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    each = each.select("family", "comp", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = each.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "comp", "node")
    kind = T.StructType([T.StructField(c, texts.schema["doc"].dataType) for c in "ab"])
    met = dealt.join(sets.where(F.octet_length("shingles") > 0), "node").select("family", "lo", "hi", "side", "comp", "node", "shingles")
    found = settle(met.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi").mapInArrow(_linked, kind), "family-links")
    discard(stars, nodes, ids, sets)
    return found


def _links(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of ``classes`` that connect whatever similarity connects."""
    rows = classes.select("node", "n_shingles", F.explode(_bands(F.col("signature"))).alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    rows = settle(rows.join(shared, "band"), "bands")
    central = settle(rows.groupBy("node").agg(F.sum("met").alias("central")), "central")
    signatures = settle(classes.select("node", "signature").join(central.select("node"), "node"), "signatures")
    hubs = rows.select("band", "node").join(central, "node").groupBy("band").agg(F.max(F.struct("central", "node")).alias("hub"))
    met = rows.join(hubs, "band").where("node <> hub.node").groupBy("node", F.col("hub.node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("node").agg(F.max(F.struct("n", "b")).alias("best")).select(F.col("node").alias("a"), "best.b")
    links = _verified(texts, best, signatures)
    comps = settle(connected_components(links), "components")

    labels = rows.join(comps, "node", "left").select("band", "node", "n_shingles", "met", F.coalesce("component", "node").alias("comp"))
    open_ = labels.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    live = settle(labels.join(open_, "band"), "open-bands")
    x, y = (live.where(F.col("met") <= FEW).select("band", F.col("node").alias(n), F.col("comp").alias(f"c{n}")) for n in "ab")
    few = _verified(texts, x.join(y, "band").where("a > b and ca <> cb").select("a", "b").distinct(), signatures)
    many = _family_links(texts, live.where(F.col("met") > FEW).select("band", "node", "comp", "n_shingles"))
    discard(rows, central, signatures, comps, live)
    return links.union(few).union(many)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, n_shingles, component_id, kept) for each row of ``docs``.

    component_id is the smallest key that links of similarity 0.75 or more reach, the row's own included; kept tells if it
    is the row's own. A null, empty or blank text has no shingle and no link. Rows with one key count as one
    document: what any of them is similar to, all are. A null key has a null component and is kept. Repeated rows stay, each with the same result. An
    empty table gives an empty result. Other columns are ignored."""
    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind = T.StructType([T.StructField("doc", texts.schema["doc"].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType())])
    rows = settle(texts.mapInArrow(_sign, kind), "signed")
    known = rows.where("digest is not null and doc is not null")
    classes = settle(known.groupBy("digest").agg(F.min("doc").alias("node"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature")), "classes")
    placed = settle(rows.select("doc", "n_shingles", "digest").join(classes.select("digest", "node"), "digest", "left").select("doc", "n_shingles", F.when(F.col("doc").isNotNull(), F.coalesce("node", "doc")).alias("node")), "placed")
    links = _links(texts, classes)
    split = placed.groupBy("doc").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b < hi")  # keys with several texts
    links = links.union(placed.join(split, "doc").select(F.col("node").alias("a"), "b"))
    comps = settle(connected_components(links), "components")
    discard(rows, classes)
    component = F.coalesce("component", "node")
    return placed.join(comps, "node", "left").select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that aren't the first of their component."""
    gone = settle(near_duplicates(docs, key, text).where("not kept").select(key).distinct(), "dropped")
    return docs.join(small(gone), key, "left_anti")
