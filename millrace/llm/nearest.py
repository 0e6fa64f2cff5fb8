"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred, turned to their principal axes and by rotations learned (iterative quantization, on a bounded sample) so that signs lose little; the signs of all rotations are a
row's code. Index: rows are packed into segments; a code is split into substrings of 16 bits, and for each substring a segment keeps its rows in the order of its values, so
equal values are one bucket. Search: a code within Hamming distance r of the query's agrees with it up to its share of r in one of the substrings (pigeonhole), so probing the
buckets within those shares finds every code within r. Codes found are held against r, and only rows within r are compared by their vectors.

The radius is the query's own: the sample shows how far codes differ at a distance (the quantile ``SURE``) and bounds the query's k-th distance;
a task narrows it further as it finds nearer rows. Queries travel in blocks, rows in segments; every block meets every segment, and only the k nearest of each leave the task. A query that
finds fewer than k rows is searched again with a radius that takes in every code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import discard, settle, small
from millrace.llm.vectors import matrix, usable

#: Rows of the sample that rotations and radii are learned from, rotations, most axes of a rotation, share of true neighbours that the radius is to take in.
SAMPLE, ROTATIONS, AXES, SURE = 8192, 2, 64, 0.985
#: Rows of a segment, queries of a block, pairs of rows compared by their vectors at once, query blocks a task keeps its finds of.
SEGMENT, BLOCK, PAIRS, HELD = 2048, 256, 1 << 14, 64
#: Packed rows that an Arrow batch holds.
_PACKED = 8
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


@dataclass
class Codes:
    """Learned codes: centre and projection (columns are bits), largest radius for a distance (rising steps: distances, radii), and the distinct sampled vectors with one id each."""

    centre: np.ndarray
    projection: np.ndarray
    distances: np.ndarray
    radii: np.ndarray
    sample: np.ndarray
    sample_ids: np.ndarray

    @property
    def bits(self) -> int:
        return self.projection.shape[1]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        return np.packbits((x - self.centre) @ self.projection > 0, axis=1).view(">u2").astype(np.uint16)

    def radius(self, distance: np.ndarray) -> np.ndarray:
        """The radius that takes in nearly all codes of rows at most so far away."""
        at = np.searchsorted(self.distances, distance)
        return np.where(at < len(self.radii), self.radii[np.minimum(at, len(self.radii) - 1)], self.bits)

    def bound(self, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of the distance to the k-th nearest row but the query's own: that in the sample."""
        out = np.full(len(x), np.inf)
        for i in range(len(x)):
            d = _distance(self.sample, x[i])[self.sample_ids != ids[i]]
            if len(d) >= k:
                out[i] = np.partition(d, k - 1)[k - 1]
        return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ONES[a ^ b].sum(-1, dtype=np.int64)


def learn(sample: np.ndarray, ids: np.ndarray) -> Codes:
    """Codes from sampled vectors. Copies count once."""
    sample, first = np.unique(sample, axis=0, return_index=True)
    ids, rng = ids[first], np.random.default_rng(7)
    centre = sample.mean(0)
    axes = np.linalg.eigh((sample - centre).T @ (sample - centre))[1][:, ::-1][:, :AXES]
    projected, rotated = (sample - centre) @ axes, []
    for _ in range(ROTATIONS):
        turn = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))[0]
        for _ in range(40):
            left, _, right = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = (left @ right).T
        rotated.append(axes @ turn)
    projection = np.hstack(rotated)
    projection = np.hstack([projection, np.zeros((len(projection), -projection.shape[1] % 16))])
    codes = Codes(centre, projection, np.zeros(0), np.zeros(0, np.int64), sample, ids)
    # pairs of rows, and rows moved towards others, show how codes differ at any distance
    a, b = sample[rng.integers(0, len(sample), PAIRS)], sample[rng.integers(0, len(sample), PAIRS)]
    moved = a + (b - a) * rng.random(len(a))[:, None] ** 2
    d, h = np.concatenate([_distance(a, b), _distance(a, moved)]), np.concatenate([hamming(codes.of(a), codes.of(b)), hamming(codes.of(a), codes.of(moved))])
    edges = np.linspace(0, d.max(initial=0), 129)[1:]
    bins, radii = np.searchsorted(edges, d), np.zeros(len(edges), np.int64)
    for i in range(len(edges)):
        inside = h[bins == i]
        radii[i] = np.ceil(np.quantile(inside, SURE)) if len(inside) else 0
    codes.distances, codes.radii = edges, np.maximum.accumulate(radii)
    return codes


def _buckets(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted substrings: the distinct values and how many rows each has."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[starts], np.diff(np.r_[starts, len(values)])


def probe(codes: np.ndarray, order: np.ndarray, wanted: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of all codes within the queries' radii.

    ``order``: for each substring the rows by its value. With radius = a * substrings + b, one of the first b + 1 substrings differs by a at most or one of the others by less than a."""
    m = codes.shape[1]
    near = np.zeros((len(wanted), len(codes)), bool)
    for j in range(m):
        share = radius // m - (j > radius % m)
        values, sizes = _buckets(codes[order[j], j])
        hit = _ONES[values[None, :] ^ wanted[:, j, None]] <= share[:, None]
        near[:, order[j]] |= np.repeat(hit, sizes, axis=1)
    q, r = np.nonzero(near)
    inside = hamming(codes[r], wanted[q]) <= radius[q]
    return q[inside], r[inside]


class _Found:
    """The k nearest rows so far of each query of a block."""

    def __init__(self, block: dict, dim: int, dtype: str):
        n = len(block["q_ids"]) // 8
        self.ids, self.codes = np.frombuffer(block["q_ids"], np.int64), np.frombuffer(block["q_codes"], np.uint16).reshape(n, -1)
        self.x = np.frombuffer(block["q_vectors"], dtype).reshape(n, dim).astype(np.float64)
        self.radius = np.frombuffer(block["radii"], np.int64).copy()
        self.rows = [(np.zeros(0, np.int64), np.zeros(0))] * n

    def search(self, segment: dict, dim: int, dtype: str, codes: Codes, k: int) -> None:
        n = len(segment["ids"]) // 8
        ids, code = np.frombuffer(segment["ids"], np.int64), np.frombuffer(segment["codes"], np.uint16).reshape(n, -1)
        order, x = np.frombuffer(segment["order"], np.uint16).reshape(-1, n), np.frombuffer(segment["vectors"], dtype).reshape(n, dim)
        for at in range(0, len(self.ids), 32):
            q, r = probe(code, order, self.codes[at : at + 32], self.radius[at : at + 32])
            q = q + at
            apart = ids[r] != self.ids[q]
            q, r = q[apart], r[apart]
            d = np.concatenate([_distance(x[r[p : p + PAIRS]].astype(np.float64), self.x[q[p : p + PAIRS]]) for p in range(0, len(q), PAIRS)]) if len(q) else np.zeros(0)
            ends = np.searchsorted(q, np.arange(at, min(at + 32, len(self.ids)) + 1))
            for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True), at):
                if hi > lo:
                    to, far = (np.concatenate(z) for z in zip(self.rows[i], (ids[r[lo:hi]], d[lo:hi]), strict=True))
                    best = np.lexsort((to, far))[:k]
                    self.rows[i] = to[best], far[best]
                    if len(best) == k:
                        self.radius[i] = min(self.radius[i], int(codes.radius(far[best][-1:])[0]))

    def batch(self, block: int) -> pa.RecordBatch:
        sizes = [len(to) for to, _ in self.rows]
        return pa.record_batch(
            [pa.array(np.full(sum(sizes), block)), pa.array(np.repeat(np.arange(len(sizes)), sizes)), pa.array(np.repeat(self.ids, sizes)), pa.array(np.concatenate([to for to, _ in self.rows])), pa.array(np.concatenate([d for _, d in self.rows]))], ["block", "place", "query_id", "vec_id", "score"]
        )


_SEGMENT = ("ids", "codes", "vectors", "order")
_QUERIES = ("q_ids", "q_codes", "q_vectors", "radii")


def _packer(codes: Codes, dim: int, dtype: str, k: int | None):
    """Packs rows (id, v) into segments of the index, or with ``k`` into blocks of queries with their radii."""
    size = SEGMENT if k is None else BLOCK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def done() -> pa.RecordBatch:
            i, x = np.concatenate(ids), np.concatenate(rows)
            c = codes.of(x)
            own = np.argsort(c.T, axis=1, kind="stable").astype(np.uint16) if k is None else codes.radius(codes.bound(x, i, k)).astype(np.int64)
            return pa.record_batch([pa.array([z.tobytes()], pa.binary()) for z in (i, c, x.astype(dtype), own)], _SEGMENT if k is None else _QUERIES)

        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, size - held)
                ids.append(np.asarray(part.column(0)))
                rows.append(matrix(part.column(1), dim))
                at, held = at + len(part), held + len(part)
                if held == size:
                    yield done()
                    ids, rows, held = [], [], 0
        if held:
            yield done()

    return pack


def _searched(blocks: DataFrame, segments: DataFrame, codes: Codes, dim: int, dtype: str, k: int) -> DataFrame:
    """The k nearest rows of each query, settled. Every block of queries meets every segment of rows: the stated queries against all rows, in blocks."""
    spark = blocks.sparkSession

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Found] = {}
        for batch in batches:
            for row in batch.to_pylist():
                number = row["block"]
                if number not in held:
                    if len(held) == HELD:  # its finds are merged with the later ones anyway
                        oldest = next(iter(held))
                        yield held.pop(oldest).batch(oldest)
                    held[number] = _Found(row, dim, dtype)
                held[number].search(row, dim, dtype, codes, k)
        for number, found in held.items():
            yield found.batch(number)

    many = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_PACKED))
    try:
        found = segments.crossJoin(small(blocks)).mapInArrow(search, "block long, place long, query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("block", "place").orderBy("score", "vec_id"))
        return settle(found.withColumn("rank", rank).where(F.col("rank") <= k), "nearest-found")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", many)


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """For each query (a row for which ``is_query`` holds) its k nearest rows found: (query_id, rank, key, score), score being the Euclidean distance of the vectors in double precision.

    Nearest first, ties to the smaller key; all rows where there are fewer than k. A query's own row, and others with its key, are no candidates for it. Rows whose
    vector is null, zero, holds a null or a non-finite component or is of another length than most, and rows with a null key take no part. Repeated candidates are
    listed as often as they occur; equal queries are one, queries with one key and different vectors are searched each. An empty table gives no row. Other columns are ignored."""
    kept = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id IS NOT NULL")
    dtype = "f4" if df.schema[vector].dataType == T.ArrayType(T.FloatType()) else "f8"
    rows, dim = usable(kept.withColumn("v", F.col("v").cast("array<double>")).where(F.exists("v", lambda c: c != 0)), "v")
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("id", "v").collect()
    if not sample:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double").withColumnRenamed("vec_id", key)
    codes = learn(np.array([r.v for r in sample]), np.array([r.id for r in sample], np.int64))
    segments = settle(rows.select("id", "v").mapInArrow(_packer(codes, dim, dtype, None), ", ".join(f"`{c}` binary" for c in _SEGMENT)), "index-segments")
    queries = rows.where("asks").select("id", "v").distinct().mapInArrow(_packer(codes, dim, dtype, k), ", ".join(f"`{c}` binary" for c in _QUERIES))
    blocks = settle(queries.withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    found = _searched(blocks, segments, codes, dim, dtype, k)

    largest = codes.bits

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks with queries that have fewer than k finds and a radius that may have left rows out: these get the largest radius, the others none."""
        for batch in batches:
            for row in batch.to_pylist():
                have = {p["place"]: p["n"] for p in row["places"] or ()}
                radius = np.frombuffer(row["radii"], np.int64)
                again = np.array([have.get(i, 0) < k and r < largest for i, r in enumerate(radius)])
                if again.any():
                    row["radii"] = np.where(again, largest, -1).tobytes()
                    yield pa.RecordBatch.from_pylist([{c: row[c] for c in (*_QUERIES, "block")}])

    counts = found.groupBy("block", "place").agg(F.count(F.lit(1)).alias("n")).groupBy("block").agg(F.collect_list(F.struct("place", "n")).alias("places"))
    again = settle(blocks.join(counts, "block", "left").select(*blocks.columns, "places").mapInArrow(missed, blocks.schema), "query-blocks-again")
    if not again.isEmpty():
        more = _searched(again, segments, codes, dim, dtype, k)
        found = found.join(more.select("block", "place").distinct(), ["block", "place"], "left_anti").select(found.columns).unionByName(more)
    discard(segments, blocks, again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(key), "score")
