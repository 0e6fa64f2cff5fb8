"""Product codes of embeddings by Yinyang Lloyd over integers.

A vector is cut into equal parts; each part position has a codebook. Entries are clustered into groups, and a row keeps for each part the entry it is
assigned to, an upper bound of the distance to it, and one lower bound for each group (of the distance to the nearest other entry of the group). When a round has moved the
entries, the bounds are adjusted by the drifts, and only groups whose lower bound no longer exceeds the upper one are scanned. Scanned distances are exact
integers, so ties are decided exactly; bounds are rounded away from each other, so no tie is passed over.

A round is one pass: its tasks read the rows and bounds of the round before from the shared folder, write them anew, and add one row with
their sums for each codebook, which Spark adds up. Only codebooks come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import discard, settle, small
from millrace.llm.vectors import matrix, usable

#: Integer steps of a unit, parts of a vector, entries of a codebook, rounds, groups of entries.
STEPS, PARTS, ENTRIES, ROUNDS, GROUPS = 4096, 8, 16, 6, 4
#: Integers beyond are taken as this, so that squared distances stay exact.
LARGEST = (1 << 27) - 1
_FAR = np.iinfo(np.int64).max


@dataclass
class Books:
    """entries: parts by entries by places of a part; groups: parts by entries; drift, group_drift: how far entries, and the farthest of each group, moved in the last round."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray
    group_drift: np.ndarray

    def moved(self, entries: np.ndarray) -> Books:
        drift = _above(np.sqrt(((entries - self.entries) ** 2).sum(2)))
        far = np.stack([np.where(self.groups == g, drift, 0).max(1) for g in range(self.group_drift.shape[1])], 1)
        return Books(entries, self.groups, drift, far)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _above(x: np.ndarray) -> np.ndarray:
    """A single-precision number above a bound, whatever its rounding."""
    return np.nextafter((x * (1 + np.sign(x) * 1e-9)).astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - np.sign(x) * 1e-9)).astype(np.float32), np.float32(-np.inf))


def _grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """Clusters the entries of a codebook: the first of each cluster is the entry farthest from those before, then five rounds of k-means."""
    x = entries.astype(np.float64)
    firsts = [0]
    while len(firsts) < min(groups, len(x)):
        firsts.append(int(np.min([((x - x[i]) ** 2).sum(1) for i in firsts], axis=0).argmax()))
    middle = x[firsts]
    for _ in range(5):
        of = ((x[:, None] - middle[None]) ** 2).sum(2).argmin(1)
        middle = np.stack([x[of == g].mean(0) if (of == g).any() else middle[g] for g in range(len(middle))])
    return of


def first_books(parts: np.ndarray, groups: int) -> Books:
    """Codebooks whose entries are ``parts`` (parts by entries by places)."""
    return Books(parts, np.stack([_grouped(p, groups) for p in parts]), np.zeros(parts.shape[:2], np.float32), np.zeros((len(parts), groups), np.float32))


def assign(x: np.ndarray, of: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, groups: np.ndarray, drift: np.ndarray, group_drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For one part of many rows: the nearest entries (ties to the lower index), the new bounds, and the number of distances made.

    ``of`` None: no assignment is known, so everything is scanned."""
    n, made = len(x), 0
    if of is None:
        of, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf, np.float32), np.full((n, group_drift.shape[0]), -np.inf, np.float32)
    of, upper, lower = of.copy(), _above(upper.astype(np.float64) + drift[of]), _below(lower.astype(np.float64) - group_drift)
    rows = np.flatnonzero(upper >= lower.min(1))
    own = ((x[rows] - entries[of[rows]]) ** 2).sum(1)
    made += len(rows)
    upper[rows] = np.minimum(upper[rows], _above(np.sqrt(own)))
    fails = upper[rows, None] >= lower[rows]
    at = np.flatnonzero(fails.any(1))
    rows, own, fails = rows[at], own[at], fails[at]
    distance = np.full((len(rows), len(entries)), _FAR)
    distance[np.arange(len(rows)), of[rows]] = own
    for g in range(group_drift.shape[0]):
        members, scan = np.flatnonzero(groups == g), np.flatnonzero(fails[:, g])
        if len(members) and len(scan):
            distance[np.ix_(scan, members)] = ((x[rows[scan], None] - entries[None, members]) ** 2).sum(2)
            made += len(scan) * len(members)
    nearest, before = distance.argmin(1), of[rows]
    best = distance[np.arange(len(rows)), nearest]
    others = distance.copy()
    others[np.arange(len(rows)), nearest] = _FAR
    for g in range(group_drift.shape[0]):
        members, scan = np.flatnonzero(groups == g), fails[:, g]
        if len(members):
            least = others[:, members].min(1)
            bound = np.where(least == _FAR, np.inf, _below(np.sqrt(least.astype(np.float64))))
            # of a group that wasn't scanned only the entry just left is new among the others
            lower[rows, g] = np.where(scan, bound, np.minimum(lower[rows, g], bound))
        else:
            lower[rows, g] = np.inf
    of[rows], upper[rows] = nearest, _above(np.sqrt(best.astype(np.float64)))
    return of, upper, lower, made


_STATE = "`of` binary, upper binary, lower binary, error long, sums array<long>"


def _round(table: DataFrame, books: Books, first: bool, last: bool) -> DataFrame:
    """One pass: assigns all parts, and adds a row with the sums and counts of each entry for each task, or in the last pass the distances."""
    parts, k, width = books.entries.shape
    groups = books.group_drift.shape[1]

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kinds = np.zeros((parts, k, width + 1), np.int64), None
        for batch in batches:
            kinds, n = (batch.schema.field("key").type, batch.schema.field("label").type), len(batch)
            if not n:
                continue
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).reshape(n, parts, width).astype(np.int64)
            old = [None] * 3 if first else [np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("of", np.uint16), ("upper", np.float32), ("lower", np.float32))]
            of, upper, lower = np.zeros((n, parts), np.uint16), np.zeros((n, parts), np.float32), np.zeros((n, parts, groups), np.float32)
            error = np.zeros(n, np.int64)
            for p in range(parts):
                before = (None, None, None) if first else (old[0].reshape(n, parts)[:, p].astype(np.int64), old[1].reshape(n, parts)[:, p], old[2].reshape(n, parts, groups)[:, p])
                now, upper[:, p], lower[:, p], _ = assign(x[:, p], *before, books.entries[p], books.groups[p], books.drift[p], books.group_drift[p])
                of[:, p] = now
                if last:
                    error += ((x[:, p] - books.entries[p][now]) ** 2).sum(1)
                else:
                    for w in range(width):
                        sums[p, :, w] += np.bincount(now, x[:, p, w], k).astype(np.int64)
                    sums[p, :, width] += np.bincount(now, minlength=k)
            state = [pa.array([row.tobytes() for row in rows], pa.binary()) for rows in ((of,) if last else (of, upper, lower))]
            state += [pa.nulls(n, pa.binary())] * (3 - len(state))
            yield pa.record_batch([batch.column("key"), batch.column("label"), pa.nulls(n, pa.binary()) if last else batch.column("x"), *state, pa.array(error), pa.nulls(n, pa.list_(pa.int64()))], names)
        if kinds and not last:
            yield pa.record_batch([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), *[pa.nulls(1, pa.binary())] * 4, pa.nulls(1, pa.int64()), pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in table.schema if f.name in ("key", "label", "x")] + T._parse_datatype_string(_STATE).fields)
    names = schema.names
    return table.mapInArrow(pass_over, schema)


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> DataFrame:
    """One row (key, code, error, label_error, codebooks_sha256) for each row with a usable vector.

    Each component x becomes floor(4096 x), beyond ``LARGEST`` that. Rows whose vector is null, holds a null or a non-finite component or is of another length than most are
    dropped; a length that ``parts`` doesn't divide is a ValueError. The codebooks start from the smallest distinct keys (a null key comes last; of rows with one key
    the smallest vector counts), and have fewer entries where there are fewer keys. Repeated rows and rows with null keys each get their code. Rows with a
    null label are summed together. An empty table has no codes. Other columns are ignored."""
    kept, dim = usable(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v")), "v")
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    whole = F.transform("v", lambda c: F.least(F.greatest(F.floor(c * STEPS), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    kept = kept.select("key", "label", whole.alias("v"))
    keys = [r.key for r in kept.select("key").distinct().orderBy(F.asc_nulls_last("key")).limit(entries).collect()]
    starts = kept.where(F.col("key").isin([x for x in keys if x is not None]) | (F.col("key").isNull() & F.lit(None in keys))).groupBy("key").agg(F.min("v").alias("v"))
    start = [r.v for r in starts.orderBy(F.asc_nulls_last("key")).collect()]
    kind = df.schema[key].dataType
    if not start or not dim:
        schema = T.StructType([T.StructField(key, kind)]).add("code", "string").add("error", "long").add("label_error", "long").add("codebooks_sha256", "string")
        return df.sparkSession.createDataFrame([], schema)
    books = first_books(np.array(start, np.int64).reshape(len(start), parts, dim // parts).transpose(1, 0, 2), groups)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim).astype(np.int32)
            yield pa.record_batch([batch.column("key"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "label", "x"])

    packed_kind = T.StructType([T.StructField("key", kind), T.StructField("label", df.schema[label].dataType), T.StructField("x", T.BinaryType())])
    table = settle(kept.mapInArrow(packed, packed_kind), "vector-parts")
    for r in range(rounds):
        before, table = table, settle(_round(table if not r else table.where("sums IS NULL"), books, not r, False), "vector-round")
        discard(before)
        cells = table.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
        sums = np.zeros(len(cells), object)
        for c in cells:
            sums[c["at"]] = int(c["v"])
        sums = sums.reshape(parts, len(start), -1)
        count = sums[:, :, -1:]
        books = books.moved(np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books.entries).astype(np.int64))
    coded = settle(_round(table.where("sums IS NULL") if rounds else table, books, not rounds, True).select("key", "label", "of", "error"), "vector-codes")
    discard(table)
    totals = settle(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    # of sixteen bits each, the low byte first
    pairs = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.lower(F.substr(F.hex("of"), 4 * p + 1, F.lit(2))))
    out = coded.join(small(totals), F.col("label").eqNullSafe(F.col("of_label")))
    return out.select(F.col("key").alias(key), F.array_join(pairs, "").alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
