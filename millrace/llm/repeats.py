"""Removal of repeated passages: every byte covered by a window of bytes that also starts elsewhere.

The windows are the suffixes of all texts, compared only through ``WINDOW`` bytes. They are grouped by digests in passes, not sorted: a digit is a string
found in the window, not its leading bytes. Those that stay equal through the last pass are the repeated windows. A pass keeps nothing but groups that
still have two members:

1. The first digit is the window's anchor, its 48-byte string of smallest hash. Equal windows have equal anchors at equal places, and
   windows in a row mostly share one, so a run of some 75 windows is one row. An anchor that is found once ends here.
   Runs of one anchor are of one kind if they cover the same bytes. Runs of a kind found twice are repeated as a whole; of each kind, if the
   anchor has several, one goes on.
2. The second digit is the core of a block: a run is cut into blocks of ``BLOCK`` windows, counted from the anchor, and the core is what all windows of
   the block have in common. A core found once ends here; blocks of one core are grouped by kind as the runs were.
3. The last digit is the single window.

Strings are compared by digests of 128 bits in all (64 of the anchor, 64 of the rest). Texts count as their bytes in UTF-8 and are never shuffled for the passes:
rows hold numbers only. A text is known by a digest and its size, so equal texts share their spans. Long texts are read in pieces; a piece's end
cuts a run, which only moves it to the third pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import settle, small

#: Bytes of a window and of an anchor; windows looked at in one piece.
WINDOW, ANCHOR, PIECE = 200, 48, 1 << 20
#: Windows of a block.
BLOCK = 12
#: Marks or spans up to which they are sent to all tasks (some 20 MB); beyond, they are joined by shuffle.
SENT = 600_000

_SPAN = WINDOW - ANCHOR + 1
_IDX = np.uint64((1 << 21) - 1)
_table = np.random.default_rng(23).integers(1, 2**63, (2, 256), dtype=np.uint64)
_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) < n:
        m = max(n, 1 << 16)
        out = []
        for base in (_ODD[which], pow(_ODD[which], -1, 2**64)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[which] = tuple(out)
    return _powers[which][0][:n], _powers[which][1][:n]


class _Hash:
    """Rolling polynomial hash of the strings of ``data``."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = _power(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_table[which][data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, n: int) -> np.ndarray:
        return _mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` keys in a row: blockwise minima from the left and from the right."""
    n = len(keys) - width + 1
    k = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    k[: len(keys)] = keys
    k = k.reshape(-1, width)
    left = np.minimum.accumulate(k, axis=1).ravel()
    right = np.minimum.accumulate(k[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def _runs(data: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: hash of the anchor, of the run, and place (start << 16 | number of windows << 8 | anchor - start), for a piece that starts at ``at``."""
    one, two = _Hash(data, 0), _Hash(data, 1)
    grams = one.all(ANCHOR)
    place = (_least((grams & ~_IDX) | np.arange(len(grams), dtype=np.uint64), _SPAN) & _IDX).astype(np.int64)
    cut = np.flatnonzero(np.diff(place))
    s1, s2 = np.r_[0, cut + 1], np.r_[cut, len(place) - 1]
    pos = place[s1]
    n = s2 - s1 + 1
    whole = _mix(two.of(s1, s2 + WINDOW) + ((pos - s1) << 8 | n).astype(np.uint64) * np.uint64(_ODD[1]))
    return grams[pos].view(np.int64), whole.view(np.int64), (s1 + at) << 16 | n << 8 | (pos - s1)


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for i, text in enumerate(batch.column(2)):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            for at in range(0, len(data) - WINDOW + 1, PIECE):
                anchor, run, where = _runs(data[at : at + PIECE + WINDOW - 1], at)
                for o, v in zip(out, (anchor, run, np.full(len(where), ids[i]), np.full(len(where), sizes[i]), where), strict=True):
                    o.append(v)
                if sum(map(len, out[4])) > 200_000:
                    yield _batch(out, ("part", "kind", "id", "size", "place"))
                    out = [[] for _ in range(5)]
        yield _batch(out, ("part", "kind", "id", "size", "place"))


def _batch(out: list[list[np.ndarray]], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in out], list(names))


def _blocks(data: np.ndarray, part: int, place: int) -> tuple[np.ndarray, ...]:
    """Blocks of the run at ``place``: hash of the core (with its place and the anchor), of the block, and place."""
    start, n, anchor = place >> 16, place >> 8 & 255, (place >> 16) + (place & 255)
    block = (anchor - np.arange(start, start + n)) // BLOCK
    cut = np.flatnonzero(np.diff(block))
    lo, hi = start + np.r_[0, cut + 1], start + np.r_[cut, n - 1]
    b = block[lo - start]
    h = _Hash(data[start : start + n + WINDOW - 1], 1)
    core = anchor - BLOCK * b - start  # the last window's start, even if the run ends before
    core = _mix(h.of(core, core + WINDOW - BLOCK + 1) + (b + 1).astype(np.uint64) * np.uint64(_ODD[0]) + np.uint64(part & 2**64 - 1))
    n = hi - lo + 1
    kind = _mix(h.of(lo - start, hi - start + WINDOW) + ((anchor - lo) << 8 | n).astype(np.uint64) * np.uint64(_ODD[1]))
    return core.view(np.int64), kind.view(np.int64), lo << 16 | n << 8 | (anchor - lo)


def _windows(data: np.ndarray, part: int, place: int) -> tuple[np.ndarray, ...]:
    """The single windows of the block at ``place``: the block's core, the hash of the window, and its start."""
    start, n = place >> 16, place >> 8 & 255
    return np.full(n, part), _Hash(data[start : start + n + WINDOW - 1], 1).all(WINDOW).view(np.int64), np.arange(start, start + n)


def _opened(by) -> callable:
    """Opens the marked runs or blocks of each text by ``by``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("part", "kind", "id", "size", "place")
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for i, size, text, marks in zip(*(c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns)), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for m in marks:
                    part, kind, place = by(data, m["part"], m["place"])
                    for o, v in zip(out, (part, kind, np.full(len(place), i), np.full(len(place), size), place), strict=True):
                        o.append(v)
                if len(out[4]) > 20_000:
                    yield _batch(out, names)
                    out = [[] for _ in names]
            yield _batch(out, names)

    return find


@F.arrow_udf(T.BinaryType())
def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The text without its spans; null where it has none."""
    out = []
    for t, s in zip(text, spans.to_pylist(), strict=True):
        if s is None:
            out.append(None)
            continue
        data, at, parts = t.as_py(), 0, []
        for x in s:
            parts.append(data[at : x["a"]])
            at = x["e"]
        out.append(b"".join([*parts, data[at:]]))
    return pa.array(out, pa.binary())


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SENT else df


def _passed(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """A pass over ``rows`` (part, kind, id, size, place): those that are repeated as a whole, and those that go on.

    Both sides of each join are settled tables, so that each has a shuffle of its own and hot parts can be split."""
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("lo"), F.max("kind").alias("hi")).where("n > 1")
    parts = settle(parts.select("part", (F.col("lo") != F.col("hi")).alias("mixed")), f"{name}-parts")
    met = settle(rows.join(parts, "part"), f"{name}-met")
    kinds = met.where("mixed").groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "size", "place")).alias("first"))
    kinds = settle(kinds, f"{name}-kinds")
    twice = met.where("mixed").join(kinds.where("n > 1").select("part", "kind"), ["part", "kind"])
    return met.where("not mixed").select("id", "size", "place").union(twice.select("id", "size", "place")), kinds.select("part", "first.*")


def _open(texts: DataFrame, marks: DataFrame, by, name: str) -> DataFrame:
    """The ``marks`` (id, size, part, place), opened."""
    marks = settle(marks.groupBy("id", "size").agg(F.collect_list(F.struct("part", "place")).alias("marks")), f"{name}-marks")
    n = marks.agg(F.sum(F.size("marks"))).first()[0] or 0
    if n > SENT:  # texts without marks needn't be moved to them
        texts = texts.join(small(marks, "id", "size"), ["id", "size"], "left_semi")
    found = texts.join(_sent(marks, n), ["id", "size"]).select("id", "size", "bytes", "marks").mapInArrow(_opened(by), _ROWS)
    return settle(found, name)


_ROWS = ", ".join(f"{n} long" for n in ("part", "kind", "id", "size", "place"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """Maximal repeated spans [a, e) of ``texts`` (id, size, bytes): rows id, size, a, e; equal (id, size) once."""
    long = texts.where(F.col("size") >= WINDOW)
    whole_runs, runs = _passed(settle(long.mapInArrow(_find_runs, _ROWS), "all-runs"), "runs")
    whole_blocks, blocks = _passed(_open(long, runs, _blocks, "blocks"), "blocks")
    windows = _open(long, blocks, _windows, "windows")
    twice = settle(windows.groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part", "kind"), "twice")
    spans = windows.join(twice, ["part", "kind"]).select("id", "size", F.col("place").alias("a"), (F.col("place") + WINDOW).alias("e"))
    start = F.shiftright("place", 16)
    spans = spans.union(whole_runs.union(whole_blocks).select("id", "size", start, start + F.shiftright("place", 8).bitwiseAND(255) - 1 + WINDOW))
    # every copy of a text has sent the same spans
    spans = spans.distinct()
    # spans that touch or overlap are one
    by_start = Window.partitionBy("id", "size").orderBy("a", "e")
    reach = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", F.when(reach >= F.col("a"), 0).otherwise(1))
    spans = spans.withColumn("no", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("id", "size", "no").agg(F.min("a").alias("a"), F.max("e").alias("e")).drop("no")


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and kept (binary: the remaining bytes); columns of these names are replaced.

    A null text is empty: nothing is removed and kept is empty. Texts shorter than a window have none; of texts that
    occur twice nothing is left, if they have a window. Keys aren't looked at, so null and repeated ones are harmless. An empty table gives an
    empty result."""
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    rows = docs.select(F.struct(*own).alias("_row"), data.alias("bytes"), F.octet_length(data).cast("long").alias("size"), F.xxhash64(F.lit(5), data).alias("id"))
    spans = repeated_spans(rows.select("id", "size", "bytes"))
    spans = settle(spans.groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("a", "e"))).alias("spans")), "spans")
    n = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    cut = rows.join(_sent(spans, n), ["id", "size"], "left")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["e"] - x["a"])
    return cut.select(
        "_row.*", F.col("size").alias("n_bytes"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.coalesce(_cut("bytes", "spans"), F.col("bytes")).alias("kept"),
    )
