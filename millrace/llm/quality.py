"""Quality rules with adaptive thresholds.

Every text is measured once. A few fixed base rules reject what can't be judged; for the rest, thresholds come from quantile sketches of each
language and source. A sketch is a histogram over bins of equal relative width, so sketches merge by adding counts: exactly, in any order, and with the same
result on every run. A fence of a source is the mean of its own and that of its language, weighted by its documents and ``PRIOR``; a language's in turn
that of its own and all documents'. So few documents lean on what is known of more, and no number of documents switches from one rule to another.

A value is unusual where it lies beyond three interquartile ranges, plus a margin, outside the quartiles. Thresholds are then
joined to the measures, and the unusual documents go.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import word_lists

#: What is compared: name to (SQL over the measures, margin, whether low values are unusual too). Whole numbers, so that all engines agree.
METRICS = {
    "word_length": ("100 * word_chars div n_words", 150, True),
    "symbols": ("1000 * n_symbols div word_chars", 60, False),
    "capitals": ("1000 * n_capitals div word_chars", 150, False),
    "dup_lines": ("1000 * n_dup_lines div n_lines", 250, False),
    "repeats": ("1000 * n_repeat_words div n_words", 250, False),
}
#: Documents that the wider group's fence counts as; interquartile ranges; base rules: words at least, and share of repeated words at most.
PRIOR, RANGES, MIN_WORDS, MAX_REPEAT = 100, 3, 50, 50
#: Added while whole numbers are divided, so that no quotient is negative and all engines round alike.
LIFT = 1_000_000

_BLANK = " \t\n\x0b\x0c\r"
_FIELDS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(ids: np.ndarray, n: int) -> int:
    """Words in 3-word windows found twice or more; ``ids`` are below n."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    _, triple, found = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = found[triple] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def _measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    known: dict[bytes, int] = {}
    ids = [np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, len(ws)) for ws in word_lists(data)]
    ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
    lines = Counter(x for x in text.split("\n") if x.strip(_BLANK))
    raw = np.frombuffer(data, np.uint8)
    return (
        len(ids), len(text) - sum(map(text.count, _BLANK)), sum(map(text.count, "#*$%&|<>")), int(((raw >= 65) & (raw <= 90)).sum()),
        lines.total(), lines.total() - len(lines), _repeat_words(ids, len(known)),
    )


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in _FIELDS]))
def _measures(texts: pa.Array) -> pa.Array:
    rows = [_measure(t.as_py()) for t in texts]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_FIELDS))], list(_FIELDS))


def measure(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the measures of each text and base_failed; columns of these names are replaced."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (*_FIELDS, "base_failed") and (keep_text or c != text)]
    m = docs.select(F.struct(*own).alias("row"), _measures(F.col(f"`{text}`")).alias("m")).select("row.*", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return m.withColumn("base_failed", failed)


def to_bin(v: Column) -> Column:
    """Bins of a value from 0: each below 64 its own, then 32 for each doubling."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (32 * shift + F.call_function("shiftright", v, shift)).cast("long")


def from_bin(b: Column) -> Column:
    """The smallest value of a bin."""
    shift = F.greatest(F.floor((b - 32) / 32), F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - 32 * shift).cast("long"), shift)


def sketch(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Histograms: language, source, metric, bin, n; of all documents that pass the base rules."""
    each = F.array(*[F.struct(F.lit(name).alias("metric"), F.expr(sql).cast("long").alias("value")) for name, (sql, _, _) in METRICS.items()])
    values = measured.where("not base_failed").select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(each).alias("m"))
    return values.groupBy("lang", "source", F.col("m.metric").alias("metric"), to_bin(F.col("m.value")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _fences(sketches: DataFrame, *by: str) -> DataFrame:
    """Per group and metric: docs, low and high."""
    keys = [*by, "metric"]
    whole = Window.partitionBy(*keys)
    s = sketches.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    s = s.withColumns({"docs": F.sum("n").over(whole), "upto": F.sum("n").over(whole.orderBy("bin"))})
    quartile = lambda k: from_bin(F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("bin"))))
    q = s.groupBy(*keys).agg(F.max("docs").alias("docs"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    margin, both = F.lit(0), F.lit(False)
    for name, (_, m, low) in METRICS.items():
        margin, both = F.when(F.col("metric") == name, m).otherwise(margin), F.when(F.col("metric") == name, F.lit(low)).otherwise(both)
    width = RANGES * (F.col("q3") - F.col("q1")) + margin
    return q.select(*keys, "docs", F.when(both, F.col("q1") - width).otherwise(F.lit(-1)).cast("long").alias("low"), (F.col("q3") + width).cast("long").alias("high"))


def _blended(docs: Column, own: Column, wider: Column) -> Column:
    """Mean of two fences, weighted by ``docs`` and ``PRIOR``, rounded down."""
    weight = (docs + PRIOR).cast("long")
    return F.call_function("div", docs * own + PRIOR * wider + LIFT * weight, weight) - LIFT


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row for each language and source: t_lang, t_source and fences (a struct low, high for each metric)."""
    a, b, c = (_fences(sketches, *by) for by in (("lang", "source"), ("lang",), ()))
    j = a.alias("a").join(b.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.metric") == F.col("b.metric"))).join(c.alias("c"), F.col("a.metric") == F.col("c.metric"))
    blend = lambda x: _blended(F.col("a.docs"), F.col(f"a.{x}"), _blended(F.col("b.docs"), F.col(f"b.{x}"), F.col(f"c.{x}")))
    rows = j.select(F.col("a.lang").alias("t_lang"), F.col("a.source").alias("t_source"), F.col("a.metric").alias("metric"), F.struct(blend("low").alias("low"), blend("high").alias("high")).alias("fence"))
    return rows.groupBy("t_lang", "t_source").agg(*[F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"f_{m}") for m in METRICS])


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` with kept: false for what fails the base rules or lies outside a fence of its language and source.

    Null languages and sources are groups like any other. Every row gets a verdict; an empty table has none. A column named kept is replaced."""
    values = [F.when(F.col("base_failed"), None).otherwise(F.expr(sql)).alias(f"v_{name}") for name, (sql, _, _) in METRICS.items()]
    own = [F.col(f"`{c}`") for c in measured.columns if c != "kept"]
    m = measured.select(F.struct(*own).alias("row"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), "base_failed", *values)
    j = m.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.lit(True)
    for name in METRICS:
        inside = inside & F.col(f"v_{name}").between(F.col(f"f_{name}.low"), F.col(f"f_{name}.high"))
    return j.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(inside, F.lit(True)))).select("row.*", "kept")
