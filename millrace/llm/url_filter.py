"""URL rules as a sort-merge range join.

A rule is a host and a path; it fits its host and every subdomain when the path of the URL
starts with its own. Reversing a host (``a.example.com`` to ``com,example,a,``) makes "this host
and its subdomains" one interval of sorted keys, and such intervals either nest or don't meet. The mark that ends a label
is a control character (written here as a comma), which is escaped where a host has it.
URLs and rules are dealt to the same key ranges, sorted, and swept once per range: a stack holds
the rules whose interval is open, and a URL needs to be held only against the stack.

A range ends at keys taken from a bounded sample, which shapes the layout alone. The sort key of a URL
ends in a hash of its row, so ranges can cut a hot host apart; a rule goes to every
range that its interval meets. No task gets more than a range, streamed in order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import ascii_lower

#: Rows of the sample for each range.
SAMPLE_PER_RANGE = 32


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Ends a label of a key; in labels it and the escape are escaped.
_END, _ESCAPE = "\x01", "\x02"


def reversed_key(host: Column) -> Column:
    """Labels in reverse order, each with its end mark: a host's key is a prefix of its subdomains' keys. An empty host has an empty key."""
    host = F.replace(F.replace(host, F.lit(_ESCAPE), F.lit(f"{_ESCAPE}2")), F.lit(_END), F.lit(f"{_ESCAPE}1"))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _END), F.lit(_END)))


class _Host:
    """The rules of one host on the stack: path to (rule, verdict), and the lengths of paths, longest first."""

    def __init__(self, key: str):
        self.key, self.paths, self.lengths = key, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        self.paths[path] = (rule, verdict)
        if len(path) not in self.lengths:
            self.lengths = sorted({*self.lengths, len(path)}, reverse=True)

    def fit(self, path: str) -> tuple[str, str] | None:
        return next((self.paths[path[:n]] for n in self.lengths if n <= len(path) and path[:n] in self.paths), None)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (range, key, rules first): pops closed rules, pushes rules, answers URLs from the innermost host outwards."""
    at: int | None = None
    stack: list[_Host] = []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        rows: list[list] = [[] for _ in range(5)]
        for part, key, kind, row, host, path, rule, verdict in zip(*cols, strict=True):
            if part != at:
                at, stack = part, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1].key != key:
                    stack.append(_Host(key))
                stack[-1].add(path, rule, verdict)
                continue
            best = next((x for x in (h.fit(path) for h in reversed(stack)) if x), None) if host else None
            for out, v in zip(rows, (row, host, path, best and best[0], best and best[1]), strict=True):
                out.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(3).type), *(pa.array(x, pa.string()) for x in rows[1:])], ["row", "host", "path", "rule", "verdict"])


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row (key, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` has host, path and verdict. Of the rules that fit, the one with the longest host wins, then the longest
    path; without one, ``default`` holds and rule is null. Repeated rules count once (of differing verdicts the
    smallest, as text); a rule with a null field is left out. Repeated and null
    keys are kept row by row; an empty or unreadable URL has an empty host, which no rule fits. An empty table
    gives an empty result. Other columns are ignored, so their names can't clash."""
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = pages.select(F.col(key).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    seen = seen.withColumn("key", F.concat(reversed_key(F.col("host")), F.lit("\x00"), F.hex(F.xxhash64("row", "path"))))
    total = seen.count()
    fraction = min(1.0, SAMPLE_PER_RANGE * parts / max(total, 1))
    drawn = sorted(r.key for r in seen.select("key").sample(fraction, seed=5).collect())
    ends = sorted(set(drawn[:: max(1, len(drawn) // parts)][1:]))  # at most about as many as ranges

    @F.arrow_udf("int")
    def part(keys: pa.Array) -> pa.Array:
        return pa.array([bisect_right(ends, k) for k in keys.to_pylist()], pa.int32())

    known = rules.where("host is not null and path is not null and verdict is not null").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
    opened = known.select(reversed_key(F.col("host")).alias("key"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    # every key with this prefix lies before the prefix with the highest code point after it
    opened = opened.withColumns({"lo": part(F.col("key")), "hi": part(F.concat("key", F.lit("\U0010ffff")))})
    opened = opened.select(F.explode(F.sequence("lo", "hi")).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast(seen.schema["row"].dataType).alias("row"), "host", "path", "rule", "verdict")
    asked = seen.select(part(F.col("key")).alias("part"), "key", F.lit(1).alias("kind"), "row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    swept = asked.unionByName(opened).repartitionByRange(parts, "part").sortWithinPartitions("part", "key", "kind", "path")
    out = swept.mapInArrow(_sweep, T.StructType([T.StructField("row", seen.schema["row"].dataType), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))]))
    return out.select(F.col("row").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
