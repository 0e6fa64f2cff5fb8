"""Gates before training: every line of a dataset of the right shape, no evaluation rows among them, as many rows as expected.

Rows are those of ``sources.checked.read_checked`` (file, line, value, problems) or ``read_placed``. Counters are observed while the rows pass, so rows and verdict come of one read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.operators.shapes import let
from millrace.sources import checked

#: What ids of rows for evaluation contain.
FORBIDDEN_IDS = ("frozen", "diagnostic", "missing_mock_prediction", "phase02", "base_benchmark")


def _add(problems: Column, broken: Column, path: str, issue: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.concat(problems, F.array(F.struct(F.lit(path).alias("path"), F.lit(issue).alias("issue"))))).otherwise(problems)


def forbid_ids(rows: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN_IDS) -> DataFrame:
    """Adds a problem to sound rows whose id contains one of ``forbidden`` in any case."""
    name = F.lower(F.try_variant_get(F.try_parse_json("value"), "$.id", "string"))
    return rows.withColumn("problems", _add(F.col("problems"), (F.size("problems") == 0) & name.rlike("|".join(forbidden)), "$.id", "forbidden"))


def check_digests(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds a problem to sound rows in which a digest isn't that of its text (``texts``: key of the digest to key of the text)."""
    get = lambda v, k: F.try_variant_get(v, f"$.{k}", "string")

    def found(v: Column) -> Column:
        out = F.col("problems")
        for digest, text in texts.items():
            out = _add(out, F.sha2(get(v, text), 256) != get(v, digest), f"$.{digest}", "digest")
        return out

    return rows.withColumn("problems", F.when(F.size("problems") == 0, let(F.try_parse_json("value"), found)).otherwise(F.col("problems")))


@dataclass(frozen=True)
class Verdict:
    n_rows: int
    expected: int
    n_bad: int

    @property
    def passed(self) -> bool:
        return self.n_bad == 0 and self.n_rows == self.expected

    @property
    def errors(self) -> list[str]:
        out = [f"{self.n_bad} rows with faults"] if self.n_bad else []
        return out + ([f"{self.n_rows} rows, {self.expected} expected"] if self.n_rows != self.expected else [])


def write_gated(rows: DataFrame, path: str, expected: int) -> Verdict:
    """Writes the sound lines to ``path`` and returns what the gate has counted on the way."""
    seen = Observation("preflight")
    rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("problems") > 0).alias("n_bad")).where(F.size("problems") == 0).select("value").write.text(path)
    return Verdict(seen.get["n_rows"], expected, seen.get["n_bad"])


def report(rows: DataFrame, expected: Column, key: str | None = None) -> DataFrame:
    """One row: n_rows, n_expected, n_bad, n_problems, passed. An empty dataset passes only if none is expected.

    With a ``key``, rows are those of ``sources.checked.read_placed``, and repeats are counted as by ``by_issue``."""
    bad = F.size("problems") > 0
    if key is None:
        counted = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"), F.sum(F.size("problems")).alias("n_problems"))
    else:
        each = rows.select(checked.text_at(key).alias("key"), bad.alias("bad"), F.size("problems").alias("n"), *checked.PLACE)
        values = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.sum("n").alias("n_problems"), F.min(F.struct(*checked.PLACE, "bad")).alias("first"))
        # rows without the text repeat none
        again = F.when(F.col("key").isNull(), 0).otherwise(F.col("n") - 1)
        sound_again = F.when(F.col("key").isNull(), 0).otherwise(F.col("n") - 1 - (F.col("n_bad") - F.col("first.bad").cast("long")))
        counted = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n_bad") + sound_again), F.lit(0)).alias("n_bad"), F.sum(F.col("n_problems") + again).alias("n_problems"))
    return counted.select("n_rows", expected.cast("long").alias("n_expected"), "n_bad", F.coalesce("n_problems", F.lit(0)).alias("n_problems"), ((F.col("n_bad") == 0) & (F.col("n_rows") == expected)).alias("passed"))


def by_issue(rows: DataFrame, key: str | None = None) -> DataFrame:
    """How often each issue occurs at each path; with a ``key``, each row but the first with one value of that text counts as a ``duplicate`` too (as by ``sources.checked.with_duplicates``).

    Repeats are counted by value, so no row travels, and rows are read once."""
    if key is None:
        return rows.select(F.explode("problems").alias("p")).groupBy("p.path", "p.issue").agg(F.count(F.lit(1)).alias("n"))
    # a row gives its problems and its value; what a value has beyond one row repeats it
    found = F.transform("problems", lambda p: F.struct(p["path"].alias("path"), p["issue"].alias("issue"), F.lit(None).cast("string").alias("key")))
    value = F.array(F.struct(F.lit(f"$.{key}").alias("path"), F.lit("duplicate").alias("issue"), F.col("key").alias("key")))
    each = rows.select("problems", checked.text_at(key).alias("key")).select(F.explode(F.when(F.col("key").isNull(), found).otherwise(F.concat(found, value))).alias("p"))
    counted = each.groupBy("p.path", "p.issue", "p.key").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col("key").isNull(), F.col("n")).otherwise(F.col("n") - 1))
    return counted.where("n > 0").groupBy("path", "issue").agg(F.sum("n").alias("n"))
