"""Line-delimited JSON with every fault reported by file and line.

Lines are read as text, in splits, so a file of any size is read by many tasks and from any store that Spark reads. A line's number is its place in its split
plus the lines of the splits before it in the file, which are counted in a first scan of the lines. No line fails the read. Where only the order of lines
matters, their places do: lines are then neither counted nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import shapes
from millrace.operators.shapes import PROBLEMS, Shape


#: What orders the lines of files: the file, the first byte of a split of it, a number that grows within the split.
PLACE = ("file", "split", "at")


def placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, split, at, value): all lines of text files and their places (``PLACE``)."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (file, line, value): all lines of text files, numbered from 1 in each file. Lines end with LF, CR LF or CR; an empty file has none."""
    lines = placed_lines(spark, path)
    # one row for each split of a file
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "split", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(splits, ["file", "split"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def read_checked(spark: SparkSession, path: str | list[str], shape: Shape) -> DataFrame:
    """Rows (file, line, value, problems): each line that isn't blank, stripped, with what is wrong with it (see ``shapes``); nothing where ``problems`` is empty."""
    return _checked(numbered_lines(spark, path), shape)


def read_placed(spark: SparkSession, path: str | list[str], shape: Shape) -> DataFrame:
    """The same rows with places instead of numbers of lines: (file, split, at, value, problems)."""
    return _checked(placed_lines(spark, path), shape)


def _checked(lines: DataFrame, shape: Shape) -> DataFrame:
    lines = lines.withColumn("value", tx.stripped(F.col("value"))).where("value <> ''")
    return lines.withColumn("problems", shapes.problems_of_text(shape, F.col("value")))


def text_at(key: str) -> Column:
    """A line's top-level text ``key``; null where the line isn't JSON or has no such text."""
    return F.try_variant_get(F.try_parse_json("value"), f"$.{key}", "string")


def with_duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Adds a problem (path of the key, ``duplicate``) to each row but the first (by file and line, or by place) of those with one value of a top-level text ``key``.

    First places are found by partial aggregation and joined back, so a value that very many rows have is no group in one task. Rows that aren't JSON, or have no such key, have no duplicates."""
    keyed = rows.withColumn("_key", text_at(key))
    place = F.struct(*(("file", "line") if "line" in rows.columns else PLACE))
    firsts = keyed.where("_key IS NOT NULL").groupBy("_key").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key", "_first")
    again = F.col("_first").isNotNull() & (place != F.col("_first"))
    found = F.when(again, F.array(F.struct(F.lit(f"$.{key}").alias("path"), F.lit("duplicate").alias("issue")))).otherwise(F.array().cast(PROBLEMS))
    return keyed.join(firsts, "_key", "left").withColumn("problems", F.concat("problems", found)).select(rows.columns)


def faults(rows: DataFrame) -> DataFrame:
    """Rows (file, line, path, issue) of all that is wrong."""
    return rows.select("file", "line", F.explode("problems").alias("p")).select("file", "line", "p.path", "p.issue")


class Faulty(ValueError):
    """A file has lines that break its shape."""


def load_valid(spark: SparkSession, path: str | list[str], shape: Shape, schema: str, key: str | None = None, shown: int = 10) -> DataFrame:
    """The rows of line-delimited JSON by ``schema``; raises ``Faulty`` with the number of faults and the first of them if any line breaks ``shape`` or repeats ``key``."""
    rows = read_checked(spark, path, shape)
    found = faults(with_duplicates(rows, key) if key else rows)
    first = found.orderBy("file", "line", "path", "issue").limit(shown).collect()
    if first:
        each = "; ".join(f"{r.file.rpartition('/')[2]}:{r.line}: {r.path}: {r.issue}" for r in first)
        raise Faulty(f"{found.count()} faults, the first of them {each}")
    return rows.select(F.from_json("value", schema).alias("row")).select("row.*")
