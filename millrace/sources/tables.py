"""Readers and writers: Parquet tables, line-delimited JSON, prediction maps, event-stream logs, file digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a line-delimited JSON file by a fixed schema; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def nonblank(lines: DataFrame, col: str = "value") -> DataFrame:
    return lines.where(F.trim(F.col(col)) != "")


def without_fences(lines: DataFrame, col: str = "value") -> DataFrame:
    """Generated lines without blank lines and code fences."""
    t = F.trim(F.col(col))
    return lines.where((t != "") & ~t.startswith("```"))


def predictions(maps: DataFrame, col: str = "value") -> DataFrame:
    """Rows (case_id, raw_text) of JSON maps from case to {"raw_text": ...}."""
    parsed = F.from_json(col, "map<string, struct<raw_text: string>>")
    return maps.select(F.explode(parsed).alias("case_id", "p")).select("case_id", "p.raw_text")


def stream_text(lines: DataFrame) -> DataFrame:
    """Per run the text, number of deltas and first delta of a saved event stream (run, pos, line).

    Only ``data: `` lines before the first ``[DONE]`` count; what isn't JSON is ignored."""
    said = lines.where(F.col("line").startswith("data: ")).withColumn("body", F.substring("line", 7, 2**31 - 1))
    done = said.groupBy("run").agg(F.min(F.when(F.col("body") == "[DONE]", F.col("pos"))).alias("end"))
    live = said.join(done, "run").where(F.col("end").isNull() | (F.col("pos") < F.col("end")))
    delta = F.get_json_object("body", "$.delta")
    live = live.where(F.try_parse_json("body").isNotNull()).select("run", "pos", delta.alias("delta")).where("delta is not null")
    parts = F.array_sort(F.collect_list(F.struct("pos", "delta")))
    return live.groupBy("run").agg(F.array_join(F.transform(parts, lambda x: x["delta"]), "").alias("text"), F.count(F.lit(1)).alias("n_deltas"), F.min("pos").alias("first_pos"))


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name, sha256 of the bytes, and sha256 with CRLF read as LF, of each file."""
    files = spark.read.format("binaryFile").load(paths)
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.sha2(F.encode(text, "ISO-8859-1"), 256).alias("lf_sha256"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV report with its columns in a fixed order."""
    df.select(*columns).write.option("header", "true").csv(path)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
