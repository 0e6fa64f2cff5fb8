"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (space, tab to carriage return).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``). Where it is unset, a local session gets one of its own, as in tests; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        where = _own.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-millrace-")
        _own[app] = where
    return where.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder as Parquet and reads it back.

    Unlike ``checkpoint()`` the table is columnar and compressed, and its size is known to
    the planner. It survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def _folder(settled: DataFrame):
    """The folder of a settled table, and its file system."""
    spark = settled.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(settled.settled_at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*settled: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in settled:
        path, files = _folder(df)
        files.delete(path, True)


#: Rows and bytes of a settled table up to which it may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16 << 20


def small(settled: DataFrame, *columns: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table, or ``columns`` of it, marked for broadcast if its files and its rows are counted and found small enough."""
    path, files = _folder(settled)
    out = settled.select(*columns) if columns else settled
    if files.getContentSummary(path).getLength() > BROADCAST_BYTES:
        return out
    return F.broadcast(out) if settled.count() <= rows else out


_space = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of UTF-8 ``data`` in order, as lists of about ``size`` bytes, so that a very long text is never held as one list."""
    at = 0
    while at < len(data):
        cut = _space.search(data, at + size) if at + size < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def words(text: Column) -> Column:
    """All words of a text in order; null and blank texts have none.

    ASCII white space runs are the separators, so stripping them from both ends first leaves
    no empty piece but that of a blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def word_count(text: Column) -> Column:
    """Number of words, without building them: a word starts where a non-space follows a space or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
