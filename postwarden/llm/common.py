"""What the corpus operators share: reading tables, bound expressions, lineage cuts, blocks."""

from __future__ import annotations

import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of the characters that part words, and of a word.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset and all runs in one process, as in tests, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="postwarden-")


#: The tables that this thread has stored and not released, oldest first.
_STORED = threading.local()


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage ends here.

    A checkpoint would carry the plan's constraints along, which grow with every round of an
    iteration. The table goes when it is released, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/postwarden/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _hadoop(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _STORED.__dict__.setdefault("paths", []).append(path)
    return out


def release(spark: SparkSession, *paths: str | None) -> None:
    """Deletes stored tables that nothing reads any more."""
    for path in filter(None, paths):
        files, at = _hadoop(spark, path)
        files.delete(at, True)
        if path in _STORED.__dict__.get("paths", ()):
            _STORED.paths.remove(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` stored; the tables stored on the way to it are released."""
    before = set(_STORED.__dict__.get("paths", ()))
    out = stored(make())
    release(spark, *(p for p in list(_STORED.paths) if p not in before and p != out.stored_at))
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
