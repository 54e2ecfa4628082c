"""What the corpus operators share: reading tables, writing intermediate tables, checking sizes."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A session without the setting (tests) gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = os.path.join(tempfile.gettempdir(), "driftwell-shared")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back: lineage ends, and the rows
    outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables of saved() that nothing which is still to run reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast df only if its counted rows are within limit; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


#: Rows of one key from which a join spreads it, and over how many parts.
HOT_ROWS, SALTS = 100_000, 64


def salted_join(left: DataFrame, keys: DataFrame, key: str, spread: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """left joined with keys, which has one row a key and n, how many rows of left have it.  Rows of a key with more than
    hot_rows are dealt over SALTS parts by the hash of ``spread``; there are at most rows / hot_rows such keys."""
    heavy = keys.where(F.col("n") > hot_rows).select(key, F.lit(True).alias("__hot"))
    count = heavy.count()
    if not count:
        return left.join(keys.drop("n"), key, how)
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("n") > hot_rows, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = left.join(broadcast_if(heavy, count, 1_000_000), key, "left").withColumn("__salt", salt)
    return left.join(keys.withColumn("__salt", F.explode(salts)).drop("n"), [key, "__salt"], how).drop("__salt", "__hot")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fingerprint_of(*cols: Column) -> Column:
    """128 bits of two seeded 64-bit hashes, as a struct to group and join by."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(0x5BD1E995), *cols).alias("b"))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """For functions of mapInArrow: what a task had is given back to the system at its end.  Python workers live on for
    later tasks, and allocators would keep the most that any task ever took."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not every C library has it
                pass

    return wrapped


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
