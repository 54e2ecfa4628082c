"""Points from tables: features, labels, total orders, workers, roles, hold-out split, bounded buffers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranges import block_of, cuts_of

#: (l_orderkey, l_linenumber) repeats; these together don't, up to rows that are equal in all of them.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
POINT = "label double, numeric array<double>, discrete array<double>, categorical array<string>, raw string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Only a session on one machine may lack the setting; it gets a folder there."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "driftwell-shared")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate tables."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def points(df: DataFrame, numeric: list[Column], label: Column | None = None, discrete: list[Column] = (), categorical: list[Column] = (), raw: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """Records of one shape: label, numeric, discrete, categorical, raw; keep names columns that stay beside them."""
    vector = lambda xs, t: F.array(*[x.cast(t) for x in xs]) if xs else F.array().cast(f"array<{t}>")
    return df.select(*keep, (F.lit(None) if label is None else label).cast("double").alias("label"), vector(numeric, "double").alias("numeric"), vector(discrete, "double").alias("discrete"), vector(categorical, "string").alias("categorical"), (F.lit(None) if raw is None else raw).cast("string").alias("raw"))


def lineitem_features() -> list[Column]:
    return [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12.5]


def lineitem_points(spark: SparkSession, sf_dir: str, label: str = "returned") -> DataFrame:
    """Binary points (label 1 for returned lines, else -1; or 0), or with label "price" regression on the quantity."""
    df = table(spark, sf_dir, "lineitem")
    if label == "price":
        return points(df, [F.col("l_quantity") / 50], F.col("l_extendedprice") / 105000, keep=LINE_ORDER)
    other = 0.0 if label == "zero" else -1.0
    return points(df, lineitem_features(), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(other), keep=LINE_ORDER)


def embedding_points(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    x = F.transform(F.col("embedding") if dims is None else F.slice("embedding", 1, dims), lambda v: v.cast("double"))
    return df.select("vec_id", F.col("label").cast("double").alias("label"), x.alias("numeric"))


def decode(raw: Column, schema: str) -> Column:
    """A JSON record as a struct; text that isn't JSON gives nulls."""
    return F.from_json(raw, schema)


def valid(df: DataFrame) -> DataFrame:
    """Points whose discrete vectors hold whole numbers only."""
    from ..functions.vectors import integral

    return df.where(integral(F.col("discrete")))


def with_role(df: DataFrame, forecast: Column) -> DataFrame:
    return df.withColumn("op", F.when(forecast, "forecast").otherwise("train"))


def with_worker(df: DataFrame, key: str, workers: int) -> DataFrame:
    return df.withColumn("worker", F.pmod(F.col(key), F.lit(workers)).cast("int"))


def numbered(df: DataFrame, order: list[str], name: str = "rn", parts: int | None = None, by: str | None = None) -> DataFrame:
    """Adds each row's place (from 0) in a total order of the whole table, or of all rows with its value of ``by``.

    Rows are parted into ranges of the first (integral) key and each range is numbered for itself; counts of the ranges
    before (one small row for each) are added.  So no task sees more than its range.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__block", F.coalesce(block_of(F.col(order[0]), cuts_of(df, order[0], parts)), F.lit(-1)))
    keys = [*([by] if by else []), "__block"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(by).orderBy("__block") if by else Window.orderBy("__block")
    before = counts.select(*keys, (F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    w = Window.partitionBy(*keys).orderBy(*order)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        # Or several ranges would meet in a task.
        rows = rows.repartition(2 * parts, *keys)
    # At most ``parts`` rows (for each value of ``by``) are broadcast.
    return rows.withColumn(name, F.row_number().over(w)).join(F.broadcast(before), keys).withColumn(name, F.col(name) - 1 + F.col("__before")).drop("__block", "__before")


def holdout(df: DataFrame, order: list[str], test_size: int = 256) -> DataFrame:
    """Of every ten training rows the last two go to a test buffer that keeps the newest rows; those it evicts are trained
    after all.  Adds rn and split: train, test or evicted."""
    rows = numbered(df, order, parts=max(df.count() // 2_000_000 + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    held = F.pmod("rn", F.lit(10)) >= 8
    total = F.expr("rn div 10 * 2 + (pmod(rn, 10) - 7)")
    most = rows.where(held).agg(F.max(total).alias("most"))
    rows = rows.join(F.broadcast(most), how="left")
    fresh = total > F.coalesce("most", F.lit(0)) - test_size
    return rows.withColumn("split", F.when(~held, "train").when(fresh, "test").otherwise("evicted")).drop("most")


class Buffer:
    """A bounded buffer over an ordered table: the newest rows stay."""

    def __init__(self, max_size: int = 500_000):
        self.max_size = max_size

    def keep_newest(self, df: DataFrame, key: str) -> DataFrame:
        """What is left when rows arrive in ascending order of key and the oldest is evicted when there are too many."""
        return df.orderBy(F.col(key).desc()).limit(self.max_size)

    def evicted(self, df: DataFrame, key: str) -> DataFrame:
        """The rows that keep_newest doesn't keep."""
        return df.join(self.keep_newest(df, key).select(F.col(key)), key, "left_anti")

    def keep_random(self, df: DataFrame, key: str, seed: int = 1) -> DataFrame:
        """What is left when evictions are random: a uniform choice, by seeded hash."""
        return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)).limit(self.max_size)

    def complete_merge(self, merged: DataFrame, key: str, seed: int = 1) -> tuple[DataFrame, DataFrame]:
        """After a merge: what stays of a buffer that may have grown too large, and what is evicted, at random."""
        kept = self.keep_random(merged, key, seed)
        return kept, merged.join(kept.select(F.col(key)), key, "left_anti")

    def clear(self) -> Buffer:
        """Emptying resets the bound to its default."""
        return Buffer()


def merge_buffers(first: DataFrame, second: DataFrame, key: str, offset: int = 1) -> DataFrame:
    """second interleaved into first: one row of it after every ``offset`` rows of first, the remainder at the end.
    Both are ordered by key; adds place (from 0)."""
    a = numbered(first, [key]).withColumn("slot", F.expr(f"rn + (rn div {offset})")).withColumn("turn", F.lit(0))
    n = first.count() // offset
    b = numbered(second, [key]).withColumn("slot", F.when(F.col("rn") < n, (F.col("rn") + 1) * offset + F.col("rn")).otherwise(F.lit(first.count()) + F.col("rn"))).withColumn("turn", F.lit(1))
    return a.unionByName(b).withColumn("place", F.col("slot")).drop("slot", "rn")


def element(xs: Column, index: int) -> Column:
    return F.element_at(xs, index + 1)


def insert(xs: Column, index: int, value: Column) -> Column:
    return F.array_insert(xs, index + 1, value)


def remove(xs: Column, index: int) -> Column:
    return F.filter(xs, lambda x, i: i != index)


def without_features(df: DataFrame, numeric: list[int] = (), discrete: list[int] = (), categorical: list[int] = ()) -> DataFrame:
    """Points without the named positions of each of their vectors."""
    from ..functions.vectors import without

    return df.withColumns({c: without(F.col(c), list(drop)) for c, drop in (("numeric", numeric), ("discrete", discrete), ("categorical", categorical)) if drop})


def slices(df: DataFrame, vector: str, hubs: int, most: int, size: int, sparse: bool = False) -> DataFrame:
    """A row a message: hub, first and last position, and the slice of a vector of a known size; sparse: as a struct of
    size, indices and values without zeros."""
    from ..functions.vectors import sparse as pack
    from ..plans.protocols import buckets

    cut = F.array(*[F.struct(F.lit(h).alias("hub"), F.lit(a).alias("first"), F.lit(b).alias("last")) for h, a, b in buckets(size, hubs, most)])
    rows = df.select("*", F.explode(cut).alias("b")).select(*df.columns, "b.*")
    part = F.slice(vector, F.col("first") + 1, F.col("last") - F.col("first") + 1)
    return rows.withColumn("part", pack(part) if sparse else part).drop(vector)


def reassemble(messages: DataFrame, key: str, size: int, sparse: bool = False) -> DataFrame:
    """key, vector: the slices of a key in order of position, whatever order they came in; null while some are missing.
    A slice that came twice counts once."""
    from ..functions.vectors import dense

    part = dense(F.col("part")) if sparse else F.col("part")
    got = messages.select(key, F.struct("first", "last", part.alias("part")).alias("m")).groupBy(key).agg(F.array_sort(F.collect_set("m")).alias("ms"))
    whole = F.flatten(F.transform("ms", lambda m: m["part"]))
    return got.select(key, F.when(F.size(whole) == size, whole).alias("vector"))
