"""Tables read as signals: one row for each sample, keyed by channel and sample index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, ch: str, order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """(ch, n, re): each channel's rows in order.

    For channels that no task should hold, ``bucket`` is a long that never falls
    along the order (a day of a time, say): rows are numbered in their bucket,
    and what the buckets before hold is a running sum of one count for each.
    """
    values = [F.col(ch).alias("ch"), F.col(value).cast("double").alias("re")]
    if bucket is None:
        n = F.row_number().over(Window.partitionBy(ch).orderBy(*order)).cast("long") - 1
        return rows.select(F.col(ch).alias("ch"), n.alias("n"), values[1])
    from sonagrid.operators.scans import before

    cut = rows.select(*values, *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], bucket.cast("long").alias("bucket"))
    place = F.row_number().over(Window.partitionBy("ch", "bucket").orderBy(*[f"o{i}" for i in range(len(order))])) - 1
    counts = before(cut.groupBy("ch", "bucket").agg(F.count(F.lit(1)).alias("rows")), ("ch",), "bucket", "rows", F.sum, "ahead", levels=2)
    both = cut.withColumn("place", place).join(counts.select("ch", "bucket", "ahead"), ["ch", "bucket"])
    return both.select("ch", (F.col("place") + F.coalesce("ahead", F.lit(0.0)).cast("long")).alias("n"), "re")


def events_in_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel, 0: the values of all events in the order of time."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(0).cast("long").alias("one"), "ts", "event_id", "value")
    return ranked(rows, "one", ["ts", "event_id"], "value", F.unix_date(F.to_date("ts")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel for each user, its event values in the order of time."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    return ranked(rows, "user_id", ["ts", "event_id"], "value")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel for each supplier, its prices in the order of orders."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", *order)
    return ranked(rows, "l_suppkey", order, "l_extendedprice")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel for each event type: events in each hour from the table's first to its last, zero where there are none."""
    hour = F.expr("cast(floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) / 3600000000) as long)")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("ch"), hour.alias("hour"))
    ends = rows.agg(F.min("hour").alias("first"), F.max("hour").alias("last"))
    counts = rows.groupBy("ch", "hour").agg(F.count(F.lit(1)).cast("double").alias("c"))
    types = rows.select("ch").distinct().join(F.broadcast(ends), F.lit(True))
    grid = types.where("first is not null").select("ch", "first", F.explode(F.sequence("first", "last")).alias("hour"))
    return grid.join(counts, ["ch", "hour"], "left").select("ch", (F.col("hour") - F.col("first")).alias("n"), F.coalesce("c", F.lit(0.0)).alias("re"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel for each vector, its components in turn."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return rows.select(F.col("vec_id").alias("ch"), F.posexplode("embedding").alias("n", "v")).select("ch", F.col("n").cast("long").alias("n"), F.col("v").cast("double").alias("re"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, x, y, z): the first three components of each vector as a point."""
    e = lambda i: F.get("embedding", i).cast("double")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("pid"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"))


def to_arrays(signal: DataFrame, keys: tuple[str, ...] = ("ch",)) -> DataFrame:
    """One row for each key with its samples in order: the form that kernels take."""
    return signal.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "re"))), lambda s: s.re).alias("samples"))


def to_rows(arrays: DataFrame, keys: tuple[str, ...] = ("ch",), samples: str = "samples") -> DataFrame:
    """The inverse of to_arrays."""
    return arrays.select(*keys, F.posexplode(samples).alias("n", "re")).select(*keys, F.col("n").cast("long").alias("n"), "re")
