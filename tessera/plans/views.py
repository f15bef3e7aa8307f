"""Measurement views over the star-schema tables: the signals that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANNELS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
#: Samples that a task gets where they are dealt evenly, about.
EVEN = 1 << 17
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", *CHANNELS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal_wide(spark: SparkSession, sf_dir: str, channels=CHANNELS, even: bool = False) -> DataFrame:
    """fecha, lab, mid, idx and the channels: supplier as measurement, its region as lab, ship year as date. Supplier, nation and region are dimensions; Spark broadcasts them while they are small.

    even: deals measurements over as many partitions as their number of samples asks for (a count of the file's rows, run when called), so that what a task holds does not grow with the table.
    """
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", *ORDER)
    if even:
        item = item.repartition(max(spark.sparkContext.defaultParallelism, -(-item.count() // EVEN)), "l_suppkey")
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = item.join(place.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    idx = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ORDER)) - 1
    return rows.select(F.year("l_shipdate").alias("fecha"), F.col("r_name").alias("lab"), F.col("l_suppkey").alias("mid"), idx.alias("idx"), *channels)


def signal(spark: SparkSession, sf_dir: str, channels=CHANNELS, even: bool = False) -> DataFrame:
    """signal_wide with a row for each channel. Made by a generator, which leaves a measurement's rows in their partition (unpivot does not)."""
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in channels])
    return signal_wide(spark, sf_dir, channels, even).select("fecha", "lab", "mid", "idx", F.inline(rows))


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fecha (date), lab (event type), laser 1-6, value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.to_date("ts").alias("fecha"), F.col("event_type").alias("lab"), (F.col("user_id") % 6 + 1).cast("int").alias("laser"), "ts", "event_id", "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mid, channel, samples: an embedding as a signal of 64 samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("mid"), F.col("label").alias("channel"), F.col("embedding").cast("array<double>").alias("samples"))
