"""Windowed aggregates and sessions over tables that grow, with a bound on lateness.

Each takes a streaming or a batch DataFrame; on a stream, state older than the
watermark is dropped and rows later than it are left out.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_time(df: DataFrame, seconds: str, late: str) -> DataFrame:
    """``df`` with ``event_time`` from epoch seconds, and its watermark."""
    return df.withColumn("event_time", F.timestamp_micros((F.col(seconds) * 1_000_000).cast("long"))).withWatermark("event_time", late)


def _edges() -> list[Column]:
    return [F.unix_timestamp("window.start").alias("start_s"), F.unix_timestamp("window.end").alias("end_s")]


def traffic_by_window(flows: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``start_s, end_s, name, bytes, flows`` by tumbling or (with ``slide``) sliding windows of the start."""
    window = F.window("event_time", width, slide or width)
    sums = with_time(flows, "time_start", late).groupBy(window, "name").agg(F.sum(F.coalesce("s_bytes", F.lit(0)) + F.coalesce("c_bytes", F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("flows"))
    return sums.select(*_edges(), "name", "bytes", "flows")


def visits_by_client(flows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``start_s, end_s, c_ip, flows`` of sessions separated by ``gap``; ``end_s`` includes it."""
    sums = with_time(flows, "time_start", late).groupBy(F.session_window("event_time", gap).alias("window"), "c_ip").agg(F.count(F.lit(1)).alias("flows"))
    return sums.select(*_edges(), "c_ip", "flows")


def heavy_by_window(dns: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start_s, end_s, resolver, queries, clients``; clients are approximate (2 %), so the state stays small."""
    sums = with_time(dns, "req_time", late).groupBy(F.window("event_time", width), F.col("s_ip").alias("resolver")).agg(F.count(F.lit(1)).alias("queries"), F.approx_count_distinct("c_ip", 0.02).alias("clients"))
    return sums.select(*_edges(), "resolver", "queries", "clients")


def first_seen(flows: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each flow once: repetitions in ``keys`` within the bound on lateness are dropped."""
    return with_time(flows, "time_start", late).dropDuplicatesWithinWatermark(keys)
