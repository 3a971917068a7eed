"""Totals per key, and their leaders."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaders(totals: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of greatest ``value``, ties by ``key`` ascending: heaps in the map tasks, never a full sort."""
    return totals.orderBy(F.col(value).desc(), F.col(key).asc_nulls_last()).limit(n)


def domain_traffic(flows: DataFrame, n: int = 50) -> DataFrame:
    """``domain, bytes``: bytes of both directions by name; a missing count is 0."""
    both = F.coalesce("s_bytes", F.lit(0)) + F.coalesce("c_bytes", F.lit(0))
    return leaders(flows.groupBy(F.col("name").alias("domain")).agg(F.sum(both).alias("bytes")), "bytes", "domain", n)


def contacted_resolvers(dns: DataFrame, n: int = 50) -> DataFrame:
    """``resolver, queries``: transactions by server; an unknown server is one of them."""
    return leaders(dns.groupBy(F.col("s_ip").alias("resolver")).agg(F.count(F.lit(1)).alias("queries")), "queries", "resolver", n)
