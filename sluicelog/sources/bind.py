"""Query log of the name server."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.misc import field, utc_timestamp
from ..schema import TableType
from .lines import Source


def _dns(lines: DataFrame) -> DataFrame:
    """Lines of the category ``queries:``; times are UTC, nothing is known of the response."""
    f = lambda i: field(F.col("f"), i)
    rows = lines.select(F.split("value", " ").alias("f")).where((F.size("f") >= 11) & (f(2) == "queries:"))
    client = F.split(f(5), "#")
    at = F.concat_ws(" ", f(0), f(1))
    times = [utc_timestamp(at, x) for x in ("dd-MMM-yyyy HH:mm:ss.SSS", "dd-MMM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")]
    when = F.unix_micros(F.coalesce(*times)) / 1e6
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return rows.select(
        field(client, 0).alias("c_ip"), field(client, 1).try_cast("long").alias("c_port"), f(8).alias("query"), f(9).alias("req_class"), f(10).alias("req_type"), when.alias("req_time"), when.alias("resp_time"),
        none("string").alias("answers"), none("string").alias("answer_types"), none("bigint").alias("answer_ttls"),
    ).where("req_time IS NOT NULL")


BIND_DNS = Source(TableType.DNS, "%Y%m%d", ("bind.log-{days}",), _dns)
