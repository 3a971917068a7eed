"""Logs of the passive flow meter."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.misc import dash_null, field, hex_number
from ..schema import TableType
from .lines import Source

_MINUTE_MS = 60_000


def _f(i: int) -> Column:
    return field(F.col("f"), i)


def _dns(lines: DataFrame) -> DataFrame:
    """Request and response entries of a transaction within one minute become one row.

    Times, in milliseconds in the log, are the first and last entry's. Answers
    are ordered by time, then answer. Without a request entry the query is that
    of the earliest entry. An error entry sets the code only.
    """
    names = "c_ip c_port s_ip s_port time entry trans_id query ttl class type answer flags".split()
    rows = lines.select(F.split("value", " ").alias("f")).where((F.size("f") >= 13) & (_f(12) != "flags:13"))
    rows = rows.select(*[_f(i).alias(n) for i, n in enumerate(names)])
    rows = rows.withColumns({"time": F.col("time").try_cast("double"), "flags": hex_number(F.col("flags"))}).where("time IS NOT NULL AND flags IS NOT NULL")
    entry = lambda kind, x: F.when(F.col("entry") == kind, x)
    asked = F.struct("query", "type", "class")
    order = F.struct("time", "answer")
    grouped = rows.groupBy(F.floor(F.col("time") / _MINUTE_MS).alias("bin"), "c_ip", "c_port", "s_ip", "s_port", "trans_id").agg(
        F.min("time").alias("first"), F.max("time").alias("last"), F.max_by(entry("REQ", asked), entry("REQ", F.col("time"))).alias("asked"), F.min_by(asked, order).alias("earliest"),
        F.max_by(entry("REQ", F.col("flags")), entry("REQ", F.col("time"))).alias("flags_req"), F.max_by(entry("RESP", F.col("flags")), entry("RESP", order)).alias("flags_resp"),
        F.array_sort(F.collect_list(entry("RESP", F.struct("time", "answer", "type", "ttl")))).alias("got"),
        F.max_by(entry("RESP_ERR", F.col("answer")), entry("RESP_ERR", order)).alias("error"),
    )
    query = F.coalesce("asked", "earliest")
    return grouped.select(
        "c_ip", F.col("c_port").try_cast("long").alias("c_port"), "s_ip", F.col("s_port").try_cast("long").alias("s_port"), "trans_id", query["query"].alias("query"), query["type"].alias("req_type"),
        query["class"].alias("req_class"), (F.col("first") / 1000).alias("req_time"), (F.col("last") / 1000).alias("resp_time"), "flags_req", "flags_resp",
        F.coalesce("error", F.when(F.size("got") > 0, F.lit("NOERROR"))).alias("resp_code"), F.col("got.answer").alias("answers"), F.col("got.type").alias("answer_types"),
        F.transform("got.ttl", lambda x: x.try_cast("long")).alias("answer_ttls"),
    )


def http_parser(unit: float = 1.0):
    """Parser of request lines; ``unit`` divides the log's times to give seconds."""

    def parse(lines: DataFrame) -> DataFrame:
        rows = lines.select(F.split("value", "\t", -1).alias("f")).where((F.size("f") > 12) & _f(4).try_cast("double").isNotNull() & (_f(5) != "HTTP"))
        at = _f(4).try_cast("double") / unit
        texts = {"method": 5, "host": 6, "path": 8, "referrer": 9, "user_agent": 10, "req_cookie": 11}
        return rows.select(
            _f(0).alias("c_ip"), _f(1).try_cast("long").alias("c_port"), _f(2).alias("s_ip"), _f(3).try_cast("long").alias("s_port"), at.alias("req_time"), at.alias("resp_time"), *[dash_null(_f(i)).alias(n) for n, i in texts.items()]
        )

    return parse


def _flows(lines: DataFrame) -> DataFrame:
    """Names by precedence: HTTP host, TLS server name, name from DNS, server address."""
    rows = lines.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f")).where((F.size("f") > 130) & _f(28).try_cast("double").isNotNull())
    numbers = {"c_port": 1, "c_pkt": 2, "c_bytes": 8, "s_port": 15, "s_pkt": 16, "s_bytes": 22}
    return rows.select(
        _f(0).alias("c_ip"), _f(14).alias("s_ip"), *[_f(i).try_cast("long").alias(n) for n, i in numbers.items()], (_f(28).try_cast("double") / 1000).alias("time_start"), (_f(29).try_cast("double") / 1000).alias("time_end"),
        F.coalesce(*[dash_null(_f(i)) for i in (130, 115, 126)], _f(14)).alias("name"),
    )


TSTAT_DNS = Source(TableType.DNS, "%Y_%m_%d", ("*/*/{days}*/log_dns_complete",), _dns)
TSTAT_HTTP = Source(TableType.HTTP, "%Y_%m_%d", ("*/*/{days}*/log_http_complete*",), http_parser())
TSTAT_FLOWS = Source(TableType.NAMED_FLOWS, "%Y_%m_%d", ("*/*/{days}*/log_tcp_complete*",), _flows)
