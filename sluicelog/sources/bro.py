"""Logs of the sniffer with tab-separated fields and ``-`` for missing values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ip
from ..functions.misc import dash_null, field
from ..schema import TableType
from .lines import Source


def _tabs(df: DataFrame) -> DataFrame:
    return df.select(F.split("value", "\t", -1).alias("f"))


def _f(i: int) -> Column:
    return field(F.col("f"), i)


def _n(i: int, kind: str = "long") -> Column:
    return dash_null(_f(i)).try_cast(kind)


def _ends() -> list[Column]:
    return [_f(2).alias("c_ip"), _n(3).alias("c_port"), _f(4).alias("s_ip"), _n(5).alias("s_port")]


def _items(i: int) -> Column:
    return F.when(_f(i) == "-", F.array().cast("array<string>")).otherwise(F.split(_f(i), ",", -1))


def _dns(lines: DataFrame) -> DataFrame:
    """Times are the request's, and that plus the round trip; flag bits from 2 on are recursion available, recursion desired, truncated, authoritative."""
    bit = lambda i, at: F.when(_f(i) == "T", F.lit(1 << at)).otherwise(F.lit(0))
    kind, answers = _f(13), _items(21)
    addresses = F.size(F.filter(answers, ip.is_ip))
    many = F.concat(F.array_repeat(F.lit("CNAME"), F.size(answers) - addresses), F.array_repeat(kind, addresses))
    kinds = F.when((F.size(answers) == 0) | kind.isin("-", "*", ""), F.array().cast("array<string>")).when(F.size(answers) == 1, F.array(kind)).otherwise(many)
    ts = _f(0).try_cast("double")
    return _tabs(lines).select(
        *_ends(), _f(7).alias("trans_id"), _f(9).alias("query"), _f(13).alias("req_type"), _f(11).alias("req_class"), ts.alias("req_time"), (ts + F.coalesce(_n(8, "double"), F.lit(0.0))).alias("resp_time"),
        (bit(19, 2) + bit(18, 3) + bit(17, 4) + bit(16, 5)).alias("flags_resp"), _f(15).alias("resp_code"), answers.alias("answers"), kinds.alias("answer_types"),
        F.transform(_items(22), lambda x: x.try_cast("double").cast("long")).alias("answer_ttls"),
    )


def _http(lines: DataFrame) -> DataFrame:
    ts = _f(0).try_cast("double")
    texts = {"method": 7, "host": 8, "path": 9, "referrer": 10, "user_agent": 12, "content_type": 28}
    numbers = {"request_body_len": 13, "response_body_len": 14, "status_code": 15}
    return _tabs(lines).select(
        *_ends(), ts.alias("req_time"), ts.alias("resp_time"), *[dash_null(_f(i)).alias(n) for n, i in texts.items()], *[_n(i).alias(n) for n, i in numbers.items()]
    )


def _flows(conn: DataFrame, http: DataFrame, ssl: DataFrame) -> DataFrame:
    """Connections that an HTTP or TLS record names, one row each: the least HTTP name if there is one, else the least TLS name (the server's address where that is missing)."""
    zero = lambda i, kind="long": F.coalesce(_n(i, kind), F.lit(0).cast(kind))
    start = _f(0).try_cast("double")
    flows = _tabs(conn).select(
        _f(1).alias("uid"), *_ends(), start.alias("time_start"), (start + zero(8, "double")).alias("time_end"), zero(9).alias("c_bytes"), zero(10).alias("s_bytes"), zero(16).alias("c_pkt"), zero(18).alias("s_pkt")
    )
    plain = _tabs(http).select(_f(1).alias("uid"), F.lit(0).alias("rank"), _f(8).alias("name"))
    secure = _tabs(ssl).select(_f(1).alias("uid"), F.lit(1).alias("rank"), F.coalesce(dash_null(_f(9)), _f(4)).alias("name"))
    names = plain.unionByName(secure).groupBy("uid").agg(F.min(F.struct("rank", "name")).alias("pick")).select("uid", "pick.name")
    return flows.join(names, "uid")


BRO_DNS = Source(TableType.DNS, "%Y-%m-%d", ("{days}/dns.*.log.gz",), _dns)
BRO_HTTP = Source(TableType.HTTP, "%Y-%m-%d", ("{days}/http.*.log.gz",), _http)
BRO_FLOWS = Source(TableType.NAMED_FLOWS, "%Y-%m-%d", ("{days}/conn.*.log.gz", "{days}/http.*.log.gz", "{days}/ssl.*.log.gz"), _flows)
