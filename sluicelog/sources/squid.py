"""Access logs of the caching proxy, in its own format of ten fields or the combined one."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.misc import dash_null, field, quoted_tokens, url_parts, utc_timestamp
from ..schema import TableType
from .lines import Source


def _split(lines: DataFrame) -> DataFrame:
    clean = F.regexp_replace("value", " +", " ")
    return lines.select(F.split(clean, " ").alias("f"), clean.alias("line"))


def _f(i: int) -> Column:
    return field(F.col("f"), i)


def _after_slash(x: Column) -> Column:
    return F.when(x.contains("/"), field(F.split(x, "/"), 1))


def _native(rows: DataFrame) -> DataFrame:
    start, method = _f(0).try_cast("double"), dash_null(_f(5))
    host, port, path = url_parts(method, _f(6), bare_connect=False)
    return rows.where(F.size("f") == 10).select(
        _f(2).alias("c_ip"), _after_slash(_f(8)).alias("s_ip"), port.alias("s_port"), start.alias("start"), (start + _f(1).try_cast("double") / 1000).alias("end"), method.alias("method"), host.alias("host"),
        path.alias("path"), _after_slash(_f(3)).try_cast("long").alias("status_code"), dash_null(_f(4)).try_cast("long").alias("bytes"), dash_null(_f(9)).alias("content_type"),
    )


def _http(lines: DataFrame) -> DataFrame:
    """Times of the combined format are read as UTC, to the second."""
    rows = _split(lines)
    own = _native(rows).withColumnsRenamed({"start": "req_time", "end": "resp_time", "bytes": "response_body_len"})
    combined = rows.where(F.size("f") != 10).select(quoted_tokens(F.col("line")).alias("f"))
    request = F.split(_f(5), " ")
    method = F.when(_f(5) != "-", field(request, 0))
    host, port, path = url_parts(method, field(request, 1), bare_connect=True)
    at = F.unix_micros(utc_timestamp(F.ltrim(_f(3), F.lit("[")), "dd/MMM/yyyy:HH:mm:ss")) / 1e6
    other = combined.select(
        _f(0).alias("c_ip"), F.lit(None).cast("string").alias("s_ip"), port.alias("s_port"), at.alias("req_time"), at.alias("resp_time"), method.alias("method"), host.alias("host"), path.alias("path"),
        dash_null(_f(6)).try_cast("long").alias("status_code"), dash_null(_f(7)).try_cast("long").alias("response_body_len"), _f(8).alias("referrer"), _f(9).alias("user_agent"),
    ).where("req_time IS NOT NULL")
    return own.unionByName(other, allowMissingColumns=True)


def _flows(lines: DataFrame) -> DataFrame:
    """Lines of the proxy's own format only; it counts the server's bytes alone."""
    return _native(_split(lines)).withColumnsRenamed({"start": "time_start", "end": "time_end", "bytes": "s_bytes", "host": "name"})


SQUID_HTTP = Source(TableType.HTTP, "%Y%m%d", ("access.log-{days}",), _http)
SQUID_FLOWS = Source(TableType.NAMED_FLOWS, "%Y%m%d", ("access.log-{days}",), _flows)
