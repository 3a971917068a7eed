"""The queries p2, p3, p5 and p7 with their SQL twins."""

import datetime as dt
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import plain_form, plain_form_sql
from ..operators import intake, sessions, skew, timestamps
from ..workdir import shared_dir

FLOW_FIELDS = "c_ip c_port s_ip s_port c_pkt c_bytes s_pkt s_bytes time_start time_end name".split()
GAP_MS = 1_800_000
HEAVY_PERMILLE = 25
STAMP_YEAR = 2024
HTTP_TYPES = {c: "bigint" for c in ("c_port", "s_port", "request_body_len", "response_body_len", "status_code")} | {"req_time": "double", "resp_time": "double"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, first and last time of each plain ``flows.name``, plain ``dns.query`` and ``dns.s_ip``."""
    flows = skew.per_key(table(spark, sf_dir, "flows"), {"flows.name": plain_form(F.col("name"))}, F.col("time_start"))
    dns = skew.per_key(table(spark, sf_dir, "dns"), {"dns.query": plain_form(F.col("query")), "dns.s_ip": F.col("s_ip")}, F.col("req_time"))
    return flows.unionByName(dns)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with at least 2.5 % of all rows of their table."""
    return skew.heavy_keys(p2_per_key(spark, sf_dir), HEAVY_PERMILLE).select("field", "key_value")


def _stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "probes").select("probe_id", "zone", "date_order")
    both = [
        table(spark, sf_dir, source).select(F.lit(source).alias("source"), "row_id", "probe_id", F.col(column).alias("raw"))
        for source, column in (("http_intake", "req_time"), ("flow_intake", "time_start"))
    ]
    return both[0].unionByName(both[1]).join(probes, "probe_id", "left").drop("probe_id")


def p3_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of both intake tables: ``src, row_id, raw, utc_us``. Its dictionary lasts: another run over the same folder parses only what is new there."""
    path = f"{shared_dir(spark)}/stamp-dictionary-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return timestamps.normalise(_stamps(spark, sf_dir), STAMP_YEAR, path).select(F.col("source").alias("src"), "row_id", "raw", "utc_us")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose stamp denotes an instant, by a dictionary of this run."""
    return timestamps.normalise(_stamps(spark, sf_dir), STAMP_YEAR).where("utc_us IS NOT NULL").select(F.col("source").alias("src"), "row_id", "utc_us")


def _http_intake(spark: SparkSession, sf_dir: str) -> intake.Intake:
    return intake.Intake(table(spark, sf_dir, "http_lines"), "line_id", "line", intake.HTTP_FIELDS, intake.HTTP_RULES, HTTP_TYPES)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that fail, with the first reason."""
    return _http_intake(spark, sf_dir).rejected()


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good lines as HTTP rows."""
    return _http_intake(spark, sf_dir).accepted()


def _flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = table(spark, sf_dir, "flows")
    return sessions.distinct_events(flows, "c_ip", F.round(F.col("time_start") * 1000), FLOW_FIELDS)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of each client, repeated flows counted once."""
    return sessions.sessionize(_flow_events(spark, sf_dir), GAP_MS).select(F.col("key").alias("c_ip"), "start_ms", "end_ms", F.col("n_events").alias("n_flows"))


def p7_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with their duration and the number of different plain names seen."""
    found = sessions.sessionize(_flow_events(spark, sf_dir), GAP_MS)
    names = table(spark, sf_dir, "flows").select(
        F.col("c_ip").alias("key"), F.round(F.col("time_start") * 1000).cast("long").alias("time_ms"), plain_form(F.col("name")).alias("name")
    )
    counted = sessions.distinct_per_session(names, found, "name", GAP_MS)
    return counted.select(
        F.col("key").alias("c_ip"), "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.col("n_events").alias("n_flows"), F.col("n_values").alias("n_names")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found, "p2_per_key": p2_per_key, "p3_found": p3_found, "p3_stamps": p3_stamps,
    "p5_found": p5_found, "p5_rows": p5_rows, "p7_found": p7_found, "p7_sessions": p7_sessions,
}

_KEYS = f"""
    SELECT 'flows.name' AS field, {plain_form_sql("name")} AS key_value, time_start AS t FROM flows
    UNION ALL SELECT 'dns.query', {plain_form_sql('"query"')}, req_time FROM dns
    UNION ALL SELECT 'dns.s_ip', s_ip, req_time FROM dns"""

_SESSIONS = f"""
    WITH f AS (SELECT DISTINCT {", ".join(FLOW_FIELDS)} FROM flows),
    e AS (SELECT c_ip, CAST(round(time_start * 1000) AS BIGINT) AS t, {plain_form_sql("name")} AS plain FROM f),
    g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {GAP_MS} THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY c_ip ORDER BY t)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY c_ip ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM g)"""

_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_CELL = _FIELD.replace("(", "(?:", 1)
_LABEL = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"


def _field(i: int) -> str:
    """Field ``i`` of a well quoted record in DuckDB's SQL."""
    raw = f"regexp_extract(line, '^(?:{_CELL},){{{{{i}}}}}{_FIELD}', 1, 's')".replace("{{", "{").replace("}}", "}")
    return f"CASE WHEN starts_with({raw}, '\"') THEN replace(substring({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END"


_JUDGED = f"""WITH q AS (SELECT line_id, line, regexp_full_match(line, '{_CELL}(,{_CELL})*', 's') AS quoted FROM http_lines),
    n AS (SELECT *, length(regexp_replace(regexp_replace(line, '"([^"]|"")*"', '', 'gs'), '[^,]', '', 'gs')) + 1 AS n FROM q),
    f AS (SELECT *, {_field(7)} AS host, {_field(17)} AS size, {_field(18)} AS status FROM n),
    r AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN n <> 19 THEN 'columns'
        WHEN host <> '-' AND NOT (length(host) <= 253 AND regexp_full_match(host, '{_LABEL}([.]{_LABEL})*', 's')) THEN 'host'
        WHEN size <> '-' AND NOT (regexp_full_match(size, '[0-9]+', 's') AND TRY_CAST(size AS BIGINT) IS NOT NULL) THEN 'response_body_len'
        WHEN status <> '-' AND NOT regexp_full_match(status, '[1-5][0-9][0-9]', 's') THEN 'status_code' END AS reason FROM f)"""


def _typed(i: int, name: str) -> str:
    value, kind = f"nullif({_field(i)}, '-')", HTTP_TYPES.get(name)
    if kind == "bigint":
        value = f"CASE WHEN regexp_full_match({value}, '[-+]?[0-9]+') THEN TRY_CAST({value} AS BIGINT) END"
    elif kind:
        value = f"TRY_CAST({value} AS DOUBLE)"
    return f"{value} AS {name}"


_ZONE_SQL = r"(?: *(?:\[([A-Za-z0-9_+/-]+)|((?:UTC|GMT|utc|gmt)?[+-]\d\d(?::?\d\d)?)|([A-Za-z]+)))?"
_CLOCK_SQL = r"(\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?"
#: Written for this twin alone: what a shape's groups are called, and its pattern.
_SHAPES_SQL = {
    "iso": ("y m d h mi s f zn zo zl", rf"^(\d{{4}})-(\d\d)-(\d\d)[Tt ] *{_CLOCK_SQL}{_ZONE_SQL}$"),
    "digits": ("y m d h mi s f zn zo zl", rf"^(\d{{4}})(\d\d)(\d\d)[Tt ]?(\d\d)(\d\d)(\d\d)?(?:[.,]?((?:\d{{3}})+))?{_ZONE_SQL}$"),
    "words": ("d mon y h mi s f half zn zo zl", rf"^(?:[A-Za-z]{{3,9}},? +)?(\d{{1,2}})[/ -]([A-Za-z]{{3}})[/ -](\d{{4}})[: Tt] *{_CLOCK_SQL}(?: *([AaPp])[Mm])?{_ZONE_SQL}$"),
    "ctime": ("mon d h mi s f zn zo zl y", rf"^(?:[A-Za-z]{{3,9}},? +)?([A-Za-z]{{3}}) +(\d{{1,2}}) +{_CLOCK_SQL}{_ZONE_SQL} +(\d{{4}})$"),
    "slashes": ("a b y h mi s f half zn zo zl", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d\d)[ ,Tt]+{_CLOCK_SQL}(?: *([AaPp])[Mm])?{_ZONE_SQL}$"),
}


def _shape_sql(name: str) -> str:
    groups, pattern = _SHAPES_SQL[name]
    parts = [f"{x} := " + (f"g.{x}" if x in groups.split() else "''") for x in "y m d h mi s f half zn zo zl mon a b".split()]
    listed = ", ".join(f"'{x}'" for x in groups.split())
    return f"SELECT src, row_id, raw, zone, date_order, bare, struct_pack({', '.join(parts)}) AS g FROM (SELECT *, regexp_extract(bare, '{pattern}', [{listed}]) AS g FROM b WHERE num IS NULL AND regexp_matches(bare, '{pattern}'))"


def _stamps_sql() -> str:
    """The rule of the stamps for DuckDB; where two shapes could fit they agree."""
    low, high = (int(dt.datetime(y, 1, 1, tzinfo=dt.UTC).timestamp()) * 10**6 for y in (STAMP_YEAR, STAMP_YEAR + 1))
    offsets = ", ".join(f"('{z}', '{a}', {o})" for z, a, o in timestamps.zone_table(STAMP_YEAR) if a.isalpha())
    surely = lambda x: f"CASE WHEN {x} >= {low} AND {x} < {high} THEN {x} END"
    units = ", ".join(surely(x) for x in ("n::HUGEINT * 1000000 + us", "n::HUGEINT * 1000 + us // 1000", "n::HUGEINT", "n::HUGEINT // 1000"))
    mon = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(g.mon))"
    slash = lambda first, second: f"CASE date_order WHEN '{first}' THEN g.a WHEN '{second}' THEN g.b END"
    return rf"""WITH r AS (SELECT 'http_intake' AS src, row_id, probe_id, req_time AS raw FROM http_intake UNION ALL SELECT 'flow_intake', row_id, probe_id, time_start FROM flow_intake),
    t AS (SELECT r.*, zone, date_order, regexp_replace(regexp_replace(raw, '^[\s"''\[({{<]+', ''), '[\s"''\])}}>]+$', '') AS bare FROM r LEFT JOIN probes USING (probe_id)),
    n AS (SELECT *, CASE WHEN regexp_matches(bare, '^\d{{1,19}}(\.\d+)?$') THEN split_part(bare, '.', 1)::HUGEINT END AS n, rpad(substring(split_part(bare, '.', 2), 1, 6), 6, '0') AS u FROM t),
    b AS (SELECT *, CASE WHEN n IS NOT NULL THEN (SELECT coalesce({units}) FROM (SELECT TRY_CAST(u AS INT) AS us)) END AS num FROM n),
    g AS ({" UNION ALL ".join(_shape_sql(x) for x in _SHAPES_SQL)}),
    d AS (SELECT *, CASE WHEN g.a <> '' AND length(g.y) = 2 THEN '20' || g.y ELSE g.y END AS yy,
        CASE WHEN g.a <> '' THEN {slash("mdy", "dmy")} WHEN g.mon <> '' THEN {mon}::VARCHAR ELSE g.m END AS mm,
        CASE WHEN g.a <> '' THEN {slash("dmy", "mdy")} ELSE g.d END AS dd,
        CASE WHEN g.half = '' THEN g.h::INT WHEN g.h::INT BETWEEN 1 AND 12 THEN g.h::INT % 12 + CASE WHEN lower(g.half) = 'p' THEN 12 ELSE 0 END ELSE 99 END AS hh FROM g),
    l AS (SELECT *, TRY_CAST(CASE WHEN hh <= 23 THEN yy || '-' || mm || '-' || dd || ' ' || lpad(hh::VARCHAR, 2, '0') || ':' || g.mi || ':' || CASE WHEN g.s = '' THEN '00' ELSE g.s END || '.' || rpad(substring(g.f, 1, 6), 6, '0') END AS TIMESTAMP) AS clock,
        regexp_extract(g.zo, '([+-])(\d\d):?(\d\d)?$', ['sign', 'h', 'm']) AS o,
        CASE WHEN g.zo = '' AND g.zl = '' THEN CASE WHEN g.zn = '' THEN zone WHEN upper(g.zn) NOT IN ('UTC', 'GMT') THEN g.zn END END AS place FROM d),
    z AS (SELECT l.*, v.o AS letters FROM l LEFT JOIN (VALUES {offsets}) AS v(z, a, o) ON v.z = zone AND v.a = upper(g.zl) AND upper(g.zl) NOT IN ('Z', 'UTC', 'GMT')),
    w AS (SELECT *, CASE WHEN place IN (SELECT name FROM pg_timezone_names()) THEN clock AT TIME ZONE place END AS there FROM z),
    e AS (SELECT src, row_id, epoch_us(clock) AS us, CASE
        WHEN upper(g.zl) IN ('Z', 'UTC', 'GMT') OR upper(g.zn) IN ('UTC', 'GMT') THEN epoch_us(clock)
        WHEN g.zo <> '' THEN epoch_us(clock) - (CASE o.sign WHEN '-' THEN -1 ELSE 1 END) * (TRY_CAST(o.h AS BIGINT) * 3600 + coalesce(TRY_CAST(o.m AS BIGINT), 0) * 60) * 1000000
        WHEN g.zl <> '' THEN epoch_us(clock) - letters::BIGINT * 1000000
        WHEN (there - INTERVAL 1 HOUR) AT TIME ZONE place = clock THEN epoch_us(there) - 3600000000
        WHEN (there - INTERVAL 30 MINUTE) AT TIME ZONE place = clock THEN epoch_us(there) - 1800000000
        WHEN there AT TIME ZONE place = clock THEN epoch_us(there) END AS utc FROM w),
    f AS (SELECT src, row_id, max({surely("utc")}) AS utc FROM e GROUP BY 1, 2),
    s AS (SELECT b.src, b.row_id, b.raw, coalesce(b.num, f.utc)::BIGINT AS utc_us FROM b LEFT JOIN f USING (src, row_id))"""


SQL = {
    "p3_stamps": f"{_stamps_sql()} SELECT * FROM s",
    "p3_found": f"{_stamps_sql()} SELECT src, row_id, utc_us FROM s WHERE utc_us IS NOT NULL",
    "p5_found": f"""{_JUDGED} SELECT line_id, reason FROM r WHERE reason IS NOT NULL""",
    "p5_rows": f"""{_JUDGED} SELECT line_id, {", ".join(_typed(i, c) for i, c in enumerate(intake.HTTP_FIELDS))} FROM r WHERE reason IS NULL""",
    "p2_per_key": f"SELECT field, key_value, count(*) AS n_rows, min(t) AS first_time, max(t) AS last_time FROM ({_KEYS}) GROUP BY field, key_value",
    "p2_found": f"""WITH k AS (SELECT field, key_value, count(*) AS n FROM ({_KEYS}) GROUP BY 1, 2)
        SELECT field, key_value FROM k WHERE key_value IS NOT NULL
        AND n * 1000 >= {HEAVY_PERMILLE} * (SELECT sum(n) FROM k AS a WHERE a.field = k.field)""",
    "p7_found": f"{_SESSIONS} SELECT c_ip, min(t) AS start_ms, max(t) AS end_ms, count(*) AS n_flows FROM s GROUP BY c_ip, no",
    "p7_sessions": f"""{_SESSIONS} SELECT c_ip, min(t) AS start_ms, max(t) AS end_ms, max(t) - min(t) AS duration_ms,
        count(*) AS n_flows, count(DISTINCT plain) AS n_names FROM s GROUP BY c_ip, no""",
}
