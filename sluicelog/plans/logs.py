"""The sources as queries: the tables' rows are written as lines of each log format, read back, and compared with the tables by SQL.

Lines carry what the format can: missing values as ``-``, times in its own
unit. The twins say in plain SQL which values come back.
"""

import ipaddress
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.registry import source
from ..workdir import materialize

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shown(expression: str) -> str:
    return f"coalesce(CAST({expression} AS STRING), '-')"


def _lines(df: DataFrame, separator: str, width: int, cells: dict[int, str]) -> DataFrame:
    """One line a row; cells not named hold the null mark."""
    return df.select(F.concat_ws(separator, *[F.expr(_shown(cells[i])) if i in cells else F.lit("-") for i in range(width)]).alias("value"))


def _read(tool: str, table: str, *scans: DataFrame) -> DataFrame:
    """The table from lines that lie in files, as logs do, spread over the cores."""
    spread = [s.repartition(s.sparkSession.sparkContext.defaultParallelism) for s in scans]
    return source(tool, table).table_of(*[materialize(s, "lines") for s in spread])


_ENDS = {2: "c_ip", 3: "c_port", 4: "s_ip", 5: "s_port"}


def src_bro_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``dns`` as tab-separated lines."""
    flag = lambda bit: f"IF(coalesce(flags_resp, 0) & {bit} <> 0, 'T', 'F')"
    listed = lambda x: f"nullif(array_join({x}, ',', '-'), '')"
    cells = _ENDS | {0: "req_time", 7: "trans_id", 8: "resp_time - req_time", 9: "query", 11: "req_class", 13: "req_type", 15: "resp_code", 16: flag(32), 17: flag(16), 18: flag(8), 19: flag(4)}
    return _read("Bro", "DNS", _lines(_table(spark, sf_dir, "dns"), "\t", 24, cells | {21: listed("answers"), 22: listed("answer_ttls")}))


def src_bro_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``http`` as tab-separated lines."""
    cells = _ENDS | {0: "req_time", 7: "method", 8: "host", 9: "path", 10: "referrer", 12: "user_agent", 13: "request_body_len", 14: "response_body_len", 15: "status_code", 28: "content_type"}
    return _read("Bro", "HTTP", _lines(_table(spark, sf_dir, "http"), "\t", 30, cells))


def src_bro_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``flows`` as connections, their names as TLS records on port 443 and HTTP records elsewhere."""
    flows = _table(spark, sf_dir, "flows")
    conn = _lines(flows, "\t", 20, _ENDS | {0: "time_start", 1: "row_id", 8: "time_end - time_start", 9: "c_bytes", 10: "s_bytes", 16: "c_pkt", 18: "s_pkt"})
    http = _lines(flows.where("s_port <> 443"), "\t", 12, {0: "time_start", 1: "row_id", 8: "name"})
    tls = _lines(flows.where("s_port = 443"), "\t", 12, {0: "time_start", 1: "row_id", 4: "s_ip", 9: "name"})
    return _read("Bro", "NamedFlows", conn, http, tls)


_URL = "IF(method <=> 'CONNECT', concat(coalesce(host, '-'), ':', s_port), concat('http://', coalesce(host, '-'), ':', s_port, coalesce(path, '')))"


def src_squid_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``http`` as lines of the proxy's own format."""
    cells = {0: "req_time", 1: "CAST(round((resp_time - req_time) * 1000) AS BIGINT)", 2: "c_ip", 3: f"concat('TCP_MISS/', {_shown('status_code')})", 4: "response_body_len", 5: "method", 6: _URL}
    return _read("Squid", "HTTP", _lines(_table(spark, sf_dir, "http"), " ", 10, cells | {8: f"concat('DIRECT/', {_shown('s_ip')})", 9: "content_type"}))


def src_squid_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``http`` where it has a time, as lines of the combined format."""
    at = f"concat('[', date_format({_EPOCH} + make_dt_interval(0, 0, 0, floor(req_time)), 'dd/MMM/yyyy:HH:mm:ss'))"
    request = f"""concat('"', IF(method IS NULL, '-', concat(method, ' ', {_URL}, ' HTTP/1.1')), '"')"""
    quoted = lambda x: f"""concat('"', {_shown(x)}, '"')"""
    cells = {0: "c_ip", 3: at, 4: "'+0000]'", 5: request, 6: "status_code", 7: "response_body_len", 8: quoted("referrer"), 9: quoted("user_agent"), 10: "'TCP_MISS:HIER_DIRECT'"}
    return _read("Squid", "HTTP", _lines(_table(spark, sf_dir, "http").where("req_time IS NOT NULL"), " ", 11, cells))


def src_squid_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``flows`` as lines of the proxy's own format: tunnels on port 443, fetches elsewhere."""
    name = "coalesce(nullif(regexp_replace(name, ' ', ''), ''), '-')"
    url = f"IF(s_port = 443, concat({name}, ':443'), concat('http://', {name}, ':', s_port, '/x'))"
    cells = {0: "time_start", 1: "CAST(round((time_end - time_start) * 1000) AS BIGINT)", 2: "c_ip", 3: "'TCP_TUNNEL/200'", 4: "s_bytes", 5: "IF(s_port = 443, 'CONNECT', 'GET')", 6: url, 8: f"concat('DIRECT/', {_shown('s_ip')})"}
    return _read("Squid", "NamedFlows", _lines(_table(spark, sf_dir, "flows"), " ", 10, cells))


def src_tstat_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dns`` where it has a time, as entries: a request, one response an answer, an error where the look-up failed; the row is the transaction."""
    dns = _table(spark, sf_dir, "dns").where("req_time IS NOT NULL")
    common = {0: "c_ip", 1: "c_port", 2: "s_ip", 3: "s_port", 4: "CAST(round(req_time * 1000) AS BIGINT)", 6: "row_id", 7: "query", 9: "req_class"}
    flags = lambda x: f"concat('0x', hex(coalesce({x}, 0)))"
    asked = _lines(dns, " ", 13, common | {5: "'REQ'", 10: "req_type", 12: flags("flags_req")})
    each = dns.withColumn("a", F.explode(F.arrays_zip("answers", "answer_types", "answer_ttls")))
    got = _lines(each, " ", 13, common | {5: "'RESP'", 8: "a.answer_ttls", 10: "a.answer_types", 11: "a.answers", 12: flags("flags_resp")})
    failed = _lines(dns.where("resp_code <> 'NOERROR'"), " ", 13, common | {5: "'RESP_ERR'", 10: "req_type", 11: "resp_code", 12: flags("flags_resp")})
    return _read("Tstat", "DNS", asked.unionByName(got).unionByName(failed))


def src_tstat_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``http`` where it has a time, as request lines."""
    cells = {0: "c_ip", 1: "c_port", 2: "s_ip", 3: "s_port", 4: "req_time", 5: "method", 6: "host", 8: "path", 9: "referrer", 10: "user_agent", 11: "req_cookie"}
    return _read("Tstat", "HTTP", _lines(_table(spark, sf_dir, "http"), "\t", 13, cells))


def src_tstat_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``flows`` as lines of 131 columns, names as TLS server names on port 443 and HTTP hosts elsewhere."""
    name = "nullif(regexp_replace(name, ' ', ''), '')"
    cells = {0: "c_ip", 1: "c_port", 2: "c_pkt", 8: "c_bytes", 14: "s_ip", 15: "s_port", 16: "s_pkt", 22: "s_bytes", 28: "time_start * 1000", 29: "time_end * 1000"}
    return _read("Tstat", "NamedFlows", _lines(_table(spark, sf_dir, "flows"), " ", 131, cells | {115: f"IF(s_port = 443, {name}, NULL)", 130: f"IF(s_port = 443, NULL, {name})"}))


def src_bind_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dns`` where it has a time, as lines of a query log, to the millisecond."""
    ms = "CAST(round(req_time * 1000) AS BIGINT)"
    at = f"date_format({_EPOCH} + make_dt_interval(0, 0, 0, {ms} / CAST(1000 AS DECIMAL(20, 0))), 'dd-MMM-yyyy HH:mm:ss.SSS')"
    cells = {0: f"split({at}, ' ')[0]", 1: f"split({at}, ' ')[1]", 2: "'queries:'", 3: "'info:'", 4: "'client'", 5: "concat(c_ip, '#', c_port)", 6: "'(x):'", 7: "'query:'", 8: "query", 9: "req_class", 10: "req_type", 11: "'+'"}
    return _read("Bind", "DNS", _lines(_table(spark, sf_dir, "dns").where("req_time IS NOT NULL"), " ", 12, cells))


_PACKETS = "req_time IS NOT NULL AND s_port = 53 AND c_ip NOT LIKE '%:%' AND s_ip NOT LIKE '%:%' AND coalesce(query, '') NOT LIKE '%..%' AND coalesce(query, '') NOT LIKE '.%'"


def _wire_name(name: str) -> bytes:
    return b"".join(bytes([len(x)]) + x.encode() for x in name.removesuffix(".").split(".") if x) + b"\0"


def _packet(r) -> bytes:
    codes, kinds = {"NOERROR": 0, "SERVFAIL": 2, "NXDOMAIN": 3, "REFUSED": 5}, {"A": 1, "CNAME": 5, "TXT": 16, "AAAA": 28, "*": 255}
    bits = int(0 if pd.isna(r.flags_resp) else r.flags_resp)
    flags = 0x8000 | sum(((bits >> low) & 1) << high for low, high in ((2, 7), (3, 8), (4, 9), (5, 10))) | codes[r.resp_code]
    answers = list(zip(r.answers, r.answer_types, r.answer_ttls, strict=True)) if r.answers is not None else []
    message = struct.pack("!6H", int(r.row_id) % 65536, flags, 1, len(answers), 0, 0) + _wire_name(r.query or "") + struct.pack("!2H", kinds[r.req_type], 1)
    for value, kind, ttl in answers:
        data = _wire_name(value) if kind == "CNAME" else ipaddress.ip_address(value).packed
        message += b"\xc0\x0c" + struct.pack("!2HIH", kinds[kind], 1, max(0, int(0 if pd.isna(ttl) else ttl)), len(data)) + data
    udp = struct.pack("!4H", int(r.s_port), int(r.c_port), 8 + len(message), 0) + message
    head = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0, ipaddress.ip_address(r.s_ip).packed, ipaddress.ip_address(r.c_ip).packed)
    frame = bytes(12) + b"\x08\x00" + head + udp
    micros = round(r.req_time * 1e6)
    return struct.pack("<4I", micros // 1_000_000, micros % 1_000_000, len(frame), len(frame)) + frame


def _captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        body = b"".join(map(_packet, rows.itertuples(index=False)))
        yield pd.DataFrame({"path": [""], "content": [struct.pack("<I2HiI2I", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + body]})


def src_pcap_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 responses from port 53 in ``dns`` as packets of captures, one a batch."""
    ship(spark)
    rows = _table(spark, sf_dir, "dns").where(_PACKETS).select("row_id", "c_ip", "c_port", "s_ip", "s_port", "query", "req_type", "req_time", "flags_resp", "resp_code", "answers", "answer_types", "answer_ttls")
    return _read("PCAP", "DNS", rows.mapInPandas(_captures, "path string, content binary"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (src_bro_dns, src_bro_http, src_bro_flows, src_squid_http, src_squid_combined, src_squid_flows, src_tstat_dns, src_tstat_http, src_tstat_flows, src_bind_dns, src_pcap_dns)
}

_DNS = "c_ip c_port s_ip s_port trans_id query req_type req_class req_time resp_time flags_req flags_resp resp_code answers answer_types answer_ttls".split()
_HTTP = (
    "c_ip c_port s_ip s_port req_time resp_time method host path referrer user_agent req_cookie "
    "set_cookie server content_type content_range request_body_len response_body_len status_code"
).split()
_FLOWS = "c_ip c_port s_ip s_port c_pkt c_bytes s_pkt s_bytes time_start time_end name".split()
_KINDS = {x: "BIGINT" for x in "c_port s_port flags_req flags_resp request_body_len response_body_len status_code c_pkt c_bytes s_pkt s_bytes".split()} | {
    x: "DOUBLE" for x in "req_time resp_time time_start time_end".split()
}


def _select(columns: list[str], kept: str, given: dict[str, str], rest: str) -> str:
    """Columns as they are, as given, else NULL."""
    out = [f"{given[c]} AS {c}" if c in given else c if c in kept.split() else f"CAST(NULL AS {_KINDS.get(c, 'VARCHAR')}) AS {c}" for c in columns]
    return f"SELECT {', '.join(out)} FROM {rest}"


_HAS = "(answers IS NOT NULL AND len(answers) > 0)"
_IP = r"regexp_full_match(x, '(\d{1,3}[.]){3}\d{1,3}|[0-9a-fA-F]*:[0-9a-fA-F:.]*')"
_N_IP = f"len(list_filter(answers, lambda x: {_IP}))"
_NO_BLANKS = "nullif(replace(name, ' ', ''), '')"
_CONNECT = "method IS NOT DISTINCT FROM 'CONNECT'"
_SORTED = "list_sort(list_transform(list_zip(answers, answer_types, answer_ttls), lambda z: {'a': z[1], 't': z[2], 'l': coalesce(z[3]::VARCHAR, '-')}))"
_TRIMMED = "CASE WHEN coalesce(query, '') = '' THEN '' WHEN ends_with(query, '.') THEN query[:-2] ELSE query END"

SQL = {
    "src_bro_dns": _select(_DNS, "c_ip c_port s_port trans_id req_type req_class req_time resp_code", {
        "s_ip": "coalesce(s_ip, '-')", "query": "coalesce(query, '-')", "resp_time": "req_time + coalesce(resp_time - req_time, 0.0)", "flags_resp": "(coalesce(flags_resp, 0) & 60)::BIGINT",
        "answers": f"CASE WHEN {_HAS} THEN answers ELSE []::VARCHAR[] END",
        "answer_types": f"CASE WHEN NOT {_HAS} OR req_type = '*' THEN []::VARCHAR[] WHEN len(answers) = 1 THEN [req_type] ELSE list_concat(list_resize([]::VARCHAR[], len(answers) - {_N_IP}, 'CNAME'), list_resize([]::VARCHAR[], {_N_IP}, req_type)) END",
        "answer_ttls": "CASE WHEN len(answer_ttls) > 1 OR answer_ttls[1] IS NOT NULL THEN answer_ttls ELSE []::BIGINT[] END",
    }, "dns"),
    "src_bro_http": _select(_HTTP, "c_ip c_port s_port req_time method host path referrer user_agent content_type request_body_len response_body_len status_code", {"s_ip": "coalesce(s_ip, '-')", "resp_time": "req_time"}, "http"),
    "src_bro_flows": _select(_FLOWS, "c_ip c_port s_ip s_port time_start", {
        "time_end": "time_start + coalesce(time_end - time_start, 0.0)", "name": "CASE WHEN s_port = 443 THEN coalesce(nullif(name, '-'), s_ip) ELSE coalesce(name, '-') END",
        **{x: f"coalesce({x}, 0)" for x in ("c_pkt", "c_bytes", "s_pkt", "s_bytes")},
    }, "flows"),
    "src_squid_http": _select(_HTTP, "c_ip s_port req_time method content_type response_body_len status_code", {
        "s_ip": "coalesce(s_ip, '-')", "resp_time": "req_time + round((resp_time - req_time) * 1000) / 1000", "host": "coalesce(host, '-')", "path": f"CASE WHEN NOT {_CONNECT} THEN coalesce(path, '/') END",
    }, "http"),
    "src_squid_combined": _select(_HTTP, "c_ip method response_body_len status_code", {
        "s_port": "CASE WHEN method IS NOT NULL THEN s_port END", "req_time": "floor(req_time)", "resp_time": "floor(req_time)", "host": "CASE WHEN method IS NOT NULL THEN coalesce(host, '-') END",
        "path": "CASE WHEN method <> 'CONNECT' THEN coalesce(path, '/') END", "referrer": "coalesce(referrer, '-')", "user_agent": "coalesce(user_agent, '-')",
    }, "http WHERE req_time IS NOT NULL"),
    "src_squid_flows": _select(_FLOWS, "c_ip s_port s_bytes time_start", {"s_ip": "coalesce(s_ip, '-')", "time_end": "time_start + round((time_end - time_start) * 1000) / 1000", "name": f"coalesce({_NO_BLANKS}, '-')"}, "flows"),
    "src_tstat_dns": _select(_DNS, "c_ip c_port s_port req_type req_class", {
        "s_ip": "coalesce(s_ip, '-')", "trans_id": "row_id::VARCHAR", "query": "coalesce(query, '-')", "req_time": "round(req_time * 1000) / 1000", "resp_time": "round(req_time * 1000) / 1000",
        "flags_req": "coalesce(flags_req, 0)", "flags_resp": f"CASE WHEN {_HAS} THEN coalesce(flags_resp, 0) END", "resp_code": f"CASE WHEN resp_code <> 'NOERROR' OR {_HAS} THEN resp_code END",
        "answers": f"CASE WHEN {_HAS} THEN list_transform({_SORTED}, lambda z: z.a) ELSE []::VARCHAR[] END", "answer_types": f"CASE WHEN {_HAS} THEN list_transform({_SORTED}, lambda z: z.t) ELSE []::VARCHAR[] END",
        "answer_ttls": f"CASE WHEN {_HAS} THEN list_transform({_SORTED}, lambda z: TRY_CAST(z.l AS BIGINT)) ELSE []::BIGINT[] END",
    }, "dns WHERE req_time IS NOT NULL"),
    "src_tstat_http": _select(_HTTP, "c_ip c_port s_port req_time method host path referrer user_agent req_cookie", {"s_ip": "coalesce(s_ip, '-')", "resp_time": "req_time"}, "http WHERE req_time IS NOT NULL"),
    "src_tstat_flows": _select(_FLOWS, "c_ip c_port s_port c_pkt c_bytes s_pkt s_bytes", {
        "s_ip": "coalesce(s_ip, '-')", "time_start": "time_start * 1000 / 1000", "time_end": "time_end * 1000 / 1000", "name": f"coalesce(nullif({_NO_BLANKS}, '-'), s_ip, '-')",
    }, "flows"),
    "src_bind_dns": _select(_DNS, "c_ip c_port req_type req_class", {
        "query": "coalesce(query, '-')", "req_time": "(round(req_time * 1000)::BIGINT * 1000) / 1e6", "resp_time": "(round(req_time * 1000)::BIGINT * 1000) / 1e6",
        "answers": "[]::VARCHAR[]", "answer_types": "[]::VARCHAR[]", "answer_ttls": "[]::BIGINT[]",
    }, "dns WHERE req_time IS NOT NULL"),
    "src_pcap_dns": _select(_DNS, "c_ip c_port s_ip s_port req_type resp_code", {
        "trans_id": "(row_id % 65536)::VARCHAR", "query": f"{_TRIMMED} || '.'", "req_class": "'IN'", "flags_resp": "(coalesce(flags_resp, 0) & 60)::BIGINT",
        **{x: "round(req_time * 1e6)::BIGINT // 1000000 + (round(req_time * 1e6)::BIGINT % 1000000) / 1e6" for x in ("req_time", "resp_time")},
        "answers": f"CASE WHEN {_HAS} THEN list_transform(list_zip(answers, answer_types), lambda z: CASE WHEN z[2] = 'CNAME' THEN rtrim(z[1], '.') || '.' ELSE regexp_replace(z[1], '(:0)+::', '::') END) ELSE []::VARCHAR[] END",
        "answer_types": "coalesce(answer_types, [])", "answer_ttls": "list_transform(coalesce(answer_ttls, []), lambda x: greatest(coalesce(x, 0), 0))",
    }, f"dns WHERE {_PACKETS}"),
}
