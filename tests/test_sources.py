"""Hand-written lines of each log format, read through files as a user would."""

import gzip
import struct

import pytest

from sluicelog.schema import TableType, conform, validate
from sluicelog.sources.lines import days
from sluicelog.sources.registry import SOURCES, read_table
from sluicelog.sources.tstat import http_parser


def write(root, path, lines, zipped=False):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    data = "".join(x + "\n" for x in lines).encode()
    file.write_bytes(gzip.compress(data) if zipped else data)


def tabs(n, **cells):
    row = ["-"] * n
    for k, v in cells.items():
        row[int(k[1:])] = v
    return "\t".join(row)


def read(spark, tmp_path, tool, table, first="2017_03_01", last="2017_03_02"):
    df = read_table(spark, tool, table, str(tmp_path), first, last)
    validate(df, TableType(table))
    return [r.asDict() for r in df.collect()]


def test_bro_dns(spark, tmp_path):
    ends = {"_2": "10.0.0.1", "_3": "5000", "_4": "8.8.8.8", "_5": "53", "_7": "77"}
    lines = [
        "#fields\tts", "",
        tabs(24, _0="100.5", **ends, _8="0.25", _9="www.a.it", _11="C_INTERNET", _13="A", _15="NOERROR", _16="F", _17="F", _18="T", _19="T", _21="x.cdn.net,1.2.3.4,1.2.3.5", _22="60.0,30.000000,5"),
        tabs(24, _0="101", **ends, _9="b.it", _13="AAAA", _15="NXDOMAIN", _16="T", _17="T", _18="F", _19="F"),
        tabs(24, _0="102", **ends, _9="c.it", _13="AAAA", _21="2001:db8::1", _22="9"),
        tabs(24, _0="103", **ends, _9="d.it", _13="*", _21="1.1.1.1,2.2.2.2", _22="-"),
    ]
    write(tmp_path, "2017-03-01/dns.00.log.gz", lines, True)
    write(tmp_path, "2017-03-03/dns.00.log.gz", lines, True)
    rows = {r["query"]: r for r in read(spark, tmp_path, "Bro", "DNS")}
    assert len(rows) == 4
    a = rows["www.a.it"]
    assert (a["req_time"], a["resp_time"], a["c_port"], a["trans_id"], a["flags_req"], a["flags_resp"]) == (100.5, 100.75, 5000, "77", None, 4 + 8)
    assert a["answers"] == ["x.cdn.net", "1.2.3.4", "1.2.3.5"] and a["answer_types"] == ["CNAME", "A", "A"] and a["answer_ttls"] == [60, 30, 5]
    b = rows["b.it"]
    assert b["resp_time"] == 101 and b["answers"] == [] and b["answer_ttls"] == [] and b["flags_resp"] == 16 + 32
    assert rows["c.it"]["answer_types"] == ["AAAA"] and rows["d.it"]["answer_types"] == []


def test_bro_http(spark, tmp_path):
    full = {"_0": "5", "_2": "c", "_3": "1", "_4": "s", "_5": "80", "_7": "GET", "_8": "h", "_9": "/x", "_10": "r", "_12": "ua", "_13": "3", "_14": "44", "_15": "200", "_28": "text/html"}
    write(tmp_path, "2017-03-01/http.1.log.gz", [tabs(30, **full), tabs(30, _0="6", _2="c")], True)
    rows = sorted(read(spark, tmp_path, "Bro", "HTTP"), key=lambda r: r["req_time"])
    assert rows[0]["status_code"] == 200 and rows[0]["content_type"] == "text/html" and rows[0]["resp_time"] == 5 and rows[0]["server"] is None
    assert rows[1]["method"] is None and rows[1]["request_body_len"] is None


def test_bro_flows(spark, tmp_path):
    conn = lambda uid: tabs(20, _0="10", _1=uid, _2="c", _3="1", _4="s", _5="443", _8="2.5", _9="100", _18="7")
    write(tmp_path, "2017-03-01/conn.1.log.gz", [conn(u) for u in "abcd"], True)
    write(tmp_path, "2017-03-01/http.1.log.gz", [tabs(12, _1="a", _8=h) for h in ("z.it", "b.it", "z.it")] + [tabs(12, _1="c", _8="http.it")], True)
    write(tmp_path, "2017-03-01/ssl.1.log.gz", [tabs(12, _1="b", _9="-", _4="9.9.9.9"), tabs(12, _1="c", _9="tls.it")], True)
    rows = {r["name"]: r for r in read(spark, tmp_path, "Bro", "NamedFlows")}
    assert set(rows) == {"b.it", "9.9.9.9", "http.it"}
    assert rows["b.it"] | {} == dict(c_ip="c", c_port=1, s_ip="s", s_port=443, c_pkt=0, c_bytes=100, s_pkt=7, s_bytes=0, time_start=10.0, time_end=12.5, name="b.it")


SQUID = [
    "100.5   250 10.0.0.1 TCP_MISS/200 1234 GET http://a.it/x/y?z=1 - DIRECT/1.2.3.4 text/html",
    "101.0 10 10.0.0.2 TCP_MISS/404 - POST http://b.it:8080 - HIER_NONE/- -",
    "102.0 10 10.0.0.3 TCP_TUNNEL/200 5 CONNECT c.it:443 - DIRECT/5.6.7.8 -",
    "103.0 10 10.0.0.4 TCP_TUNNEL/200 5 CONNECT c.it - NONE -",
    "104.0 10 10.0.0.5 TCP_DENIED/403 6 - error:bad - NONE/- -",
]
COMBINED = [
    '10.0.0.6 - - [05/Mar/2017:10:11:12 +0100] "GET http://d.it/p HTTP/1.1" 200 77 "-" "Some Agent/1.0"',
    '10.0.0.7 - - [05/Mar/2017:10:11:13 +0100] "CONNECT e.it HTTP/1.1" - - "http://r/" "A B"',
    "junk",
]


def test_squid_http(spark, tmp_path):
    write(tmp_path, "access.log-20170301", SQUID + COMBINED)
    rows = {r["c_ip"][-1]: r for r in read(spark, tmp_path, "Squid", "HTTP")}
    assert len(rows) == 7
    got = {k: (r["host"], r["s_port"], r["path"], r["status_code"], r["response_body_len"], r["s_ip"]) for k, r in rows.items()}
    assert got == {
        "1": ("a.it", 80, "/x/y?z=1", 200, 1234, "1.2.3.4"), "2": ("b.it", 8080, "/", 404, None, "-"), "3": ("c.it", 443, None, 200, 5, "5.6.7.8"), "4": (None, None, None, 200, 5, None),
        "5": (None, None, None, 403, 6, "-"), "6": ("d.it", 80, "/p", 200, 77, None), "7": ("e.it", None, None, None, None, None),
    }
    assert rows["1"]["resp_time"] == 100.75 and rows["5"]["method"] is None
    assert rows["6"]["user_agent"] == "Some Agent/1.0" and rows["6"]["referrer"] == "-" and rows["6"]["req_time"] == 1488708672.0


def test_squid_flows(spark, tmp_path):
    write(tmp_path, "access.log-20170302", SQUID + COMBINED)
    rows = {r["c_ip"][-1]: r for r in read(spark, tmp_path, "Squid", "NamedFlows")}
    assert {k: (r["name"], r["s_bytes"], r["c_bytes"]) for k, r in rows.items()} == {"1": ("a.it", 1234, None), "2": ("b.it", None, None), "3": ("c.it", 5, None), "4": (None, 5, None), "5": (None, 6, None)}


def test_tstat_dns(spark, tmp_path):
    key = "10.0.0.1 5000 8.8.8.8 53"
    lines = [
        "c_ip c_port s_ip s_port time entry id query ttl class type answer flags:13",
        f"{key} 60000100 REQ 7 q.it 0 IN A - 0x100", f"{key} 60000300 RESP 7 q.it 60 IN A 1.1.1.1 0x8180", f"{key} 60000200 RESP 7 q.it 30 IN CNAME x.it 0x8180",
        f"{key} 60000100 RESP 8 only.it 5 IN A 2.2.2.2 8180", f"{key} 60000100 RESP_ERR 9 bad.it 0 IN A NXDOMAIN 0x8183", f"{key} 60059999 REQ 10 edge.it 0 IN A - 0x100", f"{key} 60060001 RESP 10 edge.it 9 IN A 3.3.3.3 0x8180",
        "too short", f"{key} x REQ 11 q.it 0 IN A - 0x100",
    ]
    write(tmp_path, "p/q/2017_03_01_00/log_dns_complete", lines)
    rows = read(spark, tmp_path, "Tstat", "DNS")
    by = {(r["trans_id"], r["flags_req"] is None): r for r in rows}
    assert len(rows) == 5
    a = by["7", False]
    assert (a["query"], a["req_time"], a["resp_time"], a["flags_req"], a["flags_resp"], a["resp_code"]) == ("q.it", 60000.1, 60000.3, 256, 0x8180, "NOERROR")
    assert a["answers"] == ["x.it", "1.1.1.1"] and a["answer_types"] == ["CNAME", "A"] and a["answer_ttls"] == [30, 60]
    assert by["8", True]["query"] == "only.it" and by["9", True]["resp_code"] == "NXDOMAIN" and by["9", True]["flags_resp"] is None and by["9", True]["answers"] == []
    assert by["10", False]["resp_code"] is None and by["10", True]["answers"] == ["3.3.3.3"]


def test_tstat_http(spark, tmp_path):
    full = {"_0": "c", "_1": "1", "_2": "s", "_3": "80", "_4": "7000", "_5": "GET", "_6": "h", "_8": "/p", "_9": "r", "_10": "ua", "_11": "k=v"}
    lines = [tabs(13, **full), tabs(13, **(full | {"_5": "HTTP"})), "c\t1\ts\t80\t7\tGET", tabs(13, **(full | {"_4": "x"}))]
    write(tmp_path, "a/b/2017_03_02_10/log_http_complete.gz", lines, True)
    rows = read(spark, tmp_path, "Tstat", "HTTP")
    assert len(rows) == 1 and rows[0]["path"] == "/p" and rows[0]["req_cookie"] == "k=v" and rows[0]["req_time"] == 7000
    raw = spark.createDataFrame([(lines[0],)], "value string")
    assert http_parser(1000.0)(raw).first().req_time == 7


def test_tstat_flows(spark, tmp_path):
    def line(**cells):
        row = ["0"] * 131
        base = {"_0": "c", "_1": "1", "_2": "2", "_8": "80", "_14": "9.9.9.9", "_15": "443", "_16": "3", "_22": "90", "_28": "1500", "_29": "2500", "_115": "-", "_126": "-", "_130": "-"}
        for k, v in (base | cells).items():
            row[int(k[1:])] = v
        return " ".join(row)

    lines = [line(_130="host.it", _115="sni.it"), line(_115="sni.it", _126="dns.it"), line(_126="dns.it"), line(), "short line", line(_28="x")]
    write(tmp_path, "a/b/2017_03_01x/log_tcp_complete", lines)
    rows = {r["name"]: r for r in read(spark, tmp_path, "Tstat", "NamedFlows")}
    assert set(rows) == {"host.it", "sni.it", "dns.it", "9.9.9.9"}
    assert rows["host.it"] == dict(c_ip="c", c_port=1, s_ip="9.9.9.9", s_port=443, c_pkt=2, c_bytes=80, s_pkt=3, s_bytes=90, time_start=1.5, time_end=2.5, name="host.it")


def test_bind(spark, tmp_path):
    lines = ["01-Mar-2017 10:00:00.250 queries: info: client 10.0.0.1#5353 (q.it): query: q.it IN AAAA + (9.9.9.9)", "01-Mar-2017 10:00:00.250 security: info: client 10.0.0.1#5353 (q.it): query: q.it IN A +", "queries: short"]
    write(tmp_path, "bind.log-20170301", lines)
    (row,) = read(spark, tmp_path, "Bind", "DNS")
    assert (row["c_ip"], row["c_port"], row["query"], row["req_class"], row["req_type"], row["req_time"], row["s_ip"], row["answers"]) == ("10.0.0.1", 5353, "q.it", "IN", "AAAA", 1488362400.25, None, [])


def name(text):
    return b"".join(bytes([len(x)]) + x.encode() for x in text.split(".")) + b"\0"


def packet(flags, answers, qtype=1, cut=0, port=53):
    dns = struct.pack("!6H", 4711, flags, 1, len(answers), 0, 0) + name("www.a.it") + struct.pack("!2H", qtype, 1)
    for kind, ttl, data in answers:
        dns += b"\xc0\x0c" + struct.pack("!2HIH", kind, 1, ttl, len(data)) + data
    udp = struct.pack("!4H", port, 40000, 8 + len(dns), 0) + dns
    ip = struct.pack("!2B3H2BH", 0x45, 0, 20 + len(udp), 1, 0, 64, 17, 0) + bytes([8, 8, 8, 8]) + bytes([10, 0, 0, 1])
    frame = b"\0" * 12 + b"\x08\x00" + ip + udp
    return frame[: len(frame) - cut]


def capture(packets, end="<", nano=False):
    out = struct.pack(end + "I2H4I", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, p in enumerate(packets):
        out += struct.pack(end + "4I", 1000 + i, 500_000_000 if nano else 500_000, len(p), len(p)) + p
    return out


PACKETS = [
    packet(0x0100, []), packet(0x8180, [(5, 60, name("x.cdn.net")), (1, 30, bytes([1, 2, 3, 4]))]), packet(0x8583, []), packet(0x8180, [(1, 30, bytes([1, 2, 3, 4]))], cut=6),
    packet(0x8180, [(28, 5, b"\x20\x01\x0d\xb8" + b"\0" * 11 + b"\x01"), (16, 9, b'\x04"hi"')], qtype=65300), packet(0x8180, [], port=99)[:34] + struct.pack("!2H", 99, 98) + b"\0" * 30,
]


@pytest.mark.parametrize("end,nano,zipped", [("<", False, False), (">", True, True)])
def test_pcap(spark, tmp_path, end, nano, zipped):
    data = capture(PACKETS, end, nano)
    file = tmp_path / ("trace.20170301.00.pcap" + (".gz" if zipped else ""))
    file.write_bytes(gzip.compress(data) if zipped else data)
    (tmp_path / "bad.20170301.00.pcap").write_bytes(b"not a capture")
    rows = sorted(read(spark, tmp_path, "PCAP", "DNS"), key=lambda r: r["req_time"])
    assert len(rows) == 3
    a, b, c = rows
    assert (a["req_time"], a["s_ip"], a["s_port"], a["c_ip"], a["c_port"], a["trans_id"], a["query"], a["req_type"], a["req_class"], a["resp_code"]) == (1001.5, "8.8.8.8", 53, "10.0.0.1", 40000, "4711", "www.a.it.", "A", "IN", "NOERROR")
    assert a["answers"] == ["x.cdn.net.", "1.2.3.4"] and a["answer_types"] == ["CNAME", "A"] and a["answer_ttls"] == [60, 30] and a["flags_resp"] == 4 + 8
    assert b["resp_code"] == "NXDOMAIN" and b["flags_resp"] == 4 + 8 + 32 and b["answers"] == []
    assert c["req_type"] == "PRIVATE_USE" and c["answers"] == ["2001:db8::1", '\\x04""hi""'] and c["answer_types"] == ["AAAA", "TXT"]


def test_tstat_pcap(spark, tmp_path):
    file = tmp_path / "a/b/2017_03_02_x/c/udp_dns.pcap"
    file.parent.mkdir(parents=True)
    file.write_bytes(capture(PACKETS))
    assert len(read(spark, tmp_path, "TSTAT_PCAP", "DNS")) == 3


def test_registry_and_schema(spark):
    assert sorted((t, k) for t, kinds in SOURCES.items() for k in kinds) == [
        ("Bind", "DNS"), ("Bro", "DNS"), ("Bro", "HTTP"), ("Bro", "NamedFlows"), ("PCAP", "DNS"), ("Squid", "HTTP"), ("Squid", "NamedFlows"), ("TSTAT_PCAP", "DNS"), ("Tstat", "DNS"), ("Tstat", "HTTP"), ("Tstat", "NamedFlows"),
    ]
    with pytest.raises(ValueError, match="no source Bro/X"):
        read_table(spark, "Bro", "X", "/", "2017_03_01", "2017_03_01")
    assert len(days("2016_02_28", "2016_03_01")) == 3
    assert SOURCES["Squid"]["HTTP"].paths("/in", "2017_03_01", "2017_03_02") == ["/in/access.log-{20170301,20170302}"]
    df = spark.createDataFrame([(1,)], "c_port int")
    with pytest.raises(ValueError, match="not a DNS table"):
        validate(df, TableType.DNS)
    assert validate(conform(df, TableType.HTTP), TableType.HTTP).first().c_port == 1
    validate(df, TableType.ANY)
