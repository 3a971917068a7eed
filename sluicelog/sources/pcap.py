"""DNS responses in packet captures (classic libpcap files, also gzipped), decoded with nothing but ``struct``."""

import gzip
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schema import DNS, TableType
from ..session import ship
from .lines import Source

#: Names of response codes, types and classes.
RCODES = {
    0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED", 6: "YXDOMAIN", 7: "YXRRSET", 8: "NXRRSET", 9: "NOTAUTH", 10: "NOTZONE", 16: "BADVERS/BADSIG", 17: "BADKEY",
    18: "BADTIME", 19: "BADMODE", 20: "BADNAME", 21: "BADALG", 22: "BADTRUNC", 23: "BADCOOKIE", 65535: "RESERVED",
}
TYPES = {
    0: "ANY", 1: "A", 2: "NS", 3: "MD", 4: "MF", 5: "CNAME", 6: "SOA", 7: "MB", 8: "MG", 9: "MR", 10: "NULL", 11: "WKS", 12: "PTR", 13: "HINFO", 14: "MINFO", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB", 28: "AAAA",
    33: "SRV", 38: "A6", 39: "DNAME", 41: "OPT", 43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 50: "NSEC3", 51: "NSEC3PARAM", 52: "TLSA", 53: "SMIMEA", 59: "CDS", 60: "CDNSKEY", 61: "OPENPGPKEY",
    62: "CSYNC", 104: "NID", 105: "L32", 106: "L64", 107: "LP", 108: "EUI48", 109: "EUI64", 251: "IXFR", 252: "AXFR", 253: "MAILB", 254: "MAILA", 255: "*", 256: "URI", 257: "CAA", 258: "AVC", 65535: "RESERVED",
}
CLASSES = {0: "RESERVED", 1: "IN", 2: "CS", 3: "CH", 4: "HS", 254: "NONE", 255: "ANY", 65535: "RESERVED"}
_ETHERNET, _RAW, _LINUX = 1, 101, 113
_NAMED = {"NS", "CNAME", "PTR", "DNAME"}


def code_name(code: int, names: dict[int, str], reserved: range = range(0), private: range = range(65280, 65535)) -> str:
    """A code's name, or the kind of range that it lies in."""
    return names.get(code) or ("RESERVED" if code in reserved else "PRIVATE_USE" if code in private else "UNASSIGNED")


def rcode_name(code: int) -> str:
    """A response code's name."""
    return code_name(code, RCODES, range(3841, 4096), range(0))


def _shown(data: bytes) -> str:
    return "".join(chr(b) if 32 <= b < 127 and b != 92 else "\\\\" if b == 92 else f"\\x{b:02x}" for b in data).replace('"', '""')


def _name(message: bytes, at: int) -> tuple[str, int]:
    """The dotted name at an offset, following compression, and the offset behind it."""
    labels, after, hops = [], None, 0
    while True:
        n = message[at]
        if n >= 192:
            after = at + 2 if after is None else after
            at = (n & 63) << 8 | message[at + 1]
            hops += 1
            if hops > 128:
                raise ValueError("looping name")
        elif n:
            labels.append(_shown(message[at + 1 : at + 1 + n]))
            if len(labels[-1]) < n:
                raise ValueError("short name")
            at += 1 + n
        else:
            return ".".join(labels) + ".", at + 1 if after is None else after


def _data(message: bytes, kind: str, at: int, size: int) -> str:
    raw = message[at : at + size]
    if len(raw) < size:
        raise ValueError("short record")
    if kind == "A" and size == 4:
        return ".".join(map(str, raw))
    if kind == "AAAA" and size == 16:
        import ipaddress

        return str(ipaddress.IPv6Address(raw))
    if kind in _NAMED:
        return _name(message, at)[0]
    return _shown(raw)


def _response(message: bytes) -> dict | None:
    """The fields of a DNS response, None for anything else."""
    ident, flags, questions, answers = struct.unpack_from("!4H", message)
    if not flags >> 15:
        return None
    at, out = 12, {"trans_id": str(ident), "query": None, "req_type": None, "req_class": None}
    for i in range(questions):
        query, at = _name(message, at)
        kind, klass = struct.unpack_from("!2H", message, at)
        at += 4
        if not i:
            out |= {"query": query, "req_type": code_name(kind, TYPES), "req_class": code_name(klass, CLASSES)}
    bit = lambda i, to: (flags >> i & 1) << to
    records = []
    for _ in range(answers):
        _, at = _name(message, at)
        kind, _, ttl, size = struct.unpack_from("!2HIH", message, at)
        name = code_name(kind, TYPES)
        records.append((_data(message, name, at + 10, size), name, ttl))
        at += 10 + size
    out |= {"flags_req": None, "flags_resp": bit(7, 2) | bit(8, 3) | bit(9, 4) | bit(10, 5), "resp_code": rcode_name(flags & 15)}
    return out | {"answers": [r[0] for r in records], "answer_types": [r[1] for r in records], "answer_ttls": [r[2] for r in records]}


def _datagram(frame: bytes, link: int) -> tuple[str, int, str, int, bytes] | None:
    """Source, destination and payload of a whole UDP datagram over IPv4."""
    at, kind = {_ETHERNET: (14, 12), _LINUX: (16, 14), _RAW: (0, None)}[link]
    if kind is not None:
        proto = struct.unpack_from("!H", frame, kind)[0]
        while proto == 0x8100:
            at, kind = at + 4, kind + 4
            proto = struct.unpack_from("!H", frame, kind)[0]
        if proto != 0x0800:
            return None
    if frame[at] >> 4 != 4 or frame[at + 9] != 17 or struct.unpack_from("!H", frame, at + 6)[0] & 0x1FFF:
        return None
    dot = lambda i: ".".join(map(str, frame[i : i + 4]))
    udp = at + (frame[at] & 15) * 4
    source, target, size = struct.unpack_from("!3H", frame, udp)
    return dot(at + 12), source, dot(at + 16), target, frame[udp + 8 : udp + size]


def read_capture(content: bytes) -> Iterator[dict]:
    """DNS rows of a capture; packets that are cut off or no DNS are passed over, as is what follows a broken header."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    order = {b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e9), b"\x4d\x3c\xb2\xa1": ("<", 1e9)}.get(content[:4])
    if not order or len(content) < 24:
        return
    end, unit = order
    link, at = struct.unpack_from(end + "I", content, 20)[0], 24
    while at + 16 <= len(content):
        seconds, parts, size, _ = struct.unpack_from(end + "4I", content, at)
        frame, at = content[at + 16 : at + 16 + size], at + 16 + size
        try:
            found = _datagram(frame, link)
            if not found or 53 not in (found[1], found[3]):
                continue
            row = _response(found[4])
        except (struct.error, IndexError, ValueError, KeyError):
            continue
        if row:
            when = seconds + parts / unit
            yield row | {"req_time": when, "resp_time": when, "s_ip": found[0], "s_port": found[1], "c_ip": found[2], "c_port": found[3]}


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for row in read_capture(bytes(content)):
                rows.append(row)
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=DNS.names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=DNS.names)


def _dns(files: DataFrame) -> DataFrame:
    """The client is the response's receiver. A file is decoded by one task, packets leave it in batches."""
    ship(SparkSession.active())
    return files.select("content").mapInPandas(_decode, DNS)


PCAP_DNS = Source(TableType.DNS, "%Y%m%d", ("*.{days}.*.*",), _dns, binary=True)
TSTAT_PCAP_DNS = Source(TableType.DNS, "%Y_%m_%d", ("*/*/{days}*/*/udp_dns.pcap*",), _dns, binary=True)
