"""Expressions over addresses, and the longest-prefix match of addresses to networks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6() -> str:
    group = "[0-9A-Fa-f]{1,4}"
    last = rf"(?:{group}:{group}|(?:{IPV4}))"
    forms = [rf"(?:{group}:){{6}}{last}"]
    for tail in range(5, -1, -1):
        forms.append(rf"(?:(?:{group}:){{0,{5 - tail - 1}}}{group})?::(?:{group}:){{{tail}}}{last}" if tail < 5 else rf"::(?:{group}:){{5}}{last}")
    forms += [rf"(?:(?:{group}:){{0,5}}{group})?::{group}", rf"(?:(?:{group}:){{0,6}}{group})?::"]
    return "(?:" + "|".join(forms) + ")"


IPV6 = _ipv6()


def is_ipv4(ip: Column) -> Column:
    """Four decimal parts up to 255 (leading zeros allowed)."""
    return ip.rlike(rf"\A{IPV4}\z")


def is_ipv6(ip: Column) -> Column:
    """Any textual form of an IPv6 address, without zone or prefix length."""
    return ip.rlike(rf"\A{IPV6}\z")


def is_ip(ip: Column) -> Column:
    """Either kind of address."""
    return is_ipv4(ip) | is_ipv6(ip)


def ipv4_number(ip: Column) -> Column:
    """The address as a whole number, NULL if it is none."""
    parts = F.split(F.when(is_ipv4(ip), ip), r"\.")
    return sum((F.get(parts, F.lit(i)).cast("long") * F.lit(256 ** (3 - i)) for i in range(1, 4)), F.get(parts, F.lit(0)).cast("long") * F.lit(256**3))


def network_names(addresses: DataFrame, ip: str, prefixes: DataFrame) -> DataFrame:
    """The distinct ``ip`` with ``asn``, the number (as text) of the longest prefix that holds it.

    ``prefixes`` has ``prefix`` (``a.b.c.d/n``) and ``asn``. An address that no
    prefix holds gets its /16 network ``a.b.0.0``; loopback addresses and what
    is no IPv4 address keep their own text; NULL gives NULL. Each address meets
    only the prefix lengths in use (33 at most) by equality, so the prefixes
    may be a whole routing table.
    """
    parsed = prefixes.select(
        ipv4_number(F.substring_index("prefix", "/", 1)).alias("_net"), F.substring_index("prefix", "/", -1).cast("int").alias("_bits"), F.col("asn").cast("string").alias("_asn")
    ).where("_bits BETWEEN 0 AND 32 AND _net IS NOT NULL")
    mask = lambda number, bits: number - F.pmod(number, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(32) - bits))
    nets = parsed.groupBy(mask(F.col("_net"), F.col("_bits")).alias("_net"), "_bits").agg(F.min("_asn").alias("_asn"))
    single = addresses.select(F.col(ip).alias("_ip")).distinct()
    routed = single.withColumn("_number", F.when(~F.col("_ip").startswith("127.0."), ipv4_number(F.col("_ip"))))
    # one row: the lengths in use
    lengths = parsed.agg(F.coalesce(F.collect_set("_bits"), F.array().cast("array<int>"))).scalar()
    tries = routed.where("_number IS NOT NULL").select("_ip", "_number", F.explode(lengths).alias("_bits"))
    keyed = tries.select("_ip", mask(F.col("_number"), F.col("_bits")).alias("_net"), "_bits")
    best = keyed.join(nets, ["_net", "_bits"]).groupBy("_ip").agg(F.max_by("_asn", "_bits").alias("_asn"))
    own = F.concat(F.substring_index("_ip", ".", 2), F.lit(".0.0"))
    return routed.join(best, "_ip", "left").select(
        F.col("_ip").alias(ip), F.when(F.col("_number").isNull(), F.col("_ip")).otherwise(F.coalesce("_asn", own)).alias("asn")
    )
