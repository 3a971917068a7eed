"""The sources by tool and table."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from . import bind, bro, pcap, squid, tstat
from .lines import Source

SOURCES: dict[str, dict[str, Source]] = {
    "Tstat": {"DNS": tstat.TSTAT_DNS, "NamedFlows": tstat.TSTAT_FLOWS, "HTTP": tstat.TSTAT_HTTP},
    "Bro": {"DNS": bro.BRO_DNS, "HTTP": bro.BRO_HTTP, "NamedFlows": bro.BRO_FLOWS},
    "Squid": {"HTTP": squid.SQUID_HTTP, "NamedFlows": squid.SQUID_FLOWS},
    "Bind": {"DNS": bind.BIND_DNS},
    "PCAP": {"DNS": pcap.PCAP_DNS},
    "TSTAT_PCAP": {"DNS": pcap.TSTAT_PCAP_DNS},
}


def source(tool: str, table: str) -> Source:
    """The source, or an error that names those there are."""
    try:
        return SOURCES[tool][table]
    except KeyError:
        known = ", ".join(f"{t}/{k}" for t, kinds in SOURCES.items() for k in kinds)
        raise ValueError(f"no source {tool}/{table}; there are {known}") from None


def read_table(spark: SparkSession, tool: str, table: str, path: str, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """The table of all days from start to end (``YYYY_MM_DD``), both included."""
    return source(tool, table).read(spark, path, start, end)
