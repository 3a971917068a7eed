"""What the text sources share."""

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TableType, conform


def days(start: dt.date | str, end: dt.date | str) -> list[dt.date]:
    """Every day from start to end, both included; text is ``YYYY_MM_DD``."""
    first, last = (dt.datetime.strptime(d, "%Y_%m_%d").date() if isinstance(d, str) else d for d in (start, end))
    return [first + dt.timedelta(n) for n in range((last - first).days + 1)]


@dataclass(frozen=True)
class Source:
    """A kind of log: the table it gives, where a day's files lie, and how they are parsed.

    ``globs`` are below the input folder, with ``{days}`` for the days in
    ``day_format``; ``parse`` takes one DataFrame a glob. A source of text gets
    the column ``value`` without comment and empty lines, one of packets gets
    ``path`` and ``content``.
    """

    table: TableType
    day_format: str
    globs: tuple[str, ...]
    parse: Callable[..., DataFrame]
    binary: bool = False

    def paths(self, root: str, start: dt.date | str, end: dt.date | str) -> list[str]:
        """The globs for that range; only the named days are listed, which prunes all others."""
        wanted = "{" + ",".join(d.strftime(self.day_format) for d in days(start, end)) + "}"
        return [f"{root}/{g.replace('{days}', wanted)}" for g in self.globs]

    def read(self, spark: SparkSession, root: str, start: dt.date | str, end: dt.date | str) -> DataFrame:
        """The table of that range; its parsing is part of the scan's stage."""
        if self.binary:
            scans = [spark.read.format("binaryFile").load(p).select("path", "content") for p in self.paths(root, start, end)]
        else:
            scans = [spark.read.text(p) for p in self.paths(root, start, end)]
        return self.table_of(*scans)

    def table_of(self, *scans: DataFrame) -> DataFrame:
        """The table from already scanned files."""
        if not self.binary:
            scans = tuple(s.where((F.length("value") > 0) & ~F.col("value").startswith("#")) for s in scans)
        return conform(self.parse(*scans), self.table)
