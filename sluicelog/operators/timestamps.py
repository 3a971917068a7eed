"""Stamps in mixed formats, precisions and zones to UTC instants.

Raw strings repeat, so they are first reduced to a dictionary of distinct
(string, source, zone, day-month order) entries; each entry is parsed once by
expressions that run in the JVM. The dictionary lies in a folder: a run parses
and appends only the entries it lacks, then joins it back to the rows.
"""

import datetime as dt
import functools
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workdir import exists, temporary

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_US = 1_000_000
#: Offsets that an abbreviation may have in a zone in one year (two in all years since 1970).
MOST_OFFSETS = 3
#: Parts the extraction and stands in no stamp.
_SEP = "\x1f"
_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_OPENING, _CLOSING = _SPACE + "\"'[({<", _SPACE + "\"'])}>"

_MON = "([A-Za-z]{3})"
_DAY_NAME = "(?:[A-Za-z]{3,9},?[ ]+)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = "(?:[ ]*([AaPp])[Mm])?"
#: A zone by name in brackets, by offset, or by letters.
_ZONE = r"(?:[ ]*(?:\[([A-Za-z0-9_+/-]+)\]?|(?:UTC|GMT|utc|gmt)?([+-]\d{2}(?::?\d{2})?)|([A-Za-z]{1,5})))?"
_ZONE_PARTS = ("named", "offset", "letters")

#: Each shape's pattern, and what its groups hold.
_SHAPES = (
    (rf"(\d{{4}})-(\d{{2}})-(\d{{2}})[Tt ][ ]*{_CLOCK}{_ZONE}", ("y", "m", "d", "h", "mi", "s", "frac", *_ZONE_PARTS)),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]?((?:\d{{3}})+))?{_ZONE}", ("y", "m", "d", "h", "mi", "s", "frac", *_ZONE_PARTS)),
    (rf"{_DAY_NAME}(\d{{1,2}})[/ -]{_MON}[/ -](\d{{4}})[: Tt][ ]*{_CLOCK}{_HALF}{_ZONE}", ("d", "month", "y", "h", "mi", "s", "frac", "half", *_ZONE_PARTS)),
    (rf"{_DAY_NAME}{_MON}[ ]+(\d{{1,2}})[ ]+{_CLOCK}{_ZONE}[ ]+(\d{{4}})", ("month", "d", "h", "mi", "s", "frac", *_ZONE_PARTS, "y")),
    (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})[ ,Tt]+{_CLOCK}{_HALF}{_ZONE}", ("first", "second", "y", "h", "mi", "s", "frac", "half", *_ZONE_PARTS)),
)
_ANY = r"\A(?:" + "|".join(pattern for pattern, _ in _SHAPES) + r")\z"
_GROUPS = [part for _, parts in _SHAPES for part in parts]
_PARTS = list(dict.fromkeys(_GROUPS))
#: Each part is what the groups for it hold together: those of shapes that don't fit are empty.
_TO_PARTS = _SEP.join("".join(f"${i}" for i, x in enumerate(_GROUPS, 1) if x == part) for part in _PARTS)


@functools.cache
def zone_table(year: int) -> tuple[tuple[str, str, int], ...]:
    """(zone, abbreviation, offset in seconds) as used in that year by the zones of the public database."""
    rows = set()
    for name in zoneinfo.available_timezones():
        zone = zoneinfo.ZoneInfo(name)
        for month in range(1, 13):
            at = dt.datetime(year, month, 15, tzinfo=zone)
            rows.add((name, at.tzname() or "", int(at.utcoffset().total_seconds())))
    return tuple(sorted(rows))


def abbreviations(spark: SparkSession, year: int) -> DataFrame:
    """``zone, letters, offsets``: the offsets that an abbreviation has in a zone in that year, the greatest (whose instant is first) in front."""
    offsets: dict[tuple[str, str], set[int]] = {}
    for zone, letters, offset in zone_table(year):
        if letters.isalpha():
            offsets.setdefault((zone, letters), set()).add(offset)
    if max(map(len, offsets.values())) > MOST_OFFSETS:
        raise ValueError(f"an abbreviation stood for more than {MOST_OFFSETS} offsets in {year}")
    return spark.createDataFrame([(*k, sorted(v, reverse=True)) for k, v in offsets.items()], "zone string, letters string, offsets array<int>")


def _int(x: Column) -> Column:
    return F.when(x != "", x.cast("int"))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a civil date of the proleptic Gregorian calendar, by whole numbers."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((153 * F.pmod(m + 9, F.lit(12)) + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def _month_days(y: Column, m: Column) -> Column:
    leap = (F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0))
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def _parts(s: Column) -> Column:
    """The parts of a stamp of any shape in one run of the pattern, else an array of one."""
    return F.split(F.regexp_replace(s, _ANY, _TO_PARTS), _SEP)


def _epoch(s: Column, low: int, high: int) -> Column:
    """Microseconds of a bare number in whichever unit falls into [low, high), digits beyond cut off."""
    whole, frac = F.substring_index(s, ".", 1), F.substring_index(s, ".", -1)
    rest = F.translate(s, "0123456789", "")
    number = ((rest == "") & F.length(s).between(1, 19)) | ((rest == ".") & F.length(whole).between(1, 19) & (F.length(frac) > 0))
    n, digits = whole.try_cast("bigint"), F.rpad(F.when(rest == ".", frac).otherwise(""), 6, "0")
    seconds = F.when(n < 10**12, n * _US + F.substring(digits, 1, 6).cast("bigint"))
    millis = F.when(n < 10**15, n * 1000 + F.substring(digits, 1, 3).cast("bigint"))
    tries = [F.when((us >= low) & (us < high), us) for us in (seconds, millis, n, F.call_function("div", n, F.lit(1000).cast("bigint")))]
    return F.when(number, F.coalesce(*tries))


def _bare(raw: Column) -> Column:
    """The stamp without what surrounds it. A long one has its runs of digits and blanks shortened to what can matter; no stamp stays long."""
    bare = F.rtrim(F.ltrim(raw, F.lit(_OPENING)), F.lit(_CLOSING))
    short = F.regexp_replace(F.regexp_replace(bare, r"(\d{20})(?:\d{3})+(?!\d{3})", "$1"), "[ ]{2,}", " ")
    return F.when(F.length(bare) <= 100, bare).when(F.length(short) <= 200, short)


def parse_stamps(entries: DataFrame, year: int) -> DataFrame:
    """``entries`` (raw, zone, date_order and any other columns) with ``utc_us``, NULL where the stamp denotes no instant of ``year``.

    Defined results: white space, quotes and brackets around a stamp are
    ignored; digits finer than microseconds are cut off; missing seconds are 0;
    a stamp without offset, zone name or abbreviation is local to the entry's
    zone; a local time that occurs twice is the first; an abbreviation that
    stood for two offsets in the year has the one valid at that local time, the
    first of two; a local time that was skipped, an impossible date or time, an
    abbreviation that the entry's zone does not use, an unknown or NULL zone
    where one is needed, an all-numeric date with an unknown day-month order,
    and a NULL give NULL.
    """
    columns = [c for c in entries.columns if c != "utc_us"]
    low = int(dt.datetime(year, 1, 1, tzinfo=dt.UTC).timestamp()) * _US
    high = int(dt.datetime(year + 1, 1, 1, tzinfo=dt.UTC).timestamp()) * _US
    zones = sorted(zoneinfo.available_timezones())
    order = F.col("date_order")
    step = entries.select(*columns, _bare(F.col("raw")).alias("_s")).withColumn("_epoch", _epoch(F.col("_s"), low, high))
    step = step.withColumn("_f", F.when(F.col("_epoch").isNull() & ~F.col("_s").contains(_SEP), _parts(F.col("_s"))))

    step = step.withColumn("_p", F.when(F.size("_f") == len(_PARTS), F.col("_f")))
    p = lambda name: F.col("_p")[_PARTS.index(name)]
    month = F.try_element_at(F.create_map(*[x for i, name in enumerate(MONTHS, 1) for x in (F.lit(name), F.lit(i))]), F.lower(p("month")))
    first, second, year_no = _int(p("first")), _int(p("second")), _int(p("y"))
    date = F.struct(
        F.when((p("first") != "") & (F.length(p("y")) == 2), year_no + 2000).otherwise(year_no).alias("y"),
        F.when(p("first") != "", F.when(order == "mdy", first).when(order == "dmy", second)).when(p("month") != "", month).otherwise(_int(p("m"))).alias("m"),
        F.when(p("first") != "", F.when(order == "mdy", second).when(order == "dmy", first)).otherwise(_int(p("d"))).alias("d"),
        _int(p("h")).alias("h"), _int(p("mi")).alias("mi"), F.coalesce(_int(p("s")), F.lit(0)).alias("s"), F.lower(p("half")).alias("half"),
    )
    step = step.withColumn("_d", F.when(F.col("_p").isNotNull(), date))
    d = lambda name: F.col(f"_d.{name}")
    hour = F.when(d("half") == "", d("h")).when(d("h").between(1, 12), F.pmod(d("h"), F.lit(12)) + F.when(d("half") == "p", 12).otherwise(0))
    ok = d("m").between(1, 12) & (d("d") >= 1) & (d("d") <= _month_days(d("y"), d("m"))) & hour.between(0, 23) & d("mi").between(0, 59) & d("s").between(0, 59)
    clock = _days(d("y"), d("m"), d("d")) * 86400 + hour * 3600 + d("mi") * 60 + d("s")
    step = step.withColumn("_local", F.when(ok, clock.cast("bigint") * _US + F.substring(F.rpad(p("frac"), 6, "0"), 1, 6).cast("bigint")))
    digits = F.translate(p("offset"), ":", "")
    hours, minutes = _int(F.substring(digits, 2, 2)), F.coalesce(_int(F.substring(digits, 4, 2)), F.lit(0))
    signed = (hours * 3600 + minutes * 60) * F.when(digits.startswith("-"), -1).otherwise(1)
    universal = F.upper(p("letters")).isin("Z", "UTC", "GMT") | F.upper(p("named")).isin("UTC", "GMT")
    step = step.withColumn("_offset", F.when(universal, 0).when((p("offset") != "") & (hours <= 18) & (minutes <= 59), signed))
    step = step.withColumn("letters", F.when(~universal & (F.length(p("letters")) >= 2), F.upper(p("letters"))))
    name = F.when((p("offset") == "") & (p("letters") == ""), F.when(p("named") == "", F.col("zone")).otherwise(p("named")))
    step = step.withColumn("_name", F.when(F.col("_offset").isNull() & name.isin(*zones), name))
    # bounded by the zone database: about a thousand rows, one for each zone and abbreviation
    step = step.join(F.broadcast(abbreviations(entries.sparkSession, year)), ["zone", "letters"], "left")
    wall = F.timestamp_micros("_local")
    micros = lambda offset: F.col("_local") - offset.cast("bigint") * _US
    few = [F.get("offsets", F.lit(i)) for i in range(MOST_OFFSETS)]
    valid = [F.when(F.from_utc_timestamp(F.timestamp_micros(micros(x)), F.coalesce("zone", F.lit("UTC"))) == wall, x) for x in few]
    abbreviated = F.when(F.size("offsets") == 1, few[0]).when(F.size("offsets") > 1, F.coalesce(*valid))
    there = F.to_utc_timestamp(wall, F.coalesce("_name", F.lit("UTC")))
    unskipped = F.from_utc_timestamp(there, F.coalesce("_name", F.lit("UTC"))) == wall
    instant = F.when(F.col("_offset").isNotNull() | F.col("letters").isNotNull(), micros(F.coalesce("_offset", abbreviated))).when(F.col("_name").isNotNull() & unskipped, F.unix_micros(there))
    us = F.coalesce("_epoch", instant)
    return step.select(*columns, F.when((us >= low) & (us < high), us).alias("utc_us"))


_KEYS = ["raw", "source", "zone", "date_order"]
_SCHEMA = "raw string, source string, zone string, date_order string, utc_us long"


def _keyed(stamps: DataFrame) -> list[Column]:
    """The dictionary's key of a row: a missing source, zone or order is an empty one."""
    return [F.col("raw"), *[F.coalesce(F.col(c).cast("string") if c in stamps.columns else F.lit(None), F.lit("")).alias(c) for c in _KEYS[1:]]]


def stamp_dictionary(stamps: DataFrame, year: int, path: str) -> DataFrame:
    """The dictionary at ``path`` after the distinct (raw, source, zone, date_order) of ``stamps`` it lacked were parsed and appended.

    An entry that two runs appended at the same time is there twice, alike, and
    read once. Of one year only: the folder is named for it.
    """
    spark = stamps.sparkSession
    path = f"{path.rstrip('/')}/year={year}"
    entries = stamps.where(F.col("raw").isNotNull()).select(*_keyed(stamps)).distinct()
    if exists(spark, path):
        entries = entries.join(spark.read.schema(_SCHEMA).parquet(path), _KEYS, "left_anti")
    parse_stamps(entries, year).select(*_KEYS, "utc_us").write.mode("append").parquet(path)
    return spark.read.schema(_SCHEMA).parquet(path).groupBy(*_KEYS).agg(F.max("utc_us").alias("utc_us"))


def normalise(stamps: DataFrame, year: int, path: str | None = None) -> DataFrame:
    """``stamps`` (raw, zone, date_order, perhaps source, and any other columns) with ``utc_us``, which replaces a column of that name.

    Every row comes back once, repeated or not; see ``parse_stamps`` for what
    gives NULL. An empty table gives an empty one. ``path`` is the folder of a
    dictionary that lasts; without one it is written anew to the shared folder.
    Entries are parsed when this is called.
    """
    stamps = stamps.drop("utc_us")
    entries = stamp_dictionary(stamps, year, path or temporary(stamps.sparkSession, "stamps")).where("utc_us IS NOT NULL")
    marked = stamps.withColumns({f"_key_{c}": k for c, k in zip(_KEYS, _keyed(stamps), strict=True)})
    named = entries.select(*[F.col(c).alias(f"_key_{c}") for c in _KEYS], "utc_us")
    return marked.join(named, [f"_key_{c}" for c in _KEYS], "left").select(*stamps.columns, "utc_us")
