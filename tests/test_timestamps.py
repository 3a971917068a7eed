"""The stamp normaliser against an independent parser and fixed cases."""

import datetime as dt
import itertools
import re
import zoneinfo

import pytest
from pyspark.sql import functions as F

from sluicelog.operators import timestamps
from sluicelog.plans import problems

EPOCH = dt.datetime(1970, 1, 1)
CLOCKS = ["%H:%M:%S", "%H:%M", "%I:%M:%S %p"]
DATES = ["%Y-%m-%d ", "%Y-%m-%dT", "%d/%b/%Y:", "%d-%b-%Y ", "%a, %d %b %Y "]


def micros(naive):
    return (naive - EPOCH) // dt.timedelta(microseconds=1)


def local_to_utc(naive, name):
    zone = zoneinfo.ZoneInfo(name)
    at = naive.replace(tzinfo=zone, fold=0)
    utc = at.astimezone(dt.UTC)
    back = utc.astimezone(zone).replace(tzinfo=None)
    return micros(utc.replace(tzinfo=None)) if back == naive else None


def brute(raw, zone, order):
    """Slow reading by strptime."""
    if raw is None:
        return None
    s = raw.strip(" \t\n\r\"'[](){}<>")
    lo, hi = micros(dt.datetime(2024, 1, 1)), micros(dt.datetime(2025, 1, 1))
    if m := re.fullmatch(r"(\d{1,19})(?:\.(\d+))?", s):
        for unit in (10**6, 10**3, 1, 0.001):
            us = int(m[1]) * unit + int(((m[2] or "") + "000000")[:6]) * unit // 10**6 if unit >= 1 else int(m[1]) // 1000
            if lo <= us < hi:
                return us
    named = None
    if m := re.search(r"\[([\w/+-]+)$", s):
        named, s = m[1], s[: m.start()]
    frac = 0
    if m := re.search(r"(?<=:\d\d)[.,](\d+)", s):
        frac, s = int((m[1] + "000000")[:6]), s[: m.start()] + s[m.end() :]
    offset = abbr = None
    asctime = re.fullmatch(r"[A-Z][a-z]{2} [A-Z][a-z]{2} +\d+ [\d:]+ \d{4}", s)
    if m := re.search(r" ?(?:\b(UTC|GMT|[Zz])|(?<=\d)[zZ])$", s):
        offset, s = 0, s[: m.start()]
    elif (m := re.search(r"(?<=:\d\d) ?([+-])(\d\d):?(\d\d)?$", s)) and not asctime:
        offset, s = (int(m[2]) * 3600 + int(m[3] or 0) * 60) * (-1 if m[1] == "-" else 1), s[: m.start()]
    elif (m := re.search(r" ([A-Z]{2,5})$", s)) and m[1] not in ("AM", "PM"):
        abbr, s = m[1], s[: m.start()]
    slash = "%d/%m/" if order == "dmy" else "%m/%d/"
    shapes = [d + c for d, c in itertools.product([*DATES, slash + "%Y ", slash + "%y "], CLOCKS)] + ["%a %b %d %H:%M:%S %Y"]
    if re.fullmatch(r"\d{14}", s):
        shapes = ["%Y%m%d%H%M%S"]
    if re.fullmatch(r"\d{8}T\d{6}", s):
        shapes = ["%Y%m%dT%H%M%S"]
    for shape in shapes:
        try:
            naive = dt.datetime.strptime(s, shape) + dt.timedelta(microseconds=frac)
        except ValueError:
            continue
        if abbr:
            for month in range(1, 13):
                at = dt.datetime(2024, month, 15, tzinfo=zoneinfo.ZoneInfo(zone))
                if at.tzname() == abbr:
                    offset = at.utcoffset().total_seconds()
            if offset is None:
                return None
        us = local_to_utc(naive, named or zone) if offset is None else micros(naive) - int(offset) * 10**6
        return us if us is not None and lo <= us < hi else None
    return None


def test_against_brute_force(spark, sf_dir):
    probes = {r.probe_id: (r.zone, r.date_order) for r in problems.table(spark, sf_dir, "probes").collect()}
    got = {(r.src, r.row_id): r.utc_us for r in problems.p3_stamps(spark, sf_dir).collect()}
    n = 0
    for src, column in (("http_intake", "req_time"), ("flow_intake", "time_start")):
        for r in problems.table(spark, sf_dir, src).select("row_id", "probe_id", column).collect():
            assert got[src, r.row_id] == brute(r[2], *probes[r.probe_id]), (r[2], probes[r.probe_id])
            n += 1
    assert n == len(got)


CASES = [
    ("2024-03-31 02:30:00", "Europe/Rome", "dmy", None),
    ("2024-10-27 02:30:00", "Europe/Rome", "dmy", "2024-10-27T00:30:00"),
    ("2024-10-27 02:30:00 CET", "Europe/Rome", "dmy", "2024-10-27T01:30:00"),
    ("2024-10-27 02:30:00 EST", "Europe/Rome", "dmy", None),
    ("2024-04-07 01:45:00", "Australia/Lord_Howe", "dmy", "2024-04-06T14:45:00"),
    ("2024-10-06 02:15:00", "Australia/Lord_Howe", "dmy", None),
    ("02/03/24 12:00:05 AM", "UTC", "mdy", "2024-02-03T00:00:05"),
    ("02/03/24 12:00:05 PM", "UTC", "dmy", "2024-03-02T12:00:05"),
    ("02/03/24 13:00:05 PM", "UTC", "dmy", None),
    ("30/02/2024 10:00:00", "UTC", "dmy", None),
    ("29/02/2024 23:59:59", "UTC", "dmy", "2024-02-29T23:59:59"),
    ("2024-06-01T24:00:00Z", "UTC", "dmy", None),
    ("2024-06-01T10:60:00Z", "UTC", "dmy", None),
    ("2024-06-01T10:00:00.123456789+05:45", "UTC", "dmy", "2024-06-01T04:15:00.123456"),
    ("2024-06-01", "UTC", "dmy", None),
    ("2024-06-01 10:00", None, "dmy", None),
    ("2024-06-01 10:00Z", None, None, "2024-06-01T10:00:00"),
    ("2024-06-01 10:00", "No/Where", "dmy", None),
    ("01/02/2024 10:00:00", "UTC", None, None),
    ("1717236000", "No/Where", None, "2024-06-01T10:00:00"),
    ("1717236000.5", "UTC", None, "2024-06-01T10:00:00.500000"),
    ("20240601100000", "Asia/Tokyo", None, "2024-06-01T01:00:00"),
    ("12345", "UTC", None, None),
    ("99999999999999999999999", "UTC", None, None),
    ("  \"[01/Jun/2024:10:00:00 +0000]\" ", "UTC", None, "2024-06-01T10:00:00"),
    ("", "UTC", "dmy", None),
    (None, "UTC", "dmy", None),
    ("1" * 100_000, "UTC", "dmy", None),
    ("x" * 100_000, "UTC", "dmy", None),
    (" " * 250 + "2024-06-01 10:00:00Z" + "\u3000" * 50_000, "UTC", "dmy", "2024-06-01T10:00:00"),
    ("2024-06-01 10:00:00." + "1" * 40_000 + "Z", "UTC", "dmy", "2024-06-01T10:00:00.111111"),
    ("1717236000." + "0" * 300, "UTC", "dmy", "2024-06-01T10:00:00"),
    ("02/03/24" + " " * 5_000 + "10:00:00", "UTC", "dmy", "2024-03-02T10:00:00"),
    ("2024-06-01 10:00:00 " + "[" * 30_000, "UTC", "dmy", None),
    (" " * 60_000, "UTC", "dmy", None),
    ("2024-06-01\x1f10:00:00", "UTC", "dmy", None),
    ("2024-06-01 10:00:00 [Europe/Rome]", "UTC", "dmy", "2024-06-01T08:00:00"),
    ("2024-06-01 10:00:00 [GMT]", "Europe/Rome", "dmy", "2024-06-01T10:00:00"),
    ("2024-06-01 10:00:00 EDT", None, "dmy", None),
]


def test_fixed_cases(spark):
    rows = [(i, *c[:3], "clash", "clash") for i, c in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "id int, raw string, zone string, date_order string, _s string, utc_us string")
    got = timestamps.normalise(df, 2024).collect()
    assert len(got) == len(rows)
    for r in got:
        want = CASES[r.id][3]
        assert r.utc_us == (want and micros(dt.datetime.fromisoformat(want))), CASES[r.id]


def files(path):
    return {str(x) for x in path.rglob("*.parquet")}


def test_dictionary_grows(spark, tmp_path):
    one = spark.createDataFrame([("1717236000", "UTC", "dmy")], "raw string, zone string, date_order string")
    timestamps.stamp_dictionary(one, 2024, str(tmp_path))
    first = files(tmp_path)
    both = one.unionByName(spark.createDataFrame([("junk", None, "dmy")], one.schema)).union(one)
    again = timestamps.stamp_dictionary(both, 2024, str(tmp_path))
    assert sorted((r.raw, r.utc_us) for r in again.collect()) == [("1717236000", 1717236000000000), ("junk", None)]
    new = files(tmp_path) - first
    assert first < files(tmp_path) and [r.raw for r in spark.read.parquet(*sorted(new)).collect()] == ["junk"]
    with_source = both.withColumn("source", F.lit("a"))
    assert timestamps.stamp_dictionary(with_source, 2024, str(tmp_path)).count() == 4
    assert timestamps.normalise(with_source, 2024, str(tmp_path)).where("utc_us IS NOT NULL").count() == 2


def test_second_run_parses_nothing(spark, sf_dir, tmp_path):
    stamps = problems._stamps(spark, sf_dir)
    n = timestamps.stamp_dictionary(stamps, 2024, str(tmp_path)).count()
    before = files(tmp_path)
    timestamps.stamp_dictionary(stamps, 2024, str(tmp_path))
    new = files(tmp_path) - before
    assert n > 0 and sum(spark.read.parquet(x).count() for x in new) == 0


@pytest.mark.parametrize("year", [2011, 2014])
def test_abbreviation_of_two_offsets(spark, year):
    """Moscow's MSK was three and four hours ahead in both years."""
    cases = [(f"{year}-01-20 12:00:00 MSK", "Europe/Moscow"), (f"{year}-07-20 12:00:00 MSK", "Europe/Moscow"), (f"{year}-12-20 12:00:00 MSK", "Europe/Moscow"), (f"{year}-10-26 01:30:00 MSK", "Europe/Moscow")]
    df = spark.createDataFrame([(i, *c, None) for i, c in enumerate(cases)], "id int, raw string, zone string, date_order string")
    got = {r.id: r.utc_us for r in timestamps.normalise(df, year).collect()}
    assert len(got) == timestamps.normalise(df, year).count() == len(cases)
    for i, (raw, zone) in enumerate(cases):
        assert got[i] == local_to_utc(dt.datetime.fromisoformat(raw[:19]), zone), raw


@pytest.mark.parametrize("rows", [[]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "raw string, zone string, date_order string, v int")
    assert timestamps.normalise(df, 2024).count() == 0
    assert "utc_us" in timestamps.normalise(df.withColumn("x", F.lit(1)), 2024).columns
