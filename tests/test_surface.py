"""Every registered query against its SQL twin; those without one must run and give rows."""

import importlib.util

import pytest
from oracle import same

from sluicelog.plans import analytics, catalogue, logs, surface

PARTS = [surface, analytics, logs]
#: Cases too rare for the smallest tables, covered by fixtures.
MAY_BE_EMPTY = {"resolver_suspicious", "resolver_anomalies"}


@pytest.mark.parametrize("name", [n for p in PARTS for n in p.QUERIES])
def test_query(spark, sf_dir, name):
    part = next(p for p in PARTS if name in p.QUERIES)
    df = part.QUERIES[name](spark, sf_dir)
    n = same(df, part.SQL[name], sf_dir) if name in part.SQL else df.count()
    assert n > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", ["src_bind_dns", "src_squid_combined"])
def test_times_do_not_depend_on_the_session(spark, sf_dir, name):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert same(logs.QUERIES[name](spark, sf_dir), logs.SQL[name], sf_dir) > 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_entry_points(spark):
    spec = importlib.util.spec_from_file_location("entry", "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(n for p in catalogue.MODULES for n in p.QUERIES) <= set(queries)
    assert entry.entry(spark).count() > 0
