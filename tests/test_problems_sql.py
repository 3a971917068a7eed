"""Sessions and heavy keys: SQL twins on the tables, brute force on small cases."""

import random

import pytest
from oracle import same

from sluicelog.functions.names import plain_form
from sluicelog.operators import sessions, skew
from sluicelog.plans import problems


@pytest.mark.parametrize("name", sorted(problems.SQL))
def test_sql(spark, sf_dir, name):
    assert same(problems.QUERIES[name](spark, sf_dir), problems.SQL[name], sf_dir) > 0


def brute_sessions(events, gap):
    out = []
    for key in {k for k, _ in events}:
        times = sorted(t for k, t in events if k == key and t is not None)
        no = 0
        for i, t in enumerate(times):
            if i == 0 or t - times[i - 1] > gap:
                no += 1
                out.append([key, no, t, t, 0])
            out[-1][3], out[-1][4] = t, out[-1][4] + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_sessions_brute(spark, seed):
    rng = random.Random(seed)
    gap = rng.choice([1, 7, 1000])
    events = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([None, *[rng.randint(-20 * gap, 60 * gap) for _ in range(12)]])) for _ in range(400)]
    events += [("edge", x) for x in (0, gap, 2 * gap + 1, 2 * gap + 1, 3 * gap, 10 * gap)]
    df = spark.createDataFrame([(k, t, "x") for k, t in events], "key string, time_ms long, slot string")
    got = sorted(map(tuple, sessions.sessionize(df, gap).collect()), key=str)
    assert got == brute_sessions(events, gap)


def test_sessions_empty(spark):
    assert sessions.sessionize(spark.createDataFrame([], "key string, time_ms long"), 5).count() == 0
    with pytest.raises(ValueError):
        sessions.sessionize(spark.createDataFrame([], "key string, time_ms long"), 0)


def test_distinct_events_tell_nulls_apart(spark):
    rows = [("a", 1.0, None, 5), ("a", 1.0, 5, None), ("a", 1.0, 5, None), (None, 1.0, 5, None)]
    df = spark.createDataFrame(rows, "k string, t double, x int, y int")
    assert sessions.distinct_events(df, "k", df.t * 1000, ["k", "t", "x", "y"]).count() == 3


def test_heavy_keys(spark):
    rows = [("A. ",)] * 3 + [("a",)] * 2 + [(None,), ("-",), ("",), (" ",), ("b",)] + [("x" * 50_000,)]
    df = spark.createDataFrame([(r[0], "f") for r in rows], "name string, field string")
    counts = skew.per_key(df, {"n": plain_form(df.name)})
    assert {r.key_value: r.n_rows for r in counts.collect()} == {"a": 5, None: 4, "b": 1, "x" * 50_000: 1}
    assert {r.key_value for r in skew.heavy_keys(counts, 454).collect()} == {"a"}
    assert skew.heavy_keys(counts, 455).count() == 0
    assert skew.heavy_keys(skew.per_key(df.limit(0), {"n": df.name}), 1).count() == 0
