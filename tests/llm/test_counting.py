"""Pairs, distinct counts and percentiles: SQL twins on the tables, brute force on small cases."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from sluicelog.llm import cooccurrence, distinct, quantiles
from sluicelog.llm import queries as llm_queries


@pytest.mark.parametrize("name", sorted(llm_queries.SQL))
def test_sql(spark, sf_dir, name):
    n = same(llm_queries.QUERIES[name](spark, sf_dir), llm_queries.SQL[name], sf_dir)
    assert n or name in ("p1_found", "p1_pairs")


def test_all_pairs(spark, sf_dir):
    counts = llm_queries.p1_counts(spark, sf_dir).select("n_ab").collect()
    assert min(r.n_ab for r in counts) == 1 and sum(r.n_ab < 20 for r in counts) > len(counts) / 2


@pytest.mark.parametrize("block_rows,split_items", [(7, 3), (100, 5), (10**6, 10**6), (10**6, 1)])
def test_pairs(spark, block_rows, split_items):
    rng = random.Random(block_rows)
    rows = [(rng.choice([None, *"xyz"]), rng.randint(1, 9), rng.choice([None, *"abcdefgh"]), "clash") for _ in range(900)] + [("w", 1, c, "") for c in "abcdefghijklmnop"]
    df = spark.createDataFrame(rows, "u string, d int, item string, n_ab string")
    got = {(r.name_a, r.name_b): (r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in cooccurrence.pair_counts(df, [df.u, df.d], df["item"], 3, block_rows, split_items).collect()}
    baskets = {}
    for u, d, item, _ in rows:
        if item is not None:
            baskets.setdefault((u, d), set()).add(item)
    single = Counter(x for b in baskets.values() for x in b)
    pairs = Counter(p for b in baskets.values() for p in itertools.combinations(sorted(b), 2))
    assert got == {p: (n, single[p[0]], single[p[1]], len(baskets)) for p, n in pairs.items() if n >= 3}
    assert cooccurrence.pair_counts(df.limit(0), [df.u], df["item"], 1).count() == 0


@pytest.mark.parametrize("products", [1, 37, 10**6])
def test_gram_block(products):
    rng = np.random.default_rng(products)
    matrix = rng.random((60, 40)) < 0.2
    record, item = np.nonzero(matrix)
    a, b, n = (np.concatenate(x) for x in zip(*cooccurrence.gram_block(record, item * 1000, products), strict=True))
    gram = matrix.T.astype(int) @ matrix
    want = {(i * 1000, j * 1000): gram[i, j] for i in range(40) for j in range(i + 1, 40) if gram[i, j]}
    got = Counter()
    for i, j, c in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
        got[i, j] += c  # an item's products may be spread over strips
    assert got == want


def test_sides(spark):
    record = np.array([0] * 6 + [1] * 3)
    item, side = np.array([5, 1, 9, 2, 8, 7, 1, 2, 3]), np.array([0, 0, 0, 1, 1, 1, 0, 0, 0])
    a, b, n = (np.concatenate(x) for x in zip(*cooccurrence.gram_block(record, item, 4, side), strict=True))
    assert Counter({(i, j): c for i, j, c in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)}) == Counter((min(x, y), max(x, y)) for x in (5, 1, 9) for y in (2, 8, 7))


def test_one_basket_of_very_many_items(spark):
    """A third of all rows in one basket: its product is spread, and no task holds the basket."""
    big = spark.range(100_000).selectExpr("'hot' AS basket", "id AS item")
    rest = spark.range(200_000).selectExpr("CAST(id DIV 4 AS STRING) AS basket", "IF(id % 4 < 2, id % 4, 1000 + id * 7 % 2500) AS item")
    df = big.union(rest)
    got = cooccurrence.pair_counts(df, [df.basket], df["item"], 3)
    want = df.join(df.groupBy("item").count().where("count >= 3").select("item"), "item")
    pairs = want.alias("x").join(want.alias("y"), F.expr("x.basket = y.basket AND x.item < y.item AND x.item IN (0, 1)")).groupBy("x.item", "y.item").count().where("count >= 3")
    low = got.where("name_a IN ('0', '1') OR name_b IN ('0', '1')").selectExpr("least(int(name_a), int(name_b)) AS a", "greatest(int(name_a), int(name_b)) AS b", "n_ab")
    assert sorted(map(tuple, low.collect())) == sorted(map(tuple, pairs.collect())) and got.where("name_a = '0' AND name_b = '1'").first().n_ab == 50_001


def test_lift_bound(spark):
    pairs = spark.createDataFrame([("a", "b", 8, 10, 10, 100), ("a", "c", 7, 10, 10, 100), ("a", "d", 2**40, 2**41, 2**41, 2**45)], "name_a string, name_b string, n_ab long, n_a long, n_b long, n_baskets long")
    assert [r.name_b for r in cooccurrence.lifted(pairs, 8).collect()] == ["b", "d"]


def test_sketches(spark):
    df = spark.range(60_000).selectExpr("id % 20000 AS v", "IF(id % 3 = 0, NULL, id % 2) AS g", "IF(id < 40000, 'hot', IF(id < 40010, 'tiny', NULL)) AS h", "'x' AS hash").repartition(5)
    k = 256
    base = distinct.sketch(df, {"g": df.g, "h": df.h}, {"v": df.v, "none": F.lit(None).cast("string")}, k=k, take=5_000, hold=300)
    assert base.agg(F.max(F.size("hashes"))).first()[0] <= k and base.groupBy("g", "h", "counted").count().agg(F.max("count")).first()[0] == 1
    true = {(r.g, r.h): r.n for r in df.groupBy("g", "h").agg(F.countDistinct("v").alias("n")).collect()}
    got = distinct.estimate(base, ["g", "h"], k).collect()
    assert {(r.g, r.h) for r in got} == set(true) and len(got) == 2 * len(true)
    for r in got:
        n = true[r.g, r.h] if r.counted == "v" else 0
        assert abs(r.estimate - n) <= 4 * n / (k - 2) ** 0.5 * (n >= k) and r.lower <= r.estimate <= r.upper
    sets = distinct.grouping_sets(base, ["g", "h"], [["g"], ["h"], []], k)
    for r in distinct.estimate(sets, ["level", "g", "h"], k).where("counted = 'v'").collect():
        side = df if r.level == 0 else df.where(F.col("g").eqNullSafe(r.g)) if r.level == 2 else df.where(F.col("h").eqNullSafe(r.h))
        n = side.select("v").distinct().count()
        assert abs(r.estimate - n) <= 4 * n / (k - 2) ** 0.5 * (n >= k)


def test_merging_equals_sketching_at_once(spark):
    df = spark.range(30_000).selectExpr("id % 7000 AS v", "id % 10 AS day").repartition(6)
    k = 128
    once = distinct.sketch(df, {"one": F.lit(1)}, {"v": df.v}, k)
    merged = distinct.merge(distinct.sketch(df, {"one": F.lit(1), "day": df.day}, {"v": df.v}, k), ["one"], k)
    assert once.first().hashes == merged.first().hashes and len(once.first().hashes) == k and once.count() == merged.count() == 1


@pytest.mark.parametrize("sizes", [(60, 40, 20), (30_000, 20_000, 9_000)])
def test_set_measures(spark, sizes):
    a, b, both = sizes
    df = spark.range(a).selectExpr("id AS v", "'a' AS s").union(spark.range(a - both, a - both + b).selectExpr("id AS v", "'b' AS s")).union(spark.range(5).selectExpr("id AS v", "'c' AS s"))
    sk = distinct.sketch(df, {"s": df.s}, {"v": df.v}, 1024)
    side = lambda s, c: sk.where(F.col("s") == s).select("counted", F.col("hashes").alias(c))
    pairs = side("a", "x").join(side("b", "y"), "counted")
    got = {r.measure: r for r in distinct.compare(pairs, "x", "y", ["counted"], 1024, 4.0).collect()}
    alone = {r.measure: r.estimate for r in distinct.compare(pairs.withColumn("z", F.lit(None).cast("array<bigint>")), "x", "z", [], 1024).collect()}
    assert alone["union"] == alone["only_a"] > 0 and alone["both"] == alone["only_b"] == 0
    for name, n in {"union": a + b - both, "both": both, "only_a": a - both, "only_b": b - both}.items():
        assert got[name].lower <= n <= got[name].upper, (name, n, got[name])
        if a < 1024:
            assert got[name].estimate == n


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v string")
    base = distinct.sketch(df, {"g": df.g}, {"v": df.v})
    assert base.count() == 0 and distinct.estimate(base, ["g"]).count() == 0
    long = spark.createDataFrame([("g", "x" * 200_000), ("g", "x" * 200_000), ("g", "")], "g string, v string")
    assert distinct.estimate(distinct.sketch(long, {"g": long.g}, {"v": long.v}), ["g"]).first().estimate == 2


def test_percentiles(spark):
    df = spark.range(200_000).selectExpr("pmod(xxhash64(id), 1000003) AS v", "IF(id % 3 = 0, NULL, id % 2) AS g", "id % 5 AS day", "1 AS n").repartition(7)
    daily = quantiles.sketch(df, {"g": df.g, "day": df.day}, df.v, 256)
    got = quantiles.percentiles(quantiles.merge(daily, ["g"], 256), ["g"], {"p5": 0.05, "p50": 0.5, "p99": 0.99}).collect()
    assert len(got) == 3 and sum(r.n for r in got) == 200_000
    for r in got:
        values = np.sort([x.v for x in df.where(F.col("g").eqNullSafe(r.g)).select("v").collect()])
        for name, rank in (("p5", 0.05), ("p50", 0.5), ("p99", 0.99)):
            assert abs(np.searchsorted(values, r[name]) / len(values) - rank) < 0.025


def test_percentiles_small(spark):
    df = spark.createDataFrame([("a", 5), ("a", 1), ("a", None), ("a", 3), ("b", None), (None, 7), (None, 7)], "g string, v int")
    got = {r.g: (r.n, r.p50) for r in quantiles.percentiles(quantiles.sketch(df, {"g": df.g}, df.v), ["g"], {"p50": 0.5}).collect()}
    assert got == {"a": (3, 3), None: (2, 7)}
    assert quantiles.sketch(df.limit(0), {"g": df.g}, df.v).count() == 0
