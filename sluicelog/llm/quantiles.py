"""Percentiles from randomized compactor hierarchies (KLL sketches).

Each group's values pass a hierarchy of compactors: a full level is sorted and
every other value, from a random start, moves up with twice the weight. Spark's
own sketch aggregates do this in the JVM with partial sketches in the map
tasks; sketches merge level by level, over partitions, days or anything else.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Level size. The rank error of one percentile stays within about 2.3 / K ** 0.9 (0.4 % here) with 99 % confidence; below K values it is exact.
K = 1024


def sketch(df: DataFrame, keys: dict[str, Column], value: Column, k: int = K) -> DataFrame:
    """``keys, n, sketch`` of the whole-number values of each group; NULL values are not counted, groups without values are left out."""
    rows = df.select(*[c.alias(n) for n, c in keys.items()], value.cast("bigint").alias("_v")).where(F.col("_v").isNotNull())
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint("_v", k).alias("sketch"))


def merge(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches of the union of groups that agree in ``keys``."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def percentiles(sketches: DataFrame, keys: list[str], ranks: dict[str, float]) -> DataFrame:
    """``keys, n`` and one column a rank: the smallest kept value at or above that share of the values."""
    return sketches.select(*keys, "n", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(rank)).alias(name) for name, rank in ranks.items()])
