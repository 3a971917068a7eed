"""Distinct counts by the k smallest hash values of each group.

A sketch is one row: the group's columns, ``counted`` and ``hashes``, sorted. A
group with fewer than k different hashes holds them all, its count is exact;
else the k-th smallest hash, as a share U of the hash range, gives (k - 1) / U
with a relative standard error of at most 1 / sqrt(k - 2). Sketches merge by
keeping the smallest k of both, and the smaller of two sketches' bounds lets
intersections and differences be counted.
"""

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

K = 2048
#: Rows taken up before they are reduced, kept rows before they are handed on, parts in which a group's sketches are merged before all are.
TAKE_ROWS, HOLD_ROWS, SALTS = 400_000, 2_000_000, 256
_SPAN = 2.0**64


def smallest(codes: np.ndarray, hashes: np.ndarray, empty: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest different hashes of each code, and of one ``empty`` row of each code that has any."""
    order = np.lexsort((hashes, empty, codes))
    code, value, none = codes[order], hashes[order], empty[order]
    new_group = np.concatenate(([True], (code[1:] != code[:-1]) | (none[1:] != none[:-1])))
    fresh = new_group.copy()
    fresh[1:] |= (value[1:] != value[:-1]) & ~none[1:]
    order, new_group = order[fresh], new_group[fresh]
    at = np.arange(len(order))
    first = np.maximum.accumulate(np.where(new_group, at, 0))
    return order[at - first < k]


def _codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    code = np.zeros(table.num_rows, np.int64)
    for key in keys:
        column = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        part = column.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (len(column.dictionary) + 1) + part, return_inverse=True)[1]
    return code


def _arrays(table: pa.Table, keys: list[str], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """One row a group with its hashes; the rows of a group stand together, hashes ascending, an empty one last."""
    code = _codes(table, keys)
    column = table.column("hash").combine_chunks()
    starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    full = column.is_valid().to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(full)))
    offsets = upto[np.append(starts, len(code))]
    hashes = column.drop_null()
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        values = hashes.slice(offsets[i], offsets[j] - offsets[i])
        lists = pa.ListArray.from_arrays(pa.array((offsets[i : j + 1] - offsets[i]).astype(np.int32)), values)
        groups = table.select(keys).take(pa.array(starts[i:j])).combine_chunks()
        yield pa.RecordBatch.from_arrays([*[groups.column(k).combine_chunks() for k in keys], lists], [*keys, "hashes"])
        i = j


def _sketcher(keys: list[str], k: int, take: int, hold: int):
    def reduce(table: pa.Table) -> pa.Table:
        column = table.column("hash").combine_chunks()
        empty = column.is_null().to_numpy(zero_copy_only=False)
        hashes = column.fill_null(0).to_numpy(zero_copy_only=False)
        return table.take(pa.array(smallest(_codes(table, keys), hashes, empty, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: pa.Table | None = None
        fresh: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            fresh.append(batch)
            size += batch.num_rows
            if size >= take:
                new = pa.Table.from_batches(fresh)
                state, fresh, size = reduce(new if state is None else pa.concat_tables([state, new])), [], 0
                if state.num_rows > hold:  # too many groups to hold: hand on what there is, merging takes care of it
                    yield from _arrays(state, keys)
                    state = None
        if size:
            new = pa.Table.from_batches(fresh)
            state = reduce(new if state is None else pa.concat_tables([state, new]))
        if state is not None:
            yield from _arrays(state, keys)

    return run


def sketch(df: DataFrame, keys: Mapping[str, Column], counted: Mapping[str, Column], k: int = K, take: int = TAKE_ROWS, hold: int = HOLD_ROWS) -> DataFrame:
    """Sketches of the values ``counted`` by the groups ``keys``: keys, ``counted``, ``hashes``.

    NULL values are not counted, but a group that has only such keeps an empty
    sketch, so its count of 0 is known; NULL keys are keys. Each map task hands
    on one array of at most k hashes a group.
    """
    ship(df.sparkSession)
    cells = F.array(*[F.struct(F.lit(name).alias("counted"), F.when(value.isNotNull(), F.xxhash64(value)).alias("hash")) for name, value in counted.items()])
    rows = df.select(*[c.alias(n) for n, c in keys.items()], F.explode(cells).alias("_cell")).select(*keys, "_cell.*")
    by = [*keys, "counted"]
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema], "hashes array<bigint>"])
    return _merge(rows.mapInArrow(_sketcher(by, k, take, hold), out), by, F.spark_partition_id(), k)


def _merge(sketches: DataFrame, by: list[str], spread: Column, k: int) -> DataFrame:
    """The k smallest hashes of each group, first of each of its parts and then of all."""
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hashes")))), 1, k).alias("hashes")
    parts = sketches.select(*by, "hashes", F.pmod(spread, F.lit(SALTS)).cast("int").alias("_part")).groupBy(*by, "_part").agg(least)
    return parts.groupBy(*by).agg(least)


def merge(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Union of sketches by the given keys (columns not named are merged away).

    A group's sketches are first merged in ``SALTS`` parts, so no task gets more
    than a bounded share of a hot group's.
    """
    others = [c for c in sketches.columns if c != "hashes"]
    return _merge(sketches, [*keys, "counted"], F.xxhash64(*others), k)


def grouping_sets(sketches: DataFrame, keys: list[str], sets: list[list[str]], k: int = K) -> DataFrame:
    """Merged sketches for each set of keys; keys not in a set are NULL and ``level`` is the number of kept keys' bits, first key highest."""
    rows = F.array(*[
        F.struct(F.lit(sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key in wanted)).alias("level"), *[(F.col(key) if key in wanted else F.lit(None)).alias(key) for key in keys])
        for wanted in sets
    ])
    spread = sketches.select(F.explode(rows).alias("_g"), F.xxhash64(*keys).alias("_spread"), "counted", "hashes").select("_g.*", "_spread", "counted", "hashes")
    return _merge(spread, ["level", *keys, "counted"], F.col("_spread"), k)


def _share(hash: Column) -> Column:
    return (hash.cast("double") + F.lit(_SPAN / 2)) / F.lit(_SPAN)


def _bounds(estimate: Column, error: Column) -> list[Column]:
    return [estimate.alias("estimate"), F.greatest(F.lit(0.0), estimate - error).alias("lower"), (estimate + error).alias("upper")]


def estimate(sketches: DataFrame, keys: list[str], k: int = K, sigmas: float = 2.0) -> DataFrame:
    """``keys, counted, estimate, lower, upper``: exact below k, else with ``sigmas`` standard errors either side."""
    n = F.size("hashes")
    value = F.when(n < k, n.cast("double")).otherwise((k - 1) / _share(F.get("hashes", F.lit(k - 1))))
    error = F.when(n < k, 0.0).otherwise(value * sigmas / math.sqrt(k - 2))
    return sketches.select(*keys, "counted", *_bounds(value, error))


def compare(pairs: DataFrame, a: str, b: str, keys: list[str], k: int = K, sigmas: float = 2.0) -> DataFrame:
    """Union, intersection and differences of the sets whose sketches are in the columns ``a`` and ``b`` of each row.

    Results are ``keys``, ``measure`` (union, both, only_a, only_b), ``estimate,
    lower, upper``; a NULL sketch is that of an empty set. Hashes up to the
    smaller of the two sketches' bounds are a uniform sample of the union; each
    measure is the sample's count over its share of the range, with a binomial
    standard error. Exact while both sketches are below k.
    """
    none = F.array().cast("array<bigint>")
    sides = pairs.select(*keys, F.coalesce(a, none).alias("_a"), F.coalesce(b, none).alias("_b"))
    top = lambda c: F.get(c, F.lit(k - 1))
    limited = sides.withColumn("_limit", F.least(top("_a"), top("_b")))  # NULL where both are below k
    kept = lambda c: F.when(F.col("_limit").isNull(), F.col(c)).otherwise(F.filter(c, lambda x: x <= F.col("_limit")))
    sample = limited.select(*keys, "_limit", kept("_a").alias("_a"), kept("_b").alias("_b"))
    n = sample.select(*keys, "_limit", F.size("_a").alias("_na"), F.size("_b").alias("_nb"), F.size(F.array_intersect("_a", "_b")).alias("_both"))
    counts = n.select(*keys, "_limit", "_both", (F.col("_na") - F.col("_both")).alias("_only_a"), (F.col("_nb") - F.col("_both")).alias("_only_b"), (F.col("_na") + F.col("_nb") - F.col("_both")).alias("_union"))
    # the hash at the bound is spent on finding it, as in (k - 1) / U
    share = F.when(F.col("_limit").isNull(), 1.0).otherwise(_share(F.col("_limit")) * F.col("_union") / F.greatest(F.col("_union") - 1, F.lit(1)))
    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_{m}").alias("_n")) for m in ("union", "both", "only_a", "only_b")]))
    long = counts.select(*keys, share.alias("_share"), measures.alias("_m")).select(*keys, "_share", "_m.*")
    value = F.col("_n") / F.col("_share")
    error = sigmas * F.sqrt(F.greatest(F.col("_n"), F.lit(1)) * (1 - F.col("_share"))) / F.col("_share")
    return long.select(*keys, "measure", *_bounds(value, error))


def outstanding(estimates: DataFrame, day: str, group: str, least: int, times: float) -> DataFrame:
    """Days whose estimate is at least ``least`` and ``times`` the mean over all days of their group and ``counted``."""
    mean = F.avg("estimate").over(Window.partitionBy(group, "counted"))
    return estimates.withColumn("_mean", mean).where((F.col("estimate") >= least) & (F.col("estimate") >= times * F.col("_mean"))).select(day, group, "counted")
