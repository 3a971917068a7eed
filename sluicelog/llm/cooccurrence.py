"""Items that appear together, by a blocked Gram matrix.

Baskets are rows and items columns of a binary matrix B; the counts of pairs
are the entries of B transposed times B. The rows are cut into record blocks,
streamed one after another through each task, the columns into item blocks
whose share of the product fits in memory. A block's product is summed in
place; only its non-zero sums leave the task and are added up over blocks.

A basket of very many items is cut by items too: its items fall into groups by
hash, and each pair of groups is a record of its own, so its product is spread
over as many tasks as it has pairs of groups.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..workdir import materialize

#: Incidences of a record block, and products summed at once (8 bytes each).
BLOCK_ROWS = 1_000_000
BLOCK_PRODUCTS = 2_000_000
#: Items of a basket beyond which it is cut by items, and of one group of them.
SPLIT_ITEMS = 4_000


def gram_block(record: np.ndarray, item: np.ndarray, products: int = BLOCK_PRODUCTS, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Non-zero (a, b, count) with a < b of the Gram matrix of one record block, strip by strip.

    ``record`` is non-decreasing; (record, item) are distinct. In a record whose
    items have a ``side`` of 0 or 1 only pairs across the sides count; those of
    a whole basket have -1. Item blocks are runs of items whose products number
    about ``products``; a block's row strip of the matrix is summed densely
    where it is small, else by sorting.
    """
    ids, local = np.unique(item, return_inverse=True)
    width = len(ids)
    side = np.full(len(record), -1, np.int8) if side is None else side
    order = np.lexsort((local, side, record))
    record, local, side = record[order], local[order], side[order]
    ends = np.searchsorted(record, record, side="right")
    # partners: items of the same basket with a greater id, or of the other side
    first = np.arange(1, len(record) + 1)
    across = side >= 0
    if across.any():
        ones = np.concatenate(([0], np.cumsum(side == 1)))
        first[across] = ends[across] - (ones[ends] - ones[np.searchsorted(record, record, side="left")])[across]
        first[side == 1] = ends[side == 1]
    later = ends - first
    by_item = np.argsort(local, kind="stable")
    by_item = by_item[later[by_item] > 0]
    load = np.cumsum(later[by_item])
    start = 0
    while start < len(by_item):
        base = load[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(load, base + products, side="right")))
        rows = by_item[start:stop]
        times = later[rows]
        total = int(times.sum())
        step = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
        a, b = np.repeat(local[rows], times), local[np.repeat(first[rows], times) + step]
        a, b = np.minimum(a, b), np.maximum(a, b)
        low = int(a.min())
        span = int(a.max()) - low + 1
        key = (a - low) * width + b
        if span * width <= 4 * total:
            sums = np.bincount(key, minlength=span * width)
            key = np.flatnonzero(sums)
            n = sums[key]
        else:
            key, n = np.unique(key, return_counts=True)
        yield ids[key // width + low], ids[key % width], n
        start = stop


def _gram(block_rows: int):
    def product(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        record, item, side = (np.concatenate(x) for x in zip(*held, strict=True))
        # records are adjacent: a change of the hash is a new record
        number = np.concatenate(([0], np.cumsum(record[1:] != record[:-1])))
        for strip in gram_block(number, item, side=side):
            for i in range(0, len(strip[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000].astype(np.int64)) for x in strip], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            new = tuple(batch.column(c).to_numpy() for c in range(3))
            if size + batch.num_rows >= block_rows and batch.num_rows:
                last = np.flatnonzero(new[0] != new[0][-1])
                cut = int(last[-1]) + 1 if len(last) else 0  # the last record may go on
                if cut or (held and held[-1][0][-1] != new[0][0]):
                    yield from product([*held, tuple(x[:cut] for x in new)])
                    held, size, new = [], 0, tuple(x[cut:] for x in new)
            if len(new[0]):
                held.append(new)
                size += len(new[0])
        if size:
            yield from product(held)

    return run


def pair_counts(df: DataFrame, basket: list[Column], item: Column, min_count: int, block_rows: int = BLOCK_ROWS, split_items: int = SPLIT_ITEMS) -> DataFrame:
    """Pairs of items in at least ``min_count`` baskets together.

    Returns ``name_a < name_b`` (by code point), ``n_ab, n_a, n_b, n_baskets``
    and ``lift`` = n_ab * n_baskets / (n_a * n_b), the count against that
    expected by chance. Rows with a NULL item name nothing and make no basket;
    a NULL in a basket's columns is a value like any other; items repeated in a
    basket count once. No rows or no pair at the bound: an empty result. An
    item in fewer than ``min_count`` baskets has no such pair, so leaving it
    out before the product loses nothing. Counts are exact but for the chance
    of 2 ** -64 that two baskets which meet in a task share a hash.

    Incidences and vocabulary are written to the shared folder when this is
    called. A basket of more than ``split_items`` items is cut by items: each
    is sent once for every group of the basket's items, and no task holds more
    than about two groups of one basket.
    """
    ship(df.sparkSession)
    if min_count < 1 or split_items < 1:
        raise ValueError("min_count and split_items must be positive")
    keys = [f"_b{i}" for i in range(len(basket))]
    inc = df.select(*[c.alias(k) for c, k in zip(basket, keys, strict=True)], item.cast("string").alias("_item")).where(F.col("_item").isNotNull()).distinct()
    inc = materialize(inc, "incidences")
    # ids are written once, so they stay as they are whatever is computed again
    vocabulary = materialize(
        inc.groupBy("_item").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count).select("_item", "_n", F.monotonically_increasing_id().alias("_id")), "vocabulary"
    )
    # the count reads the sizes, so both share one exchange
    sizes = inc.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    n_baskets = sizes.agg(F.count_if(F.col("_m") > 0)).scalar()
    large = sizes.where(F.col("_m") > split_items).select(*[F.col(k).alias(f"{k}l") for k in keys], F.ceil(F.col("_m") / split_items).cast("int").alias("_groups"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}l"))
    rows = inc.join(vocabulary.select("_item", "_id"), "_item").select(*keys, "_id").join(large, same, "left")
    own = F.pmod(F.xxhash64("_id"), F.col("_groups")).cast("int")
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("tinyint").alias("side"))
    zero = F.lit(0)
    each = F.transform(F.sequence(zero, F.col("_groups") - 1), lambda h: place(F.least(own, h), F.greatest(own, h), F.when(own == h, -1).otherwise((own > h).cast("int"))))
    places = F.explode(F.when(F.col("_groups").isNull(), F.array(place(zero, zero, F.lit(-1)))).otherwise(each))
    parts = [*keys, "_i", "_j"]
    spread = rows.select(*keys, "_id", places.alias("_p")).select(*keys, "_id", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"), "_p.side").repartition(*parts).sortWithinPartitions(*parts)
    record = F.xxhash64(*[x for k in keys for x in (F.col(k), F.col(k).isNull())], "_i", "_j")
    blocks = spread.select(record.alias("record"), F.col("_id").alias("item"), "side")
    partial = blocks.mapInArrow(_gram(block_rows), "a long, b long, n long")
    together = partial.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_count)
    a = vocabulary.select(F.col("_id").alias("a"), F.col("_item").alias("_x"), F.col("_n").alias("_nx"))
    b = vocabulary.select(F.col("_id").alias("b"), F.col("_item").alias("_y"), F.col("_n").alias("_ny"))
    named = together.join(a, "a").join(b, "b").withColumn("n_baskets", n_baskets)
    first = F.col("_x") < F.col("_y")
    return named.select(
        F.when(first, F.col("_x")).otherwise(F.col("_y")).alias("name_a"), F.when(first, F.col("_y")).otherwise(F.col("_x")).alias("name_b"), "n_ab",
        F.when(first, F.col("_nx")).otherwise(F.col("_ny")).alias("n_a"), F.when(first, F.col("_ny")).otherwise(F.col("_nx")).alias("n_b"), "n_baskets",
        (F.col("n_ab") * F.col("n_baskets").cast("double") / (F.col("_nx").cast("double") * F.col("_ny"))).alias("lift"),
    )


def lifted(pairs: DataFrame, times: int) -> DataFrame:
    """Pairs at least ``times`` as frequent as chance suggests, compared in whole numbers."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    return pairs.where(big("n_ab") * F.col("n_baskets") >= big("n_a") * F.col("n_b") * times)
