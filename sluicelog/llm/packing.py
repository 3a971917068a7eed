"""Filling containers of fixed capacity with whole items, by best-two-fit.

A container is filled greedily, always with the largest unpacked item that
still fits. Then its smallest item is taken out again if two unpacked items
fill the widened gap more tightly, and the filling goes on. Each task packs
runs of items on its own; what it leaves in loosely filled containers is packed
once more together, so loose containers are few however many tasks there are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..workdir import materialize

#: Items packed in one run (memory of a run: some hundred bytes an item).
RUN_ITEMS = 200_000


class _Stock:
    """Unpacked items by size; the sizes at hand are the set bits of a whole number."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        order = np.argsort(sizes, kind="stable")[::-1]
        cuts = np.searchsorted(-sizes[order], -np.arange(capacity + 1), side="left")
        self.items = [order[cuts[s] : cuts[s - 1] if s else len(order)].tolist() for s in range(capacity + 1)]
        self.bits = sum(1 << s for s in range(1, capacity + 1) if self.items[s])

    def largest(self, room: int) -> int:
        """The greatest size at hand up to ``room``, else 0."""
        return (self.bits & ((2 << room) - 1)).bit_length() - 1 if room > 0 and self.bits & ((2 << room) - 2) else 0

    def take(self, size: int) -> int:
        item = self.items[size].pop()
        if not self.items[size]:
            self.bits ^= 1 << size
        return item

    def give(self, size: int, item: int) -> None:
        self.items[size].append(item)
        self.bits |= 1 << size

    def two(self, room: int, above: int) -> tuple[int, int] | None:
        """Two sizes at hand whose sum is the greatest up to ``room``, if that is more than ``above``."""
        best, found = above, None
        x = self.largest(room)
        while x * 2 > best:
            rest = room - x
            y = self.largest(min(rest, x))
            if y == x and len(self.items[x]) < 2:
                y = self.largest(x - 1) if x > 1 else 0
            if y and x + y > best:
                best, found = x + y, (x, y)
                if best == room:
                    break
            x = self.largest(x - 1)
        return found


def best_two_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container number of each item of size 1 to ``capacity``, and the containers' fill."""
    stock = _Stock(sizes, capacity)
    where = np.full(len(sizes), -1, np.int64)
    fills: list[int] = []
    while stock.bits:
        room, inside = capacity, []
        while True:
            while size := stock.largest(room):
                inside.append((size, stock.take(size)))
                room -= size
            if not room or len(inside) < 2:
                break
            least, item = inside[-1]  # sizes fall, so the last is the smallest
            pair = stock.two(room + least, least)
            if not pair:
                break
            inside.pop()
            for size in pair:
                inside.append((size, stock.take(size)))
            stock.give(least, item)
            room += least - sum(pair)
            inside.sort(key=lambda x: -x[0])
        for _, item in inside:
            where[item] = len(fills)
        fills.append(capacity - room)
    return where, np.array(fills, np.int64)


def _packer(capacity: int, run_items: int, round_no: int):
    """Arrow batches of (id, piece_no, size) in, with (container, fill) out."""

    def pack(run: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(run).combine_chunks()
        sizes = table.column("size").to_numpy()
        filled = np.flatnonzero(sizes > 0)
        where, fills = best_two_fit(sizes[filled], capacity)
        if not len(fills):
            fills = np.zeros(1, np.int64)
        number = np.zeros(len(sizes), np.int64)  # items of no size need no room: they lie in the run's first container
        number[filled] = where
        # a container is known by its first item in the run's order
        first = np.full(len(fills), len(sizes), np.int64)
        np.minimum.at(first, number, np.arange(len(sizes)))
        columns = [*table.columns, table.column("id").take(first[number]), table.column("piece_no").take(first[number]), pa.array(np.full(len(sizes), round_no, np.int32)), pa.array(fills[number])]
        yield from pa.table(columns, ["id", "piece_no", "size", "first_id", "first_piece", "round", "fill"]).to_batches(max_chunksize=50_000)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, run_items - n)
                run.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n >= run_items:
                    yield from pack(run)
                    run, n = [], 0
        if n:
            yield from pack(run)

    return go


def cut_oversized(sizes: DataFrame, id: str, size: str, capacity: int) -> DataFrame:
    """``id, piece_no, size``: an item over the capacity in as many full pieces as it holds and the rest, others whole as piece 0.

    A NULL or negative size counts as 0.
    """
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    last = F.call_function("div", F.greatest(n - 1, F.lit(0)), F.lit(capacity).cast("long"))
    pieces = sizes.select(F.col(id).alias("id"), n.alias("n"), last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece_no"))
    return pieces.select("id", "piece_no", F.when(F.col("piece_no") < F.col("last"), F.lit(capacity).cast("long")).otherwise(F.col("n") - F.col("last") * capacity).alias("size"))


def pack(sizes: DataFrame, id: str, size: str, capacity: int, run_items: int = RUN_ITEMS, loose: float = 0.98) -> DataFrame:
    """Containers of all items: ``id, piece_no, size, container, fill``.

    Every row of ``sizes`` comes out once, or once a piece if it is larger than
    the capacity; no container holds more than ``capacity``. ``container`` names
    the round of packing and the first item in it, and is unique if the ids
    are not NULL and unique (repeated ids still each get room, but containers
    that start with equal ids share a name). Items of no size are put into a
    container of their run. Containers less than ``loose`` full of a first
    round are packed again in a second. No items, no containers.
    """
    if capacity < 1 or run_items < 1:
        raise ValueError("capacity and run_items must be positive")
    ship(sizes.sparkSession)
    kind = sizes.schema[id].dataType.simpleString()
    out = f"id {kind}, piece_no long, size long, first_id {kind}, first_piece long, round int, fill long"
    items = cut_oversized(sizes, id, size, capacity)
    one = materialize(items.mapInArrow(_packer(capacity, run_items, 1), out), "containers")
    full = F.col("fill") >= loose * capacity
    rest = one.where(~full).select("id", "piece_no", "size")
    parts = max(1, -(-rest.count() // run_items))
    # equal runs whose order doesn't depend on how the rows arrive
    two = rest.repartition(parts, F.xxhash64("id", "piece_no")).sortWithinPartitions("id", "piece_no", "size").mapInArrow(_packer(capacity, run_items, 2), out)
    return one.where(full).unionByName(two).select(
        F.col("id").alias(id), "piece_no", "size", F.concat_ws("-", F.col("round"), F.col("first_id"), F.col("first_piece")).alias("container"), "fill"
    )
