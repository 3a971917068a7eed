"""Windows that a visit to a core domain opens for its client.

No step collects a client's flows. Silence before a flow is looked up within
time buckets that repeat the last ``gap`` of the bucket before; flows meet
windows by equality of (client, bucket of the window's length), where a window
lies in two buckets at most, so a client with a third of all flows is spread.
``order`` names the columns that put a client's flows in a total order, the
time first; flows alike in all of them are in no order and none precedes the
other.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import service_form
from ..session import ship

ORDER = ("time_start", "name", "s_ip", "c_port", "s_port")
#: Seconds of a bucket in which silence is looked up, if the gap isn't longer.
BUCKET = 21_600.0


def named(flows: DataFrame) -> DataFrame:
    """Flows with ``-`` for a missing name."""
    return flows.withColumn("name", F.coalesce("name", F.lit("-")))


def _order(columns: tuple[str, ...], of: str = "") -> Column:
    return F.struct(*[F.col(f"{of}{c}") for c in columns])


def _slots(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long")))


def triggers(flows: DataFrame, cores: list[str], gap: float, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``c_ip, core, start, at``: flows to a core domain more than ``gap`` seconds after the client's flow before.

    A client's very first flow is none. ``at`` is the flow's place in the order.
    """
    t = F.col("time_start")
    width = max(BUCKET, gap)
    spread = flows.select("c_ip", *dict.fromkeys((*order, "name", "time_start")), _slots(t, t + gap, width).alias("_slot"))
    before = Window.partitionBy("c_ip", "_slot").orderBy(*order)
    own = F.col("_slot") == F.floor(t / width)
    seen = spread.withColumn("_before", F.lag("time_start").over(before))
    silent = seen.where(own & F.col("name").isin(list(cores)) & (F.col("_before").isNull() | (t - F.col("_before") > gap)))
    first = flows.groupBy("c_ip").agg(F.min(_order(order)).alias("_first"))
    found = silent.select("c_ip", F.col("name").alias("core"), t.alias("start"), _order(order).alias("at"))
    return found.join(first, "c_ip").where(F.col("at") > F.col("_first")).drop("_first")


def assign(flows: DataFrame, windows: DataFrame, length: float, order: tuple[str, ...] = ORDER, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each flow after a window's opening by at most ``length`` and before its ``closed_at``, with the window.

    ``windows`` has ``c_ip, core, start, at, closed_at`` (a place in the order,
    NULL for never) and does not overlap within a client. Returns the window's
    columns, ``name``, ``delta`` and the flow's columns ``keep``.
    """
    w = windows.select("*", _slots(F.col("start"), F.col("start") + length, length).alias("_slot"))
    f = flows.select(F.col("c_ip").alias("_client"), "name", "time_start", *keep, _order(order).alias("_at"), F.floor(F.col("time_start") / length).alias("_flow_slot"))
    inside = (F.col("_at") > F.col("at")) & (F.col("time_start") - F.col("start") <= length) & (F.col("closed_at").isNull() | (F.col("_at") < F.col("closed_at")))
    joined = w.join(f, (F.col("c_ip") == F.col("_client")) & (F.col("_slot") == F.col("_flow_slot")) & inside)
    return joined.select(*windows.columns, "name", (F.col("time_start") - F.col("start")).alias("delta"), *keep)


def observation(flows: DataFrame, cores: list[str], gap: float, length: float, order: tuple[str, ...] = ORDER) -> tuple[DataFrame, DataFrame]:
    """The windows that triggers open, each closed by the client's next trigger, and the flows within them."""
    opened = triggers(flows, cores, gap, order)
    follows = Window.partitionBy("c_ip").orderBy("at")
    windows = opened.withColumn("closed_at", F.lead("at").over(follows))
    return windows, assign(flows, windows, length, order)


def bags(flows: DataFrame, cores: list[str], gap: float, length: float, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``core, support, n, windows``: flows of each support domain within a core's windows, and the number of those windows."""
    windows, inside = observation(flows, cores, gap, length, order)
    opened = windows.groupBy("core").agg(F.count(F.lit(1)).alias("windows"))
    counts = inside.groupBy("core", service_form(F.col("name")).alias("support")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(opened, "core")


def finished_windows(flows: DataFrame, cores: list[str], gap: float, length: float, order: tuple[str, ...] = ORDER) -> tuple[DataFrame, DataFrame]:
    """Observation windows that ended, and ``core, c_ip, start, support, delta``: each support's first time in them.

    A window counts if a flow of any client follows its end and the same client
    did not trigger again within it.
    """
    windows, inside = observation(flows, cores, gap, length, order)
    last = flows.agg(F.max("time_start")).scalar()
    ended = (F.col("start") + length < last) & (F.col("closed_at").isNull() | (F.col("closed_at.time_start") > F.col("start") + length))
    supports = inside.where(ended).groupBy("core", "c_ip", "start", "at", service_form(F.col("name")).alias("support")).agg(F.min("delta").alias("delta"))
    return windows.where(ended).select("core", "c_ip", "start", "at"), supports


def visits(flows: DataFrame, cores: list[str], length: float, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``c_ip, core, start, at``: visits to core domains while the client has no window open, where a window stays open for ``length``.

    Runs of visits less than ``length`` apart are gone through on their own, in
    order, since the flow after a longer silence always opens a window; only
    the last opening is held, however long a run is.
    """
    ship(flows.sparkSession)
    last = flows.agg(F.max("time_start")).scalar()
    by_client = Window.partitionBy("c_ip").orderBy("at")
    core = flows.where(F.col("name").isin(list(cores))).select("c_ip", F.col("name").alias("core"), F.col("time_start").alias("start"), _order(order).alias("at"))
    breaks = F.coalesce(F.col("start") - F.lag("start").over(by_client) > length, F.lit(True)).cast("long")
    runs = core.withColumn("_break", breaks).withColumn("_run", F.sum("_break").over(by_client.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")
    ordered = runs.repartition("c_ip", "_run").sortWithinPartitions("c_ip", "_run", "at").select("c_ip", "_run", "start", "core", "at")
    opened = ordered.mapInArrow(_openings(length), ordered.schema).select("c_ip", "core", "start", "at")
    return opened.where(F.col("start") + length < last)


def _openings(length: float):
    """Visits of one run after another in; those that no earlier opening of the run covers out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened = None, 0.0
        for batch in batches:
            kept = []
            for i, (client, no, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if (client, no) != now or start - opened > length:
                    kept.append(i)
                    now, opened = (client, no), start
            yield batch.take(pa.array(kept, pa.int64()))

    return run
