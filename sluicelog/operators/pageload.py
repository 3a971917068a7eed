"""Page-load indicators from the order in which a page's support domains are contacted."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import service_form
from . import windows


@dataclass(frozen=True)
class Params:
    """Core domains; window and silence before it in seconds; least share of windows with a support; checkpoints."""

    cores: tuple[str, ...]
    window: float = 30.0
    gap: float = 5.0
    min_share: float = 0.25
    checkpoints: int = 4


def bags(flows: DataFrame, p: Params, order: tuple[str, ...] = windows.ORDER) -> DataFrame:
    """``core, support, n, freq, avg_time, stdev_time`` of supports in at least two and ``min_share`` of a core's ended windows; freq in percent."""
    ended, supports = windows.finished_windows(windows.named(flows), list(p.cores), p.gap, p.window, order)
    opened = ended.groupBy("core").agg(F.count(F.lit(1)).alias("_windows"))
    times = supports.groupBy("core", "support").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("avg_time"), F.stddev_pop("delta").alias("stdev_time"))
    freq = 100.0 * F.col("n") / F.col("_windows")
    return times.join(opened, "core").select("core", "support", "n", freq.alias("freq"), "avg_time", "stdev_time").where((F.col("n") >= 2) & (F.col("freq") >= 100 * p.min_share))


def evaluation_windows(flows: DataFrame, learned: DataFrame, p: Params, order: tuple[str, ...] = windows.ORDER) -> tuple[DataFrame, DataFrame]:
    """Visits to cores that have a bag, and ``core, c_ip, start, at, support, delta``: when each support of the bag was first seen, strictly within the window."""
    flows = windows.named(flows)
    known = learned.select(F.col("core").alias("_core"), F.col("support").alias("_support"))
    found = windows.visits(flows, list(p.cores), p.window, order)
    inside = windows.assign(flows, found.withColumn("closed_at", F.lit(None).cast(found.schema["at"].dataType)), p.window, order).where(F.col("delta") < p.window)
    inside = inside.withColumn("support", service_form(F.col("name")))
    seen = inside.join(known, (F.col("core") == F.col("_core")) & (F.col("support") == F.col("_support")), "left_semi")
    return found, seen.groupBy("core", "c_ip", "start", "at", "support").agg(F.min("delta").alias("delta"))


def model(seen: DataFrame, checkpoints: int) -> DataFrame:
    """``core, support, weight, checkpoint`` (from 1).

    A support weighs as many points as others came strictly before it, over all
    windows: its rank in each window less one, so no pair is ever formed.
    Supports that never follow another are absent. By weight, then name, the
    supports of a core are dealt to checkpoints of equal size, larger ones last;
    fewer supports than checkpoints get one each.
    """
    rank = F.rank().over(Window.partitionBy("core", "c_ip", "start", "at").orderBy("delta")) - 1
    weights = seen.withColumn("_before", rank.cast("long")).groupBy("core", "support").agg(F.sum("_before").alias("weight")).where("weight > 0")
    by_core = Window.partitionBy("core")
    placed = weights.withColumn("_p", F.row_number().over(by_core.orderBy("weight", "support")) - 1).withColumn("_n", F.count(F.lit(1)).over(by_core))
    chunk = F.when(F.col("_n") < checkpoints, F.col("_p")).otherwise(F.floor(((F.col("_p") + 1) * checkpoints - 1) / F.col("_n")))
    return placed.select("core", "support", "weight", (chunk + 1).cast("int").alias("checkpoint"))


def visit_times(found: DataFrame, seen: DataFrame, dealt: DataFrame, checkpoints: int) -> DataFrame:
    """``time, c_ip, page, cp_1 ... cp_n`` of visits to cores that the model has: the latest of a checkpoint's supports, NULL if none was seen."""
    modelled = found.join(dealt.select("core").distinct(), "core", "left_semi")
    marked = seen.join(dealt.select("core", "support", "checkpoint"), ["core", "support"])
    key = ["core", "c_ip", "start", "at"]
    columns = [F.max(F.when(F.col("checkpoint") == i, F.col("delta"))).alias(f"cp_{i}") for i in range(1, checkpoints + 1)]
    reached = marked.groupBy(*key).agg(*columns)
    return modelled.join(reached, key, "left").select(F.col("start").alias("time"), "c_ip", F.col("core").alias("page"), *[f"cp_{i}" for i in range(1, checkpoints + 1)])


def report(flows: DataFrame, p: Params, order: tuple[str, ...] = windows.ORDER) -> DataFrame:
    """Learn bags and model from the flows and apply them to the same flows."""
    found, seen = evaluation_windows(flows, bags(flows, p, order), p, order)
    return visit_times(found, seen, model(seen, p.checkpoints), p.checkpoints)
