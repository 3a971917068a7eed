"""Clusterings of a table with ``features``; each gives the table with ``prediction``."""

import itertools
import math

from pyspark.ml import clustering as ml
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.misc import euclidean
from ..workdir import materialize, release


def kmeans(df: DataFrame, k: int = 5, seed: int = 1) -> DataFrame:
    """k-means with k-means|| seeding."""
    return ml.KMeans(k=k, seed=seed).fit(df).transform(df)


def bisecting_kmeans(df: DataFrame, k: int = 5, seed: int = 1) -> DataFrame:
    """Divisive k-means."""
    return ml.BisectingKMeans(k=k, seed=seed).fit(df).transform(df)


def gaussian_mixture(df: DataFrame, k: int = 5, seed: int = 1) -> DataFrame:
    """Gaussian mixture, with ``probability``."""
    return ml.GaussianMixture(k=k, seed=seed).fit(df).transform(df)


#: Dimensions by which points are put into cells; more would give each point too many neighbour cells.
CELL_DIMENSIONS = 3


def _neighbours(points: DataFrame, eps: float, dimensions: int) -> DataFrame:
    """Pairs ``a, b`` of ids at most ``eps`` apart (a point is its own neighbour).

    Points lie in cells as wide as ``eps`` in the first few dimensions. Each
    meets the points of its own and the adjoining cells by equality of the
    cell; the distance over all dimensions decides.
    """
    used = min(dimensions, CELL_DIMENSIONS)
    cell = F.array(*[F.floor(F.get("x", F.lit(i)) / eps) for i in range(used)])
    here = points.select("id", "x", cell.alias("cell"))
    near = F.array(*[F.array(*[F.get("cell", F.lit(i)) + d for i, d in enumerate(step)]) for step in itertools.product((-1, 0, 1), repeat=used)])
    around = here.select(F.col("id").alias("b"), F.col("x").alias("y"), F.explode(near).alias("cell"))
    return here.join(around, "cell").where(euclidean(F.col("x"), F.col("y")) <= eps).select(F.col("id").alias("a"), "b")


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the least id that each id of the symmetric ``edges`` (a, b) is connected to.

    Each round gives every id the least label among its neighbours', then
    follows labels of labels, so distances halve; each round's labels are
    written to the shared folder, which also cuts the plan, and those of the
    round before removed. Rounds go on until no label changes.
    """
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("id").alias("b"), F.col("label").alias("_other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("_other").alias("_near"))
        least = labels.join(seen, "id", "left").select("id", "label", F.least("label", F.coalesce("_near", "label")).alias("_new"))
        jump = labels.select(F.col("id").alias("_new"), F.col("label").alias("_far"))
        new = materialize(least.join(jump, "_new", "left").select("id", F.least("_new", F.coalesce("_far", "_new")).alias("label"), F.col("label").alias("_old")), "labels")
        release(labels)
        labels = new.select("id", "label")
        if new.where("label != _old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _within_cells(points: DataFrame, eps: float, min_points: int, n: int) -> DataFrame | None:
    """``id, number`` of all points in clusters, by cells no wider than ``eps`` in any direction.

    Equal points are one spot. All spots of a cell with ``min_points`` points
    are core and need no search; others are compared with the spots around. Core
    spots of one cell belong together, so only cells are linked: by their
    outermost spots where these are close enough, which leaves the few pairs of
    cells in different components for a search among the spots that face each
    other. Work so grows with the points, not with their pairs.
    """
    side = eps / math.sqrt(n) * (1 - 1e-9)
    near = math.floor(eps / side) + 1
    steps = list(itertools.product(range(-near, near + 1), repeat=n))
    close = lambda a, b: euclidean(a, b) <= eps
    moved = lambda wanted: F.explode(F.array(*[F.array(*[F.get("cell", F.lit(i)) + d for i, d in enumerate(step)]) for step in wanted]))

    cell = F.array(*[F.floor(F.get("x", F.lit(i)) / side) for i in range(n)])
    spots = points.groupBy("x").agg(F.min("id").alias("s"), F.count(F.lit(1)).alias("w")).withColumn("cell", cell)
    full = spots.groupBy("cell").agg(F.sum("w").alias("_n")).where(F.col("_n") >= min_points).select("cell", F.lit(True).alias("_dense"))
    spots = materialize(spots.join(full, "cell", "left").withColumn("dense", F.coalesce("_dense", F.lit(False))).drop("_dense"), "spots")
    around = spots.where("NOT dense").select(F.col("s").alias("a"), F.col("x").alias("_x"), moved(steps).alias("cell"))
    pairs = materialize(around.join(spots, "cell").where(close(F.col("_x"), F.col("x"))).select("a", F.col("s").alias("b"), "w"), "neighbours")
    found = pairs.groupBy(F.col("a").alias("s")).agg(F.sum("w").alias("_n")).where(F.col("_n") >= min_points).select("s")
    core = spots.where("dense").select("s", "x", "cell").unionByName(spots.where("NOT dense").join(found, "s", "left_semi").select("s", "x", "cell"))
    ways = [way for way in itertools.product((-1, 0, 1), repeat=n) if any(way)]
    outermost = [F.max_by("x", sum(F.get("x", F.lit(i)) * d for i, d in enumerate(way))) for way in ways]
    cells = materialize(core.groupBy("cell").agg(F.min("s").alias("c"), F.array_distinct(F.array(*outermost)).alias("rim")), "cells")
    if cells.isEmpty():
        return None
    ahead = [step for step in steps if step > (0,) * n]
    beside = cells.select(F.col("c").alias("a"), F.col("rim").alias("_rim"), F.col("cell").alias("cell_a"), moved(ahead).alias("cell")).join(cells, "cell")
    touch = F.exists("_rim", lambda p: F.exists("rim", lambda q: close(p, q)))
    both = materialize(beside.select("a", F.col("c").alias("b"), "cell_a", F.col("cell").alias("cell_b"), touch.alias("touch")), "beside")
    alone = cells.select(F.col("c").alias("a"), F.col("c").alias("b"))
    linked = lambda links: alone.unionByName(links.select("a", "b")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sure = both.where("touch").select("a", "b")
    parts = components(linked(sure))
    of = lambda side: parts.select(F.col("id").alias(side), F.col("component").alias(f"_of_{side}"))
    open_pairs = both.where("NOT touch").join(of("a"), "a").join(of("b"), "b").where("_of_a != _of_b").select("a", "b", "cell_a", "cell_b")

    def facing(own: str, other: str) -> DataFrame:
        """The core spots of one cell of each open pair that are within reach of the other cell."""
        gap = lambda i: F.greatest(F.get(other, F.lit(i)) * side - F.get("x", F.lit(i)), F.get("x", F.lit(i)) - (F.get(other, F.lit(i)) + 1) * side, F.lit(0.0))
        return open_pairs.join(core.withColumnRenamed("cell", own), own).where(F.sqrt(sum(gap(i) * gap(i) for i in range(n))) <= eps * (1 + 1e-9)).select("a", "b", F.col("x").alias(f"x_{own}"))

    met = facing("cell_a", "cell_b").join(facing("cell_b", "cell_a"), ["a", "b"]).where(close(F.col("x_cell_a"), F.col("x_cell_b"))).select("a", "b").distinct()
    met = materialize(met, "met")
    if not met.isEmpty():
        parts = components(linked(sure.unionByName(met)))
    numbers = _numbered(parts.select("component").distinct())
    cell_numbers = cells.join(parts.join(numbers, "component").select(F.col("id").alias("c"), "number"), "c").select("cell", "number")
    own = core.join(cell_numbers, "cell").select("s", "number")
    reached = pairs.join(own.select(F.col("s").alias("b"), "number"), "b").groupBy(F.col("a").alias("s")).agg(F.min("number").alias("number"))
    border = reached.join(own.select("s"), "s", "left_anti")
    labels = own.unionByName(border).join(spots.select("s", "x"), "s").select("x", "number")
    return points.join(labels, "x").select("id", "number")


def _by_pairs(points: DataFrame, eps: float, min_points: int, n: int) -> DataFrame | None:
    """``id, number`` of all points in clusters, from all pairs within ``eps``: for points of more dimensions than cells have."""
    pairs = materialize(_neighbours(points, eps, n), "neighbours")
    cores = pairs.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select("id")
    linked = pairs.join(cores.select(F.col("id").alias("a")), "a", "left_semi").join(cores.select(F.col("id").alias("b")), "b", "left_semi")
    if linked.isEmpty():
        return None
    found = components(linked)
    clusters = found.join(_numbered(found.select("component").distinct()), "component").select("id", "number")
    labels = pairs.join(clusters.select(F.col("id").alias("b"), "number"), "b").groupBy(F.col("a").alias("id")).agg(F.min("number").alias("_any"))
    return labels.join(clusters, "id", "left").select("id", F.coalesce("number", "_any").alias("number"))


def dbscan(df: DataFrame, id: str, eps: float = 0.25, min_points: int = 10, features: str | list[str] = "features", dimensions: int | None = None) -> DataFrame:
    """``df`` with ``prediction``: clusters by density, -1 for noise.

    A point with at least ``min_points`` neighbours within ``eps`` (Euclidean,
    itself included) is a core point; core points within ``eps`` share a
    cluster; another point in reach of core points joins the cluster of least
    number. Clusters are numbered from 0 by their least core id, so labels
    depend on nothing but the data. ``id`` must be unique and not NULL. Rows
    with a NULL, NaN or infinite feature are noise. ``features`` is a vector or
    array column (then ``dimensions`` may be given, else it is looked up) or
    number columns. Points of up to three dimensions are clustered by cells;
    beyond, all pairs within ``eps`` are compared.
    """
    if isinstance(features, list):
        x, n = F.array(*[F.col(c).cast("double") for c in features]), len(features)
        points = df.where(_all_present(features)).select(F.col(id).alias("id"), x.alias("x"))
    else:
        x = vector_to_array(F.col(features)) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features).cast("array<double>")
        points = df.select(F.col(id).alias("id"), x.alias("x")).where("x IS NOT NULL")
        first = None if dimensions else points.select(F.size("x")).first()
        n = dimensions or (first[0] if first else 1)
    if not eps > 0 or math.isinf(eps):
        raise ValueError("eps must be a positive number")
    points = points.where(F.forall("x", lambda v: F.coalesce(F.abs(v) < math.inf, F.lit(False)) & ~F.isnan(v)))
    found = (_within_cells if n <= CELL_DIMENSIONS else _by_pairs)(points, eps, min_points, n)
    if found is None:
        return df.withColumn("prediction", F.lit(-1))
    labels = found.select(F.col("id").alias("_id"), "number")
    return df.join(labels, F.col(id) == F.col("_id"), "left").select(*df.columns, F.coalesce("number", F.lit(-1)).cast("int").alias("prediction"))


def _numbered(components: DataFrame) -> DataFrame:
    """Clusters from 0 by their least id: ranges are sorted apart and their sizes added up, so no task sees them all."""
    ranged = materialize(components.repartitionByRange("component").sortWithinPartitions("component").select("component", F.monotonically_increasing_id().alias("_at")), "clusters")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    before = sizes.alias("p").join(F.broadcast(sizes.alias("q")), F.col("q._part") < F.col("p._part"), "left").groupBy("p._part").agg(F.coalesce(F.sum("q._n"), F.lit(0)).alias("_before"))
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").select("component", (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"))


def _all_present(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= F.col(c).isNotNull()
    return out
