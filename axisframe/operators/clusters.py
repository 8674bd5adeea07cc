"""Clusters of neighbouring cells beyond a threshold, and threshold-free cluster enhancement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cube import Cube
from .graph import components


def beyond(v: Column, threshold, tail: int = 0) -> Column:
    """At or beyond the threshold: below (-1), above (1), or in size (0, so opposite signs can be neighbours)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if tail not in (-1, 0, 1):
        raise ValueError("tail is -1, 0 or 1")
    return v <= t if tail == -1 else v >= t if tail == 1 else F.abs(v) >= t


def runs(cube: Cube, dim: int | str, threshold: float, tail: int = 0) -> DataFrame:
    """One-dimensional clusters along an axis: (other axes, ``first``, ``last``, ``size``, ``sum``)."""
    d, v = cube.axis(dim), F.col(cube.value)
    w = Window.partitionBy(*cube.keys(d)).orderBy(f"{d}_idx")
    islands = cube.df.where(beyond(v, threshold, tail)).withColumn("__island", F.col(f"{d}_idx") - F.row_number().over(w))
    return islands.groupBy(*cube.keys(d), "__island").agg(F.min(f"{d}_idx").alias("first"), F.max(f"{d}_idx").alias("last"), F.count("*").alias("size"), F.sum(v).alias("sum")).drop("__island")


def neighbors_1d(spark: SparkSession, n: int) -> DataFrame:
    """Edges (a, b) of a line of n nodes, a < b."""
    return spark.range(max(n - 1, 0)).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))


def grid_edges(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Edges over the row-major cells of a product of axes, each given by its (edges, length): one axis moves at a time."""
    spark = parts[0][0].sparkSession
    out, after = None, 1
    for i in range(len(parts) - 1, -1, -1):
        edges, n = parts[i]
        before = int(np.prod([m for _, m in parts[:i]])) if i else 1
        outer, inner = spark.range(before).withColumnRenamed("id", "o"), spark.range(after).withColumnRenamed("id", "i")
        cell = lambda c: (F.col("o") * n + F.col(c)) * after + F.col("i")
        step = edges.crossJoin(inner).crossJoin(outer).select(cell("a").alias("a"), cell("b").alias("b"))
        out, after = step if out is None else out.unionByName(step), after * n
    return out


def delaunay(points: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the Delaunay triangulation of points in the plane (Bowyer-Watson, on the driver: sensors are few)."""
    p = np.asarray(points, float)
    n = len(p)
    mid, span = p.mean(0), max(np.ptp(p, axis=0).max(), 1e-9) * 1e4
    q = np.vstack([p, mid + [[-span, -span], [span, -span], [0, span]]])
    triangles = {(n, n + 1, n + 2)}

    def holds(t, x):
        a, b, c = q[list(t)] - x
        det = np.linalg.det(np.column_stack([np.stack([a, b, c]), [a @ a, b @ b, c @ c]]))
        (ux, uy), (vx, vy) = q[t[1]] - q[t[0]], q[t[2]] - q[t[0]]
        turn = ux * vy - uy * vx
        return det * np.sign(turn) > 1e-12 * span

    for i in range(n):
        bad = [t for t in triangles if holds(t, q[i])]
        sides: dict[tuple, int] = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                sides[tuple(sorted(e))] = sides.get(tuple(sorted(e)), 0) + 1
        triangles -= set(bad)
        triangles |= {(*e, i) for e, k in sides.items() if k == 1}
    return sorted({tuple(sorted(e)) for t in triangles if max(t) < n for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2]))})


def sensor_neighbors(spark: SparkSession, theta_radius) -> DataFrame:
    """Edges between sensors given as rows of (angle in degrees, radius), or by a file of two such rows."""
    if isinstance(theta_radius, str):
        theta_radius = np.array([[float(x) for x in r[0].replace(",", " ").split()] for r in spark.read.text(theta_radius).collect() if r[0].strip()]).T
    theta, r = np.asarray(theta_radius, float).T
    edges = delaunay(np.column_stack([r * np.cos(np.radians(theta)), r * np.sin(np.radians(theta))]))
    return spark.createDataFrame(edges, "a long, b long")


def find_clusters(cells: DataFrame, edges: DataFrame, threshold: float, tail: int = 0) -> tuple[DataFrame, DataFrame]:
    """Clusters on a graph. ``cells``: (cell, value); ``edges``: (a, b). Gives (cell, cluster) and (cluster, size, sum)."""
    inside = cells.where(beyond(F.col("value"), threshold, tail))
    links = edges.join(inside.select(F.col("cell").alias("a")), "a", "left_semi").join(inside.select(F.col("cell").alias("b")), "b", "left_semi").select("a", "b")
    roots = components(links)
    members = inside.join(roots.select(F.col("id").alias("cell"), "root"), "cell", "left").select("cell", F.coalesce("root", "cell").alias("cluster"), "value")
    return members.select("cell", "cluster"), members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("value").alias("sum"))


def pval_from_histogram(stats: DataFrame, null: DataFrame, tail: int = 0, value: str = "value") -> DataFrame:
    """``stats`` with ``p`` = (null values as extreme + 1) / (their number + 1).

    Distinct values of both sides, each with its number of null values, are sorted together by ranges and counted as
    they pass, so neither a pairing of all with all nor one long window is needed, and ties are one row.
    """
    if tail not in (-1, 0, 1):
        raise ValueError("tail is -1, 0 or 1")
    size = F.abs(F.col(value)) if tail == 0 else -F.col(value) if tail == -1 else F.col(value)
    both = stats.select(size.alias("__v"), F.lit(0).alias("__null")).unionByName(null.select(size.alias("__v"), F.lit(1).alias("__null")))
    both = both.groupBy("__v").agg(F.sum("__null").alias("__null")).repartitionByRange("__v").withColumn("__part", F.spark_partition_id())
    from ..plans.lineage import materialise

    part = materialise(both)
    ahead = part.groupBy("__part").agg(F.sum("__null").alias("n"))  # one row a partition; later partitions hold larger values
    w = Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = ahead.select("__part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__ahead"), F.sum("n").over(total).alias("__all"))
    here = F.sum("__null").over(Window.partitionBy("__part").orderBy(F.desc("__v")).rowsBetween(Window.unboundedPreceding, 0))
    p = part.withColumn("__here", here).join(ahead, "__part").select("__v", ((F.col("__here") + F.col("__ahead") + 1) / (F.col("__all") + 1)).alias("p"))
    return stats.withColumn("__v", size).join(p, "__v").select(*stats.columns, "p")


def thresholds(spark: SparkSession, lo: float, hi: float, step: float) -> DataFrame:
    """(k, h): lo, lo + step, ... below hi + step."""
    n = max(0, int(np.ceil((hi + step - lo) / step - 1e-9)))
    return spark.range(n).select(F.col("id").alias("k"), (F.lit(float(lo)) + F.col("id") * F.lit(float(step))).alias("h"))


def tfce_runs(cube: Cube, dim: int | str, dt: float = 0.1, e: float = 2 / 3, h: float = 2.0, tail: int = 0, lo: float | None = None, hi: float | None = None) -> Cube:
    """TFCE along one axis, in windows: sum over thresholds t of (length of the run at t)**e * t**h * dt.

    Thresholds go from the least to the largest size of a value; ``lo`` and ``hi`` spare the pass that finds them.
    Each cell meets only the thresholds that it reaches.
    """
    d = cube.axis(dim)
    size = {0: F.abs(F.col(cube.value)), 1: F.col(cube.value), -1: -F.col(cube.value)}[tail]
    df = cube.df.withColumn("__v", size.cast("double"))
    if lo is None or hi is None:
        row = df.where("__v > 0" if tail else "true").agg(F.min("__v"), F.max("__v")).first()
        lo, hi = row[0] if lo is None else lo, row[1] if hi is None else hi
    count = F.floor((F.col("__v") - F.lit(lo)) / F.lit(dt) + F.lit(1e-9)).cast("int")
    cells = df.where(F.col("__v") >= lo).withColumn("__k", F.explode(F.sequence(F.lit(0), count)))
    keys = cube.keys(d)
    w = Window.partitionBy(*keys, "__k").orderBy(f"{d}_idx")
    cells = cells.withColumn("__island", F.col(f"{d}_idx") - F.row_number().over(w))
    n = F.count("*").over(Window.partitionBy(*keys, "__k", "__island"))
    t = F.lit(lo) + F.col("__k") * F.lit(dt)
    cells = cells.withColumn("__gain", F.pow(n.cast("double"), F.lit(float(e))) * F.pow(t, F.lit(float(h))) * F.lit(dt))
    gain = cells.groupBy(*keys, f"{d}_idx").agg(F.sum("__gain").alias("__sum"))
    sign = -1.0 if tail == -1 else 1.0
    out = cube.df.join(gain, [*keys, f"{d}_idx"], "left").withColumn(cube.value, F.coalesce("__sum", F.lit(0.0)) * sign)
    return cube.with_(out.select(*cube.df.columns))


class Islands:
    """Clusters of a map in memory: a grid by its shape, or a graph by its edges."""

    def __init__(self, shape: tuple[int, ...] | None = None, edges: np.ndarray | None = None):
        if edges is None:
            at = np.arange(int(np.prod(shape))).reshape(shape)
            pairs = [np.stack([at.take(range(n - 1), k).ravel(), at.take(range(1, n), k).ravel()], 1) for k, n in enumerate(shape) if n > 1]
            edges = np.concatenate(pairs) if pairs else np.zeros((0, 2), int)
        self.edges = np.asarray(edges, int).reshape(-1, 2)

    def labels(self, inside: np.ndarray) -> np.ndarray:
        """Least cell number of each cell's cluster; its own outside."""
        e = self.edges[inside[self.edges].all(axis=1)] if len(self.edges) else self.edges
        root = np.arange(len(inside))
        while len(e):
            low = np.minimum(root[e[:, 0]], root[e[:, 1]])
            new = root.copy()
            np.minimum.at(new, root[e[:, 0]], low)
            np.minimum.at(new, root[e[:, 1]], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return root


def tfce_map(x: np.ndarray, islands: Islands, dt: float = 0.1, e: float = 2 / 3, h: float = 2.0, tail: int = 0) -> np.ndarray:
    """TFCE of one flat map in memory."""
    size = np.abs(x) if tail == 0 else x * tail
    positive = size[size > 0] if tail else size
    out = np.zeros(len(x))
    if not len(positive):
        return out
    lo, hi = positive.min(), positive.max()
    for k in range(int(np.ceil((hi + dt - lo) / dt - 1e-9))):
        t = lo + k * dt
        inside = size >= t
        if not inside.any():
            break
        label = islands.labels(inside)
        n = np.bincount(label[inside], minlength=len(x))
        out[inside] += n[label[inside]] ** e * t**h * dt
    return out if tail >= 0 else -out


def tfce_both(x: np.ndarray, islands: Islands, **kw) -> np.ndarray:
    """Positive and negative sides enhanced apart."""
    return tfce_map(x, islands, tail=1, **kw) + tfce_map(x, islands, tail=-1, **kw)


def tfce(cube: Cube, over: list[str], shape: tuple[int, ...], edges: list[tuple[int, int]] | None = None, dt: float = 0.1, e: float = 2 / 3, h: float = 2.0, tail: int = 0) -> Cube:
    """TFCE of every map over the axes ``over`` (row-major, of that shape); each map is one Arrow group."""
    keys, columns = [c for d in cube.dims if d not in over for c in (f"{d}_idx", d)], cube.df.columns
    graph, value = None if edges is None else np.asarray(edges), cube.value

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.ravel_multi_index([pdf[f"{d}_idx"] for d in over], shape)
        x = np.zeros(int(np.prod(shape)))
        x[at] = pdf[value]
        return pdf.assign(**{value: tfce_map(x, Islands(shape, graph), dt, e, h, tail)[at]})[columns]

    df = cube.df.withColumn(cube.value, F.col(cube.value).cast("double"))
    return cube.with_(df.groupBy(*keys).applyInPandas(run, df.schema) if keys else df.groupBy(F.lit(0)).applyInPandas(run, df.schema))


def tfce_signed(cube: Cube, over: list[str], shape: tuple[int, ...], edges: list[tuple[int, int]] | None = None, **kw) -> Cube:
    """Positive and negative sides enhanced apart, in one cube."""
    up, down = (tfce(cube, over, shape, edges, tail=tail, **kw) for tail in (1, -1))
    return up.combine(down, lambda a, b: a + b)


METHODS = {"runs": runs, "tfce_runs": tfce_runs}
