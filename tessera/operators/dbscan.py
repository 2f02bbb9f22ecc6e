"""Exact DBSCAN (M-14) as joins of grid cells.

Points are reduced to distinct points with weights, and put into fine cells of side ``eps / sqrt(d)`` over all dimensions:
two points of a cell are within ``eps``. So a cell that holds ``min_samples`` points has only core points of one cluster,
however many, and none of its pairs is looked at. Cells meet by an equi-join on the neighbouring coarse cells of the
dimensions that spread most; their tight boxes then decide in all dimensions whether all of their points are within
``eps``, none, or some:

* A point of a sparse cell counts the points around it: whole cells by their weight, undecided ones point by point. At
  most ``min_samples`` such points share a cell, so this is linear in the points around them.
* Two dense cells are linked if any two of their points are. Undecided ones are halved in every dimension, round after
  round, until a pair of sub-cells is wholly within ``eps`` or all are too far apart, so two cells that hold a third of
  the table each are settled by their borders and never by all of their pairs.

Core points' clusters are the components of these links; a border point joins the lowest-numbered cluster that
reaches it. Clusters are numbered from 0 by the smallest key of their core points, -1 is noise: the result of the
classical algorithm run in order of the key. Rows without a vector, or with a null or NaN entry, are noise.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .cluster import KEY_DIMS, vector_cols
from .order_stats import dense_codes, keyed_join

#: Dimensions in which cells that meet are compared as plain numbers, before their boxes are.
NEAR_DIMS = 8


def least_squared(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Squared distance of the nearest points of two boxes."""
    gap = F.zip_with(F.zip_with(lo_a, hi_b, lambda a, b: a - b), F.zip_with(lo_b, hi_a, lambda b, a: b - a), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return _squared_length(gap)


def greatest_squared(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Squared distance of the farthest points of two boxes."""
    span = F.zip_with(F.zip_with(hi_a, lo_b, lambda a, b: a - b), F.zip_with(hi_b, lo_a, lambda b, a: b - a), lambda x, y: F.greatest(F.abs(x), F.abs(y)))
    return _squared_length(span)


def _squared_length(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def _box(d: int) -> list[Column]:
    return [F.array(*[F.min(F.col("x")[j]) for j in range(d)]).alias("lo"), F.array(*[F.max(F.col("x")[j]) for j in range(d)]).alias("hi")]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of the graph with long ids ``nodes`` (node) and ``edges`` (a, b): root is the smallest id reachable.

    Smallest neighbour and pointer jumping, a reliable checkpoint a round, until no root changes."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    roots = nodes.select("node", F.col("node").alias("root"))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
        step = materialize(step.join(jump, "root").select("node", "old", F.least("root", "further").alias("root")))
        roots = step.select("node", "root")
        if step.where("old != root").isEmpty():
            return roots


def _near_cells(cells: DataFrame, dims: list[int], reach: int, eps2: float) -> DataFrame:
    """(a, b, n_b, dense_b, whole): ordered pairs of different cells with points that may be within eps; ``whole``: all are.

    ``dims``: all dimensions, those that spread most first. Cells meet by the first ``KEY_DIMS`` of them, with ``NEAR_DIMS``
    sides of their boxes as plain numbers, each of which must be near; the boxes come to the few pairs that remain."""
    key, near = dims[:KEY_DIMS], dims[:NEAR_DIMS]
    offsets = F.array(*[F.array(*[F.lit(v) for v in o]) for o in itertools.product((-1, 0, 1), repeat=len(key))])
    coarse = F.array(*[F.floor(F.col("cell")[j] / reach) for j in key])
    sides = lambda c: [F.col(x)[j].alias(f"{x}{j}_{c}") for j in near for x in ("lo", "hi")]
    a = cells.select(F.col("cid").alias("a"), coarse.alias("_c"), *sides("a")).withColumn("_o", F.explode(offsets))
    a = a.withColumn("_c", F.zip_with("_c", "_o", lambda c, o: c + o)).drop("_o")
    b = cells.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("dense").alias("dense_b"), coarse.alias("_c"), *sides("b"))
    hashed = lambda df: df.withColumn("_h", F.xxhash64("_c"))  # noqa: E731  # rows are sorted by a number before the array
    some = F.col("a") != F.col("b")
    for j in near:
        gap = F.greatest(F.col(f"lo{j}_a") - F.col(f"hi{j}_b"), F.col(f"lo{j}_b") - F.col(f"hi{j}_a"), F.lit(0.0))
        some = some & (gap * gap <= eps2)
    pairs = hashed(a).join(hashed(b), ["_h", "_c"]).where(some).select("a", "b", "n_b", "dense_b")
    for c in ("a", "b"):
        pairs = pairs.join(cells.select(F.col("cid").alias(c), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}")), c)
    boxes = [F.col(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b")]
    return pairs.where(least_squared(*boxes) <= eps2).select("a", "b", "n_b", "dense_b", (greatest_squared(*boxes) <= eps2).alias("whole"))


def _dense_links(points: DataFrame, pairs: DataFrame, d: int, side: float, eps2: float) -> DataFrame:
    """(a, b) of the undecided dense cells ``pairs`` (a < b) that have two points within eps."""
    found, open_, part = [], materialize(pairs.select("a", "b", F.array().cast("array<long>").alias("sub_a"), F.array().cast("array<long>").alias("sub_b"))), 1
    while not open_.isEmpty():
        # sub-cells of the cells in question, with their tight boxes, and the sub-cells that they lie in
        part *= 2
        wanted = open_.select(F.col("a").alias("cid")).union(open_.select("b")).distinct()
        sub = F.array(*[F.floor(F.col("x")[j] / (side / part)).cast("long") for j in range(d)])
        above = sub if part == 2 else F.array(*[F.floor(F.col("x")[j] / (side / (part // 2))).cast("long") for j in range(d)])
        above = F.array().cast("array<long>") if part == 2 else above
        boxes = materialize(points.join(wanted, "cid").groupBy("cid", above.alias("above"), sub.alias("sub")).agg(*_box(d)))
        left = boxes.select(F.col("cid").alias("a"), F.col("above").alias("sub_a"), F.col("sub").alias("s"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
        right = boxes.select(F.col("cid").alias("b"), F.col("above").alias("sub_b"), F.col("sub").alias("t"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        both = [F.col(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b")]
        near = materialize(open_.join(left, ["a", "sub_a"]).join(right, ["b", "sub_b"]).where(least_squared(*both) <= eps2).select(
            "a", "b", "s", "t", (greatest_squared(*both) <= eps2).alias("whole")))
        linked = near.where("whole").select("a", "b").distinct()
        found.append(linked)
        open_ = materialize(near.join(linked, ["a", "b"], "left_anti").select("a", "b", F.col("s").alias("sub_a"), F.col("t").alias("sub_b")))
    out = pairs.select("a", "b").limit(0)
    for linked in found:
        out = out.union(linked)
    return out


def dbscan(df: DataFrame, vec: str, key: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Return ``(key, cluster)`` with cluster -1 for noise; ``key`` an ordered column, ``vec`` an array or vector column."""
    rows, d = vector_cols(df, vec, key)
    if not d:
        return rows.select(key, F.lit(-1).alias("cluster"))
    usable = F.col("x").isNotNull() & (F.size("x") == d) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    side, eps2 = eps / math.sqrt(d) * (1 - 1e-9), eps * eps
    rows = rows.withColumnRenamed("_x", "x").withColumn("cell", F.when(usable, F.array(*[F.floor(F.col("x")[j] / side).cast("long") for j in range(d)])))
    points = rows.where("cell is not null").groupBy("x", "cell").agg(F.count(F.lit(1)).alias("w"), F.min(key).alias("low"))
    points = materialize(points.withColumn("pid", F.monotonically_increasing_id()))
    cells = points.groupBy("cell").agg(F.sum("w").alias("n"), F.min("low").alias("low"), *_box(d))
    cells = materialize(cells.withColumns({"dense": F.col("n") >= min_samples, "cid": F.monotonically_increasing_id()}))
    spread = points.agg(*[F.stddev_pop(F.col("x")[j]).alias(str(j)) for j in range(d)]).first()  # one number a dimension
    dims = sorted(range(d), key=lambda j: -(spread[j] or 0.0))
    pairs = materialize(_near_cells(cells, dims, math.ceil(eps / side), eps2))

    points = materialize(points.join(cells.select("cell", "cid", "n", "dense"), "cell").drop("cell"))
    sparse = points.where("not dense").select("pid", "x", F.col("cid").alias("a"), "n", "low")
    # (pid, b, c, others): weight of cell b within eps of a sparse cell's point, and, if b is sparse too, b's points there
    around = sparse.select("pid", "x", "a").join(pairs, "a")
    whole = around.where("whole").select("pid", "b", "dense_b", F.col("n_b").alias("c"), F.lit(None).cast("array<long>").alias("others"))
    q = points.select(F.col("cid").alias("b"), F.col("x").alias("y"), "w", F.col("pid").alias("q"))
    apart = _squared_length(F.zip_with("x", "y", lambda a, b: a - b))
    some = around.where("not whole").join(q, "b").where(apart <= eps2).groupBy("pid", "b", "dense_b").agg(
        F.sum("w").alias("c"), F.collect_list(F.when(~F.col("dense_b"), F.col("q"))).alias("others"))
    around = materialize(whole.unionByName(some))
    counts = around.groupBy("pid").agg(F.sum("c").alias("c"))
    sparse = materialize(sparse.join(counts, "pid", "left").withColumn("core", F.col("n") + F.coalesce("c", F.lit(0)) >= min_samples).drop("c", "x"))

    # nodes: dense cells 2 * cid, core points of sparse cells 2 * pid + 1
    core = sparse.where("core").select("pid", "a", "low")
    dense = cells.where("dense").select((F.col("cid") * 2).alias("node"), "low")
    of_cell = core.select(F.col("a").alias("b"), F.col("pid").alias("q"))
    touched = around.where("dense_b").select("pid", (F.col("b") * 2).alias("to")).unionByName(
        around.where("not dense_b and others is null").select("pid", "b").join(of_cell, "b").select("pid", (F.col("q") * 2 + 1).alias("to"))).unionByName(
        around.where("not dense_b").select("pid", F.explode("others").alias("q")).join(core.select(F.col("pid").alias("q")), "q").select(
            "pid", (F.col("q") * 2 + 1).alias("to"))).unionByName(
        sparse.select("pid", F.col("a").alias("b")).join(of_cell, "b").where("pid != q").select("pid", (F.col("q") * 2 + 1).alias("to")))
    touched = materialize(touched)
    between = pairs.where("dense_b and a < b").join(cells.where("dense").select(F.col("cid").alias("a")), "a", "left_semi")
    edges = touched.join(core.select("pid"), "pid").select((F.col("pid") * 2 + 1).alias("a"), F.col("to").alias("b"))
    edges = edges.union(between.where("whole").select(F.col("a") * 2, F.col("b") * 2)).union(
        _dense_links(points, between.where("not whole"), d, side, eps2).select(F.col("a") * 2, F.col("b") * 2))
    nodes = dense.unionByName(core.select((F.col("pid") * 2 + 1).alias("node"), "low"))
    roots = components(nodes.select("node"), edges)
    first = roots.join(nodes, "node").groupBy("root").agg(F.min("low").alias("first"))
    codes = first.join(dense_codes(first, "first", "cluster"), "first").select("root", F.col("cluster").cast("int").alias("cluster"))
    labels = materialize(roots.join(codes, "root").select("node", "cluster"))

    in_dense = cells.where("dense").select("cell", (F.col("cid") * 2).alias("node")).join(labels, "node").select("cell", "cluster")
    reached = touched.join(labels.withColumnRenamed("node", "to"), "to").groupBy("pid").agg(F.min("cluster").alias("border"))
    own = labels.where("node % 2 = 1").select(F.shiftright("node", 1).alias("pid"), "cluster")
    in_sparse = sparse.select("pid").join(own, "pid", "left").join(reached, "pid", "left").select("pid", F.coalesce("cluster", "border").alias("other"))
    in_sparse = points.where("not dense").select("pid", "x").join(in_sparse, "pid").select("x", "other")
    out = keyed_join(rows, in_dense, ["cell"], key, "left").join(in_sparse, "x", "left")
    return out.select(key, F.coalesce("cluster", "other", F.lit(-1)).cast("int").alias("cluster"))
