"""Grid-density clustering, for tables whose dense regions are wide against ``eps``.

``grid_density_clusters``: points fall into grid cells of
side ``eps`` over all dimensions; a cell holding at least ``min_samples`` points
is dense; dense cells that differ by at most one step in every dimension are
connected. Neighbours are joined on the cell's first coordinates and then
checked in all (cell-level joins only); components come from min-label
propagation with pointer jumping, a reliable checkpoint per round, until no label changes.
Points of dense cells take their component, points of sparse cells adjacent
to a dense cell take the smallest adjacent component, the rest are noise (-1).
No point pairs are ever formed, so a cell holding a third of the data is one
count. This is grid-density clustering; exact DBSCAN is in ``dbscan.py``, Ward's tree in ``ward.py``.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Leading coordinates that neighbour joins use as their key (3^KEY_DIMS offsets); the others are checked.
KEY_DIMS = 3


def vector_cols(df: DataFrame, vec: str, key: str) -> tuple[DataFrame, int]:
    """(key, _x: array of doubles) and the vectors' length, 0 if there is none."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import types as T
    arr = F.col(vec) if isinstance(df.schema[vec].dataType, T.ArrayType) else vector_to_array(F.col(vec))
    out = df.select(key, arr.cast("array<double>").alias("_x"))
    first = out.where("_x is not null").select("_x").first()
    return out, len(first["_x"]) if first else 0


def _neighbours(cells: DataFrame, others: DataFrame, g: int) -> DataFrame:
    """(cell, nbr): pairs of a cell of ``cells`` and another one of ``others`` within one step in each of g dimensions."""
    k = min(KEY_DIMS, g)
    offsets = F.array(*[F.array(*[F.lit(v) for v in o]) for o in itertools.product((-1, 0, 1), repeat=k)])
    near = cells.select("cell", F.explode(offsets).alias("off")) \
        .select("cell", F.array(*[F.col("cell")[i] + F.col("off")[i] for i in range(k)]).alias("_key"))
    away = others.select(F.col("cell").alias("nbr"), F.slice("cell", 1, k).alias("_key"))
    close = F.forall(F.zip_with("cell", "nbr", lambda a, b: F.abs(a - b) <= 1), lambda x: x)
    return near.join(away, "_key").where(close & (F.col("cell") != F.col("nbr"))).select("cell", "nbr")


def grid_density_clusters(df: DataFrame, vec: str, key: str, eps: float = 0.5, min_samples: int = 5,
                          dims: Sequence[int] | None = None) -> DataFrame:
    """Return ``(key, cluster)`` with cluster -1 for noise; ``dims`` picks dimensions, default all."""
    pts, d = vector_cols(df, vec, key)
    dims = list(range(d)) if dims is None else list(dims)
    g = len(dims)
    cell = F.array(*[F.floor(F.col("_x")[j] / eps).cast("long") for j in dims])
    pts = pts.withColumn("cell", cell)
    counts = pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    dense = materialize(counts.where(F.col("n") >= min_samples).select("cell"))
    edges = materialize(_neighbours(dense, dense, g))
    key_of = lambda c: F.concat_ws(",", F.transform(c, lambda v: v.cast("string")))
    # a label names a cell, so the label of the label's cell is a legal next label
    labels = dense.select(key_of(F.col("cell")).alias("id"), "cell", key_of(F.col("cell")).alias("lab"))
    while True:
        prop = edges.join(labels.select(F.col("cell").alias("nbr"), F.col("lab").alias("nlab")), "nbr") \
            .groupBy("cell").agg(F.min("nlab").alias("nlab"))
        new = labels.join(prop, "cell", "left").select(
            "id", "cell", F.col("lab").alias("old"), F.least(F.col("lab"), F.coalesce(F.col("nlab"), F.col("lab"))).alias("lab"))
        jump = labels.select(F.col("id").alias("lab"), F.col("lab").alias("further"))
        new = materialize(new.join(jump, "lab").select("id", "cell", "old", F.least("lab", "further").alias("lab")))
        labels = new.drop("old")
        if new.where(F.col("lab") != F.col("old")).isEmpty():
            break
    # sparse cells adjacent to a dense cell: smallest adjacent label
    sparse = counts.where(F.col("n") < min_samples).select("cell")
    sb = _neighbours(sparse, dense, g).join(labels.select(F.col("cell").alias("nbr"), "lab"), "nbr") \
        .groupBy("cell").agg(F.min("lab").alias("lab"))
    cell_lab = labels.select("cell", "lab").unionByName(sb)
    from .order_stats import dense_codes, keyed_join
    codes = dense_codes(labels.select("lab").distinct(), "lab", "cluster")
    coded = cell_lab.join(codes, "lab").select("cell", "cluster")  # cells, not points
    out = keyed_join(pts, coded, ["cell"], key, "left")  # a cell may hold a third of all points
    return out.select(key, F.coalesce(F.col("cluster").cast("int"), F.lit(-1)).alias("cluster"))
