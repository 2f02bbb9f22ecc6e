"""Evaluation (V-1 ... V-15): metrics as SQL aggregates over prediction tables.

Predictions are ``(label, prediction)`` DataFrames; metrics are one-row frames
(wide) that callers unpivot when they need long ``(metric, value)`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import rnd


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V-1: R^2, RMSE, MAE (4 dp)."""
    y, p = F.col(label), F.col(prediction)
    a = pred.agg(F.count(F.lit(1)).alias("_n"), F.sum((y - p) * (y - p)).alias("_sse"),
                 F.sum(F.abs(y - p)).alias("_sae"), F.var_pop(y).alias("_vy"))
    r2 = F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_vy") * F.col("_n"))
    return a.select(rnd(F.coalesce(r2, F.lit(0.0)), 4).alias("r2"),
                    rnd(F.sqrt(F.col("_sse") / F.col("_n")), 4).alias("rmse"),
                    rnd(F.col("_sae") / F.col("_n"), 4).alias("mae"))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V-4: counts per (actual, predicted)."""
    return pred.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(pred: DataFrame, n_classes: int | None = None, positive=1.0,
                           label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V-2/V-3: accuracy; precision/recall/F1 for class ``positive`` when the target has
    exactly two classes (``n_classes``, counted on the whole target), else
    support-weighted; 0/0 -> 0. Works from the confusion table (classes^2 rows)."""
    cm = confusion(pred, label, prediction)
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = cm.where("actual is not null").groupBy(F.col("actual").alias("c")).agg(F.sum("n").alias("_s"), right.alias("_t"))
    cols = cm.where("predicted is not null").groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("_p"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per = rows.join(cols, "c", "full").select("c", zero("_t").alias("tp"), (zero("_p") - zero("_t")).alias("fp"),
                                              (zero("_s") - zero("_t")).alias("fn"), zero("_s").alias("support"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    per = per.select("c", "support", prec.alias("p"), rec.alias("r"), f1.alias("f"))
    acc = cm.agg(F.try_divide(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)),
                              F.sum("n")).alias("accuracy"))
    binary = n_classes == 2
    if binary:
        agg = per.where(F.col("c") == F.lit(positive)).agg(F.max("p").alias("precision"), F.max("r").alias("recall"),
                                                           F.max("f").alias("f1"))
    else:
        tot = F.sum("support")
        agg = per.agg(*[F.coalesce(F.try_divide(F.sum(F.col(x) * F.col("support")), tot), F.lit(0.0)).alias(n)
                        for x, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))])
    return acc.crossJoin(agg).select(rnd(F.coalesce("accuracy", F.lit(0.0)), 4).alias("accuracy"),
                                     rnd(F.coalesce("precision", F.lit(0.0)), 4).alias("precision"),
                                     rnd(F.coalesce("recall", F.lit(0.0)), 4).alias("recall"),
                                     rnd(F.coalesce("f1", F.lit(0.0)), 4).alias("f1"))


def vector_long(df: DataFrame, vec: str, key: str, cluster: str) -> DataFrame:
    """``(key, cluster, dim, x)`` from an array or ML vector column."""
    arr = F.col(vec) if isinstance(df.schema[vec].dataType, T.ArrayType) else vector_to_array(F.col(vec))
    return df.select(F.col(key).alias("key"), F.col(cluster).alias("cluster"),
                     F.posexplode(arr).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def cluster_metrics(df: DataFrame, vec: str, key: str, cluster: str) -> DataFrame:
    """V-10 ... V-13 for a labelled point set (noise label -1 excluded from k):
    ``n_clusters_found``, ``silhouette_sq`` (squared-Euclidean silhouette, exact,
    O(n k d) via per-cluster sums -- no point pairs), Calinski-Harabasz,
    Davies-Bouldin. Euclidean silhouette would need every point pair and is
    not computed."""
    long = vector_long(df, vec, key, cluster).where(F.col("cluster") != -1)
    # per point: squared norm; per cluster: size, per-dim sums and the sum of squared norms
    pt = long.groupBy("key", "cluster").agg(F.sum(F.col("x") * F.col("x")).alias("sq"))
    csz = pt.groupBy("cluster").agg(F.count(F.lit(1)).alias("nk"), F.sum("sq").alias("Qk"))
    cdim = long.groupBy("cluster", "dim").agg(F.sum("x").alias("Sk"), F.avg("x").alias("ck"))
    k = csz.agg(F.count(F.lit(1)).alias("k"), F.sum("nk").alias("n"))
    # mean squared distance from point i to cluster C: sq_i - 2 x_i.S_C / n_C + Q_C / n_C
    # cdim has clusters x dims rows (bounded by the model, not the data): broadcast it, so the
    # point side is never shuffled on the low-cardinality ``dim`` key
    dots = long.join(F.broadcast(cdim.withColumnRenamed("cluster", "other")), "dim") \
        .groupBy("key", "cluster", "other").agg(F.sum(F.col("x") * F.col("Sk")).alias("dot"))
    md = dots.join(pt.select("key", "sq"), "key").join(F.broadcast(csz.withColumnRenamed("cluster", "other")), "other") \
        .select("key", "cluster", "other", "nk",
                (F.col("sq") - 2 * F.col("dot") / F.col("nk") + F.col("Qk") / F.col("nk")).alias("d"))
    # own cluster: mean over the other n_k - 1 points (self distance is 0)
    own = F.col("d") * F.col("nk") / (F.col("nk") - 1)
    per_pt = md.groupBy("key", "cluster").agg(
        F.max(F.when(F.col("other") == F.col("cluster"), F.when(F.col("nk") > 1, own).otherwise(F.lit(0.0)))).alias("a"),
        F.min(F.when(F.col("other") != F.col("cluster"), F.col("d"))).alias("b"),
        F.max(F.when(F.col("other") == F.col("cluster"), F.col("nk"))).alias("nk"))
    s = F.when(F.col("nk") > 1, F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))) \
        .otherwise(F.lit(0.0))
    sil = per_pt.agg(F.avg(s).alias("silhouette_sq"))
    # Calinski-Harabasz: between / within dispersion
    gmean = long.groupBy("dim").agg(F.avg("x").alias("g"))
    between = cdim.join(F.broadcast(gmean), "dim").join(F.broadcast(csz.select("cluster", "nk")), "cluster") \
        .agg(F.sum(F.col("nk") * (F.col("ck") - F.col("g")) * (F.col("ck") - F.col("g"))).alias("B"))
    within_pt = long.join(F.broadcast(cdim.select("cluster", "dim", "ck")), ["cluster", "dim"]) \
        .groupBy("key", "cluster").agg(F.sum((F.col("x") - F.col("ck")) * (F.col("x") - F.col("ck"))).alias("w2"))
    within = within_pt.agg(F.sum("w2").alias("W"))
    ch = between.crossJoin(within).crossJoin(k).select(
        F.coalesce(F.try_divide(F.col("B") * (F.col("n") - F.col("k")), F.col("W") * (F.col("k") - 1)),
                   F.lit(0.0)).alias("calinski_harabasz"))
    # Davies-Bouldin: s_k = mean Euclidean distance to the centroid; centroid pairs (k^2 rows)
    sk = within_pt.groupBy("cluster").agg(F.avg(F.sqrt("w2")).alias("s"))
    ca = cdim.select(F.col("cluster").alias("ka"), "dim", F.col("ck").alias("ca"))
    cb = cdim.select(F.col("cluster").alias("kb"), "dim", F.col("ck").alias("cb"))
    cdist = ca.join(cb, "dim").where(F.col("ka") != F.col("kb")).groupBy("ka", "kb") \
        .agg(F.sqrt(F.sum((F.col("ca") - F.col("cb")) * (F.col("ca") - F.col("cb")))).alias("m"))
    ratio = cdist.join(sk.select(F.col("cluster").alias("ka"), F.col("s").alias("sa")), "ka") \
        .join(sk.select(F.col("cluster").alias("kb"), F.col("s").alias("sb")), "kb") \
        .select("ka", F.coalesce(F.try_divide(F.col("sa") + F.col("sb"), F.col("m")), F.lit(0.0)).alias("rt"))
    db = ratio.groupBy("ka").agg(F.max("rt").alias("mx")).agg(F.avg("mx").alias("davies_bouldin"))
    return k.crossJoin(sil).crossJoin(ch).crossJoin(db).select(
        F.col("k").alias("n_clusters_found"), rnd(F.col("silhouette_sq"), 4).alias("silhouette_sq"),
        rnd(F.col("calinski_harabasz"), 4).alias("calinski_harabasz"), rnd(F.col("davies_bouldin"), 4).alias("davies_bouldin"))


#: Points of the Euclidean silhouette's sample; the reference samples as many.
SILHOUETTE_SAMPLE = 5000


def silhouette(df: DataFrame, vec: str, key: str, cluster: str, sample: int = SILHOUETTE_SAMPLE) -> DataFrame:
    """V-10: (silhouette, n) by Euclidean distances over a sample of at most ``sample`` points, all of them if they are no
    more; noise (-1) takes part as a cluster, as in the reference. A sampling operator: the points with the smallest
    hashes of their keys.

    The sample is broadcast (its size is the bound) and its rows are dealt to tasks, which add up each row's distances by
    cluster in blocks. A point alone in its cluster counts 0; one cluster in all has no silhouette (null).
    """
    spark = df.sparkSession
    arr = F.col(vec) if isinstance(df.schema[vec].dataType, T.ArrayType) else vector_to_array(F.col(vec))
    rows = df.select(F.xxhash64(key).alias("h"), F.col(key).cast("string").alias("k"), F.col(cluster).cast("int").alias("c"), arr.cast("array<double>").alias("x"))
    rows = rows.where("c is not null and x is not null").orderBy("h", "k").limit(sample)
    held = rows.collect()  # at most ``sample`` rows
    if not held:
        return spark.createDataFrame([(None, 0)], "silhouette double, n long")
    x, c = np.array([r["x"] for r in held]), np.array([r["c"] for r in held])
    names, place = np.unique(c, return_inverse=True)
    shared = spark.sparkContext.broadcast((x, place, np.bincount(place)))
    single = len(names) < 2

    def run(batches):
        x, place, size = shared.value
        for batch in batches:
            out = []
            for low in range(0, batch.num_rows, 256):
                at = np.asarray(batch.column(0))[low:low + 256]
                square = (x[at] ** 2).sum(1)[:, None] + (x ** 2).sum(1)[None, :] - 2 * x[at] @ x.T
                far = np.sqrt(np.maximum(square, 0))
                far[np.arange(len(at)), at] = 0
                sums = np.stack([far[:, place == j].sum(1) for j in range(len(size))], axis=1)
                own = place[at]
                mine = np.arange(len(at)), own
                inside = sums[mine] / np.maximum(size[own] - 1, 1)
                means = sums / size
                means[mine] = np.inf
                other = means.min(axis=1)
                top = np.maximum(inside, other)
                out.append(np.where((size[own] > 1) & (top > 0), (other - inside) / np.where(top > 0, top, 1), 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["s"])

    found = spark.range(len(held)).repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "s double")
    value = F.lit(None).cast("double") if single else F.avg("s")
    return found.agg(rnd(value, 4).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """V-13: size per cluster label, noise (-1) included."""
    return df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


def cluster_centers(df: DataFrame, vec: str, key: str, cluster: str) -> DataFrame:
    """V-14: per-cluster mean vector as long rows (cluster, dim, center)."""
    return vector_long(df, vec, key, cluster).where(F.col("cluster") != -1) \
        .groupBy("cluster", "dim").agg(rnd(F.avg("x"), 6).alias("center"))


def pca_2d(df: DataFrame, features: Sequence[str] | str, key: str, k: int = 2) -> DataFrame:
    """V-15: 2-D PCA of standardized features; data are centered first (Spark's PCA
    does not center) and each component's sign is fixed so its largest loading is positive."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    if isinstance(features, str):
        vec = df.select(key, F.col(features).alias("_v"))
        if isinstance(df.schema[features].dataType, T.ArrayType):
            from pyspark.ml.functions import array_to_vector
            vec = vec.select(key, array_to_vector(F.col("_v").cast("array<double>")).alias("_v"))
    else:
        vec = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="keep").transform(df) \
            .select(key, "_v")
    scaled = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(vec).transform(vec)
    model = PCA(k=k, inputCol="_s", outputCol="_p").fit(scaled)
    pc = model.pc.toArray()  # d x k loadings: bounded by the feature count
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    out = model.transform(scaled).select(key, vector_to_array("_p").alias("_a"))
    return out.select(key, *[(F.col("_a")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)])


#: Predictions that a run's result shows.
PREDICTION_SAMPLE = 50


def prediction_sample(pred: DataFrame, key: str, order: Sequence[str], n: int = PREDICTION_SAMPLE) -> DataFrame:
    """V-8: the first ``n`` rows of ``pred`` (key, label, prediction) in ``order`` (columns that decide the order alone)."""
    return pred.orderBy(*order).limit(n).select(key, "label", "prediction")


def run_sizes(split: DataFrame, n_features: int, flag: str = "is_test") -> DataFrame:
    """V-9: rows of both parts of a split and the number of features, one row."""
    return split.agg(F.count_if(~F.col(flag)).alias("train_size"), F.count_if(flag).alias("test_size"), F.lit(n_features).alias("n_features"))
