"""Data behind the reference's charts (H-1 ... H-12) and the rule-based
explanation (L-1). Rendering is out of scope: every function returns the rows
a chart would plot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, rnd, short_float_str

TOP_IMPORTANCE = 15
RADAR_CHART_MODELS = 4
TARGET_BINS = 30
KS_WARNING_LINE, PSI_WARNING_LINE = 0.05, 0.1


def actual_vs_predicted(pred: DataFrame) -> DataFrame:
    """H-1/H-2: pairs, residual, and the diagonal's range over both series (a one-row
    aggregate joined back, so a full prediction table never meets an unpartitioned window)."""
    rng = pred.agg(F.least(F.min("label"), F.min("prediction")).alias("diag_min"),
                   F.greatest(F.max("label"), F.max("prediction")).alias("diag_max"))
    return pred.crossJoin(F.broadcast(rng)).select(
        F.col("label").alias("actual"), F.col("prediction").alias("predicted"),
        (F.col("label") - F.col("prediction")).alias("residual"), "diag_min", "diag_max")


def class_counts(pred: DataFrame, class_names: DataFrame | None = None) -> DataFrame:
    """H-3: actual and predicted counts per class (named when ``class_names`` maps code -> name)."""
    a = pred.groupBy(F.col("label").alias("code")).agg(F.count(F.lit(1)).alias("n")).withColumn("series", F.lit("actual"))
    p = pred.groupBy(F.col("prediction").alias("code")).agg(F.count(F.lit(1)).alias("n")).withColumn("series", F.lit("predicted"))
    out = a.unionByName(p)
    if class_names is not None:
        out = out.join(class_names, "code", "left")
    return out


def importance_bars(importance: DataFrame, k: int = TOP_IMPORTANCE) -> DataFrame:
    """H-5: top-k importances, highlighted when above their median."""
    top = importance.where(F.col("rank") <= k)
    med = F.percentile(F.col("importance"), 0.5).over(Window.partitionBy())  # <= k rows
    return top.select("rank", "feature", "importance", (F.col("importance") > med).alias("highlight"))


def cluster_scatter(pca: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """H-6: (pc1, pc2, label) with -1 shown as Noise."""
    j = pca.join(labels.select(key, "cluster"), key)
    return j.select(key, "pc1", "pc2", F.when(F.col("cluster") == -1, F.lit("Noise"))
                    .otherwise(F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))).alias("label"))


def cluster_shares(labelled: DataFrame, label: str = "label") -> DataFrame:
    """H-7: (label, size, share in percent) of every cluster, noise included."""
    sizes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("_n"))  # one row
    return sizes.crossJoin(F.broadcast(total)).select(label, "size", rnd(F.col("size") * 100.0 / F.col("_n"), 2).alias("share"))


def forecast_frame(fc: DataFrame) -> DataFrame:
    """H-8: series_key, step, segment (train / actual / forecast), value."""
    train = fc.where(F.col("segment") == "train").select("series_key", "step", F.lit("train").alias("segment"),
                                                         F.col("actual").alias("value"))
    act = fc.where(F.col("segment") == "test").select("series_key", "step", F.lit("actual").alias("segment"),
                                                      F.col("actual").alias("value"))
    pr = fc.where(F.col("segment") == "test").select("series_key", "step", F.lit("forecast").alias("segment"),
                                                     F.col("forecast").alias("value"))
    return train.unionByName(act).unionByName(pr)


def target_distribution(df: DataFrame, target: str, task: str) -> DataFrame:
    """H-9: 30 equal-width bins for regression/time series, class counts otherwise."""
    from .stats import histogram
    if task in ("regression", "time_series"):
        return histogram(df, [target], bins=TARGET_BINS, min_rows=1)
    return df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("value")) \
        .agg(F.count(F.lit(1)).alias("count"))


def radar_frame(radar: DataFrame, n_models: int = RADAR_CHART_MODELS) -> DataFrame:
    """H-11: first four models, each polygon closed by repeating its first axis."""
    first = radar.withColumn("_m", F.dense_rank().over(Window.partitionBy("run_id").orderBy("run_pos"))) \
        .where(F.col("_m") <= n_models).drop("_m")
    n_axes = F.max("axis_pos").over(Window.partitionBy("run_id", "model_key")) + 1  # <= 5 rows per model
    closing = first.withColumn("_n", n_axes).where(F.col("axis_pos") == 0) \
        .withColumn("axis_pos", F.col("_n")).drop("_n")
    return first.unionByName(closing)


def drift_bars(report: DataFrame) -> DataFrame:
    """H-12: KS and PSI per feature with the warning lines."""
    return report.select("feature", "ks_statistic", "psi", "drift_detected",
                         F.lit(KS_WARNING_LINE).alias("ks_warning"), F.lit(PSI_WARNING_LINE).alias("psi_warning"))


def explain(metrics: DataFrame, task_type: str, model_name_col: str = "model_name") -> DataFrame:
    """L-1: rule-based explanation per model from its metrics (wide: r2 / accuracy / silhouette_sq)."""
    cols = set(metrics.columns)
    r2 = F.col("r2") if "r2" in cols else F.lit(None).cast("double")
    acc = F.col("accuracy") if "accuracy" in cols else F.lit(None).cast("double")
    sil = F.col("silhouette_sq") if "silhouette_sq" in cols else F.lit(None).cast("double")
    # Verdict thresholds and sentences.
    perf = (F.when(r2.isNotNull(), F.concat(F.lit("R² = "), short_float_str(r2), F.lit(". "),
                                            F.when(r2 > 0.9, "Excellent fit.").when(r2 > 0.7, "Good fit.")
                                            .otherwise("Moderate fit — consider feature engineering.")))
            .when(acc.isNotNull(), F.concat(F.lit("Accuracy = "), F.format_string("%.1f", acc * 100), F.lit("%. "),
                                            F.when(acc > 0.95, "Excellent.").when(acc > 0.80, "Good.")
                                            .otherwise("Consider tuning or more data.")))
            .when(sil.isNotNull(), F.concat(F.lit("Silhouette score = "), short_float_str(sil), F.lit(". "),
                                            F.when(sil > 0.5, "Good cluster separation.")
                                            .otherwise("Moderate clustering — try different k.")))
            .otherwise(F.lit("See metrics above.")))
    return metrics.select(
        "*", F.concat(F.lit(f"Completed {task_type} using "), F.col(model_name_col), F.lit(".")).alias("summary"),
        perf.alias("performance_analysis"),
        F.lit("Check feature importance chart for top predictors.").alias("key_drivers"),
        F.lit("Consider cross-validation and hyperparameter tuning for better results.").alias("recommendations"),
        F.lit("Always validate results on unseen data before production deployment.").alias("cautions"))
