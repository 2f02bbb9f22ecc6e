"""Task detection (T-1 ... T-9) over schema profiles.

``detect_task`` is keyed: the profile may hold many datasets (a ``dataset_id``
column) and ``targets`` names one target per dataset, so one Spark job
classifies every dataset at once. One dataset is the keyless case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col

# Heuristic confidences and the second-opinion threshold.
CONF_TIME_SERIES, CONF_CLUSTERING, CONF_CLASSIFICATION, CONF_REGRESSION, CONF_FALLBACK = 0.85, 0.75, 0.88, 0.90, 0.60
SECOND_OPINION_MIN = 0.7
CLASSIFICATION_MAX_UNIQUE = 20


def _with_key(df: DataFrame, key: str) -> DataFrame:
    return df if key in df.columns else df.withColumn(key, F.lit(0))


def detect_task(profile: DataFrame, targets: DataFrame, second_opinion: DataFrame | None = None,
                key: str = "dataset_id") -> DataFrame:
    """``targets``: ``(dataset_id, target_column)`` with null target meaning unsupervised.
    ``second_opinion`` (optional): ``(dataset_id, task_type, confidence, reasoning)``; it
    replaces the heuristic when its confidence exceeds 0.7 (T-5)."""
    profile, targets = _with_key(profile, key), _with_key(targets, key)
    flags = profile.groupBy(key).agg(F.max(F.col("role") == "datetime").alias("has_datetime"),
                                     F.max("n_rows").alias("n_rows"))
    tmeta = profile.select(key, F.col("column_name").alias("target_column"), F.col("role").alias("_trole"),
                           F.col("n_unique").alias("_tnu"))
    j = targets.join(flags, key, "left").join(tmeta, [key, "target_column"], "left")
    has_t = F.col("target_column").isNotNull() & (F.col("target_column") != "")
    # a target missing from the profile defaults to numeric with 10 distinct values
    trole = F.coalesce(F.col("_trole"), F.lit("numeric"))
    tnu = F.coalesce(F.col("_tnu"), F.lit(10))
    ts = F.coalesce(F.col("has_datetime"), F.lit(False)) & has_t & (F.col("_trole") == "numeric")
    cls = (trole == "categorical") | ((trole == "numeric") & (tnu <= CLASSIFICATION_MAX_UNIQUE))
    task = (F.when(ts, "time_series").when(~has_t, "clustering").when(cls, "classification")
            .when(trole == "numeric", "regression").otherwise("classification"))
    conf = (F.when(ts, CONF_TIME_SERIES).when(~has_t, CONF_CLUSTERING).when(cls, CONF_CLASSIFICATION)
            .when(trole == "numeric", CONF_REGRESSION).otherwise(CONF_FALLBACK))
    # The heuristic's explanation sentences.
    why = (F.when(ts, F.lit("Dataset has datetime column(s) and a numeric target, suggesting time-series forecasting."))
           .when(~has_t, F.lit("No target column specified — unsupervised clustering is the natural approach."))
           .when(cls, F.concat(F.lit("Target '"), F.col("target_column"), F.lit("' has "), tnu.cast("string"),
                               F.lit(" unique values — classification task.")))
           .when(trole == "numeric", F.concat(F.lit("Target '"), F.col("target_column"),
                                              F.lit("' is continuous numeric — regression task.")))
           .otherwise(F.lit("Fallback to classification based on target column analysis.")))
    out = j.select(key, F.when(has_t, F.col("target_column")).alias("target_column"),
                   task.alias("heuristic_task"), conf.alias("heuristic_confidence"), why.alias("heuristic_reasoning"))
    if second_opinion is None:
        return out.select(key, "target_column", F.col("heuristic_task").alias("task_type"),
                          F.col("heuristic_confidence").alias("confidence"),
                          F.col("heuristic_reasoning").alias("reasoning"), F.lit("heuristic").alias("source"))
    so = _with_key(second_opinion, key).select(key, F.col("task_type").alias("_so_task"),
                                               F.col("confidence").alias("_so_conf"),
                                               F.col("reasoning").alias("_so_why"))
    m = out.join(so, key, "left")
    use = F.coalesce(F.col("_so_conf") > SECOND_OPINION_MIN, F.lit(False))
    return m.select(key, "target_column", F.when(use, F.col("_so_task")).otherwise(F.col("heuristic_task")).alias("task_type"),
                    F.when(use, F.col("_so_conf")).otherwise(F.col("heuristic_confidence")).alias("confidence"),
                    F.when(use, F.coalesce(F.col("_so_why"), F.lit(""))).otherwise(F.col("heuristic_reasoning")).alias("reasoning"),
                    F.when(use, "second_opinion").otherwise("heuristic").alias("source"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """T-6: classes, n_classes, is_binary and each class's share (4 dp, nulls excluded).
    Totals are a one-row aggregate joined back (no unpartitioned window over classes)."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("class_value")) \
        .agg(F.count(F.lit(1)).alias("n"))
    tot = counts.agg(F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(tot)).select(
        "class_value", "n_classes", (F.col("n_classes") == 2).alias("is_binary"),
        F.round(F.col("n") / F.col("_t"), 4).alias("share"))


def regression_detail(df: DataFrame, target: str) -> DataFrame:
    """T-7: target range, mean and sample std."""
    v = col(target).cast("double")
    v = F.when(~F.isnan(v), v)
    return df.agg(F.min(v).alias("target_min"), F.max(v).alias("target_max"),
                  F.avg(v).alias("target_mean"), F.stddev_samp(v).alias("target_std"))


def suggested_k(df: DataFrame) -> DataFrame:
    """T-8: ``min(max(2, floor(sqrt(n) / 5)), 10)``."""
    n = F.count(F.lit(1))
    return df.agg(F.least(F.greatest(F.lit(2), F.floor(F.sqrt(n) / 5).cast("int")), F.lit(10)).alias("suggested_k"),
                  n.alias("n_rows"))


def datetime_columns(profile: DataFrame) -> DataFrame:
    """T-9: datetime-role columns in position order."""
    return profile.where(F.col("role") == "datetime").select("column_name", "position")


def subtask_info(df: DataFrame, profile: DataFrame, task: str, target: str | None = None) -> DataFrame:
    """T-6 ... T-9 as one row for a verdict: what its task asks for, the other fields null. A classification without a known
    target has two classes and no distribution."""
    empty = {"n_classes": "long", "is_binary": "boolean", "class_distribution": "map<string,double>", "target_min": "double", "target_max": "double",
             "target_mean": "double", "target_std": "double", "suggested_k": "int", "datetime_cols": "array<string>", "freq_hint": "string"}
    known = target is not None and target in df.columns
    row = df.sparkSession.range(1).select(F.lit(task).alias("task_type"))
    if task == "classification":
        if known:
            # one entry a class: as large as the result itself
            shares = class_distribution(df, target)
            pairs = F.array_sort(F.collect_list(F.struct("class_value", "share")))
            row = row.crossJoin(shares.agg(F.count(F.lit(1)).alias("n_classes"), F.map_from_entries(pairs).alias("class_distribution")))
        else:
            row = row.withColumns({"n_classes": F.lit(2).cast("long"), "class_distribution": F.expr("map()").cast("map<string,double>")})
        row = row.withColumn("is_binary", F.col("n_classes") == 2)
    elif task == "regression" and known:
        row = row.crossJoin(regression_detail(df, target))
    elif task == "clustering":
        row = row.crossJoin(suggested_k(df).select("suggested_k"))
    elif task == "time_series":
        names = F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda c: c["column_name"])
        row = row.crossJoin(datetime_columns(profile).agg(names.alias("datetime_cols"))).withColumn("freq_hint", F.lit("inferred"))
    return row.select("task_type", *[(F.col(c) if c in row.columns else F.lit(None)).cast(k).alias(c) for c, k in empty.items()])
