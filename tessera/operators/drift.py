"""Distribution drift between a reference and a current DataFrame (D-1 ... D-12).

Per feature: two-sample KS (statistic + asymptotic p), PSI on 10 reference
quantile bins, Jensen-Shannon distance on 20 pooled equal-width bins, side
means and population stds, a majority vote and a severity. ``drift_rollup``
gives the table verdict and the summary sentence.

Scale: both sides are unpivoted and tagged, then everything is grouped by
``(segment..., feature, ...)``; KS runs over distinct values with the
bucketed running totals of ``order_stats`` (no global window).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, ks_pvalue, rnd
from ..session import materialize
from .order_stats import keyed_join, running_totals, weighted_quantiles
from .stats import bin_index

# Drift thresholds.
KS_P_WARNING, KS_P_CRITICAL = 0.05, 0.01
PSI_WARNING, PSI_CRITICAL = 0.1, 0.25
JS_WARNING = 0.05
MIN_VALUES = 5
PSI_BINS = 10
JS_BINS = 20
JS_EPS = 1e-10
OVERALL_CRITICAL_RATIO = 0.3


def _tagged_long(reference: DataFrame, current: DataFrame, cols: Sequence[str],
                 segments: Sequence[str]) -> DataFrame:
    def side(df, s):
        cast = df.select(*[col(c) for c in segments], *[col(c).cast("double").alias(c) for c in cols])
        return cast.unpivot(list(segments), list(cols), "feature", "value") \
            .where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("side", F.lit(s))
    return side(reference, 0).unionByName(side(current, 1))


def drift(reference: DataFrame, current: DataFrame, cols: Sequence[str],
          segments: Sequence[str] = ()) -> DataFrame:
    """One row per (segment..., feature) with both sides holding >= 5 values.

    One pass over the raw rows builds the per-value count table
    ``(segment..., feature, value, c0, c1)``; it is materialized once (reliable
    checkpoint) and every statistic -- moments, KS, PSI edges and bins, JS bins --
    is computed from that reduced table. A value repeated a billion times is one row.
    """
    keys = list(segments) + ["feature"]
    long = _tagged_long(reference, current, cols, segments)
    vc = materialize(long.groupBy(*keys, "value").agg(
        F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1")))
    c0, c1, v = F.col("c0"), F.col("c1"), F.col("value")
    first = vc.groupBy(*keys).agg(
        F.sum("c0").alias("n_train"), F.sum("c1").alias("n_test"),
        (F.sum(c0 * v) / F.sum("c0")).alias("_m0"), (F.sum(c1 * v) / F.sum("c1")).alias("_m1"),
        F.min("value").alias("_lo"), F.max("value").alias("_hi")) \
        .where((F.col("n_train") >= MIN_VALUES) & (F.col("n_test") >= MIN_VALUES))
    # second moment around the side means (two passes over the small table: stable)
    spread = keyed_join(vc, first.select(*keys, "_m0", "_m1"), keys, "value").groupBy(*keys).agg(
        F.sqrt(F.sum(c0 * (v - F.col("_m0")) * (v - F.col("_m0"))) / F.sum("c0")).alias("_s0"),
        F.sqrt(F.sum(c1 * (v - F.col("_m1")) * (v - F.col("_m1"))) / F.sum("c1")).alias("_s1"))
    sizes = first.join(spread, keys)
    valid = keyed_join(vc, first.select(*keys, "n_train", "n_test", "_lo", "_hi"), keys, "value")

    # KS: running totals over distinct values -> max |F0 - F1|
    cum = running_totals(valid, keys, "value", ["c0", "c1"])
    ks = cum.groupBy(*keys).agg(F.max(F.abs(F.col("c0_cum") / F.col("n_train")
                                            - F.col("c1_cum") / F.col("n_test"))).alias("ks_statistic"))

    # PSI: distinct reference deciles as edges; out-of-range current values dropped
    qs = weighted_quantiles(valid, keys, "value", "c0", [i / PSI_BINS for i in range(PSI_BINS + 1)])
    edges = qs.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.collect_list("q"))).alias("edges"))
    nb = F.size("edges") - 1
    raw_bin = F.size(F.filter(F.col("edges"), lambda e: e <= F.col("value"))) - 1
    bin_counts = keyed_join(valid, edges, keys, "value").where(nb >= 2) \
        .where((F.col("value") >= F.col("edges")[0]) & (F.col("value") <= F.element_at("edges", -1))) \
        .withColumn("bin", F.least(raw_bin, nb - 1)) \
        .groupBy(*keys, "bin").agg(F.sum("c0").alias("b0"), F.sum("c1").alias("b1"))
    grid = edges.where(nb >= 2).select(*keys, F.explode(F.sequence(F.lit(0), nb - 1)).alias("bin"),
                                       nb.alias("nb"))
    pq = grid.join(bin_counts, keys + ["bin"], "left").join(sizes.select(*keys, "n_train", "n_test"), keys) \
        .select(*keys, ((F.coalesce("b0", F.lit(0)) + 1) / (F.col("n_train") + F.col("nb"))).alias("p"),
                ((F.coalesce("b1", F.lit(0)) + 1) / (F.col("n_test") + F.col("nb"))).alias("q"))
    psi = pq.groupBy(*keys).agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))

    # JS distance on pooled equal-width bins
    lo = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi = F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    jbin = valid.withColumn("bin", bin_index(F.col("value"), lo, hi, JS_BINS)) \
        .groupBy(*keys, "bin").agg(F.sum("c0").alias("b0"), F.sum("c1").alias("b1"))
    jgrid = sizes.select(*keys, "n_train", "n_test", (hi - lo).alias("_range"),
                         F.explode(F.sequence(F.lit(0), F.lit(JS_BINS - 1))).alias("bin"))
    width = F.col("_range") / JS_BINS
    dens = jgrid.join(jbin, keys + ["bin"], "left").select(
        *keys, (F.coalesce("b0", F.lit(0)) / (F.col("n_train") * width) + JS_EPS).alias("p"),
        (F.coalesce("b1", F.lit(0)) / (F.col("n_test") * width) + JS_EPS).alias("q"))
    from pyspark.sql import Window
    wk = Window.partitionBy(*keys)  # 20 rows per key: a window over the bin grid, not the data
    normed = dens.select(*keys, (F.col("p") / F.sum("p").over(wk)).alias("p"),
                         (F.col("q") / F.sum("q").over(wk)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    js = normed.groupBy(*keys).agg(F.sqrt((F.sum(F.col("p") * F.log(F.col("p") / m))
                                           + F.sum(F.col("q") * F.log(F.col("q") / m))) / 2).alias("js"))

    rep = sizes.join(ks, keys).join(psi, keys, "left").join(js, keys)
    p_ks = ks_pvalue(F.col("ks_statistic"), F.col("n_train"), F.col("n_test"))
    rep = rep.withColumn("ks_pvalue", p_ks).withColumn("psi", F.coalesce("psi", F.lit(0.0)))
    votes = ((F.col("ks_pvalue") < KS_P_WARNING).cast("int") + (F.col("psi") > PSI_WARNING).cast("int")
             + (F.col("js") > JS_WARNING).cast("int"))
    detected = votes >= 2
    critical = (F.col("ks_pvalue") < KS_P_CRITICAL) | (F.col("psi") > PSI_CRITICAL)
    return rep.select(
        *keys, "n_train", "n_test",
        detected.alias("drift_detected"),
        F.when(detected & critical, "critical").when(detected, "warning").otherwise("none").alias("severity"),
        rnd(F.col("ks_statistic"), 4).alias("ks_statistic"), rnd(F.col("ks_pvalue"), 6).alias("ks_pvalue"),
        rnd(F.col("psi"), 4).alias("psi"), rnd(F.col("js"), 4).alias("js_distance"),
        rnd(F.col("_m0"), 4).alias("train_mean"), rnd(F.col("_m1"), 4).alias("test_mean"),
        rnd(F.col("_s0"), 4).alias("train_std"), rnd(F.col("_s1"), 4).alias("test_std"))


def drift_rollup(report: DataFrame, total_features: int, segments: Sequence[str] = ()) -> DataFrame:
    """D-9/D-10: table verdict; the denominator counts every requested feature,
    skipped ones included."""
    segs = list(segments)
    agg = report.groupBy(*segs).agg(
        F.count_if("drift_detected").alias("features_drifted"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count(F.lit(1)).alias("features_tested"))
    ratio = F.col("features_drifted") / F.lit(max(total_features, 1))
    sev = F.when((F.col("critical_count") > 0) | (ratio > OVERALL_CRITICAL_RATIO), "critical") \
        .when(F.col("features_drifted") > 0, "warning").otherwise("none")
    # The three summary sentences.
    none_txt = ("No significant distribution drift detected between train and test sets. "
                "Model predictions should be reliable on this data split.")
    warn_txt = F.concat(F.col("features_drifted").cast("string"), F.lit(f"/{total_features}"),
                        F.lit(" features show distribution drift (KS test + PSI). Consider investigating these "
                              "features — they may reduce model generalizability."))
    crit_txt = F.concat(F.lit("⚠ CRITICAL: "), F.col("critical_count").cast("string"),
                        F.lit(" features show severe distribution shift. "),
                        F.col("features_drifted").cast("string"), F.lit(f"/{total_features}"),
                        F.lit(" features drifted total. Model performance on test data may be unreliable. "
                              "Recommend re-sampling or stratified splitting."))
    return agg.select(
        *segs, (F.col("features_drifted") > 0).alias("overall_drift_detected"), sev.alias("drift_severity"),
        "features_drifted", "critical_count", F.lit(total_features).cast("long").alias("total_features"),
        F.when(sev == "none", F.lit(none_txt)).when(sev == "warning", warn_txt).otherwise(crit_txt).alias("summary"))


def self_split_drift(df: DataFrame, key_cols: Sequence[str], features: Sequence[str]) -> DataFrame:
    """D-11: a table against itself. String features are encoded and missing values imputed over the whole table, as the
    reference does, then the 80 % of the deterministic split are compared with the other 20 %."""
    from .prep import hash_split, impute_median, label_encode, string_columns
    wanted = df.select(*key_cols, *[c for c in features if c not in key_cols])
    split = materialize(hash_split(wanted, key_cols))
    names = [c for c in string_columns(wanted) if c in features]
    encoded = label_encode(split, names).select("is_test", *features)
    ready = materialize(impute_median(encoded, features))
    return drift(ready.where(~F.col("is_test")), ready.where(F.col("is_test")), features)
