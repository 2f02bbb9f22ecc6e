"""Exploratory statistics (E-1 ... E-13), each a DataFrame in long form.

Every operator takes explicit column lists; ``numeric_role_columns`` derives
them from a profile (the profile has one row per column, so collecting it is
metadata, not data).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import (clean_value, col, dagostino_k2_pvalue, INVERSE_NORMAL_STEPS, is_missing, rnd, safe4,
                               sample_excess_kurtosis, sample_skewness, with_steps)
from . import normality as normality_steps
from .order_stats import column_quantiles, quantile_columns, running_totals, to_long, top_k

# Thresholds of the exploratory report.
HIST_BINS = 20
MIN_ROWS_DISTRIBUTION = 5      # histogram / normality need at least this many values
MIN_ROWS_OUTLIERS = 4
MIN_ROWS_K2 = 8                # the kurtosis transform of K^2 needs at least this many
NORMAL_ALPHA = 0.05
IQR_K = 1.5
TOP_VALUES = 10
MOMENT_ROWS = 4096             # rows whose products are formed at a time


def role_columns(profile: DataFrame, roles: Sequence[str] = ("numeric",)) -> list[str]:
    rows = profile.select("column_name", "position", "role").collect()
    return [r["column_name"] for r in sorted(rows, key=lambda r: r["position"]) if r["role"] in roles]


def role_counts(profile: DataFrame) -> DataFrame:
    """E-1: number of columns per role."""
    return profile.groupBy("role").agg(F.count(F.lit(1)).alias("n_columns"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """E-2: rows identical to an earlier row (nulls equal; NaN treated as null).

    Rows are compared by a 128-bit hash, so long texts are not shuffled; partial aggregation
    collapses hot duplicates map-side, so a row repeated a billion times ships one hash per partition.
    """
    values = []
    for f in df.schema.fields:
        v = clean_value(col(f.name), f.dataType)
        v = v + F.lit(0.0).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else v  # -0.0 is 0.0
        values.append(F.struct(v.isNull(), v))  # a hash skips nulls: say where they are
    hashes = [F.xxhash64(F.lit(k), *values).alias(f"_h{k}") for k in range(2)]
    return df.select(*hashes).groupBy("_h0", "_h1").agg(F.count(F.lit(1)).alias("_c")) \
        .agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def missing_counts(df: DataFrame) -> DataFrame:
    """Per column missing count over the whole table (one aggregate)."""
    fields = df.schema.fields
    one = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 *[F.count_if(is_missing(col(f.name), f.dataType)).alias(f"_m{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("position"),
                              F.col(f"_m{i}").cast("long").alias("n_missing")) for i, f in enumerate(fields)])
    return one.select("n_rows", F.explode(rows).alias("r")).select("r.*", "n_rows")


def missing_table(df: DataFrame) -> DataFrame:
    """E-6: columns with at least one missing value, count and percent (2 dp)."""
    m = missing_counts(df)
    return m.where(F.col("n_missing") > 0).select(
        "column_name", F.col("n_missing").alias("missing_count"),
        F.round(F.col("n_missing") * 100.0 / F.col("n_rows"), 2).alias("missing_pct"))


def numeric_stats(df: DataFrame, cols: Sequence[str], exact: bool = True) -> DataFrame:
    """E-4a-d: mean, median, sample std, min, max, q25, q75, G1 skewness, G2 excess kurtosis.

    Moments in one aggregate, exact quantiles from the bucketed value table; nothing runs while building."""
    long = to_long(df, cols)
    moments = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"),
        F.min("value").alias("_min"), F.max("value").alias("_max"),
        F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2"))
    probs = {"_q25": 0.25, "_median": 0.5, "_q75": 0.75}
    qs = column_quantiles(df, cols, probs) if exact else quantile_columns(long, ["column_name"], "value", probs, exact=False)
    return moments.join(qs, "column_name").select(
        "column_name", "n", safe4(F.col("_mean")).alias("mean"), safe4(F.col("_median")).alias("median"),
        safe4(F.col("_std")).alias("std"), safe4(F.col("_min")).alias("min"), safe4(F.col("_max")).alias("max"),
        safe4(F.col("_q25")).alias("q25"), safe4(F.col("_q75")).alias("q75"),
        safe4(sample_skewness(F.col("n"), F.col("_g1"))).alias("skewness"),
        safe4(sample_excess_kurtosis(F.col("n"), F.col("_g2"))).alias("kurtosis"))


def top_values(df: DataFrame, cols: Sequence[str], k: int = TOP_VALUES) -> DataFrame:
    """E-5: top-k normalized value frequencies per column (count desc, value asc)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    strs = df.select(*[clean_value(col(c), fields[c]).cast("string").alias(c) for c in cols])
    long = strs.unpivot([], list(cols), "column_name", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("_total"))
    ranked = top_k(counts, ["column_name"], [F.col("n").desc(), F.col("value")], k)
    return ranked.join(totals, "column_name").select(
        "column_name", "rank", "value", F.col("n").alias("count"),
        F.round(F.col("n") / F.col("_total"), 4).alias("freq"))


def _bounds(long: DataFrame) -> DataFrame:
    """Per column min/max widened by 0.5 when constant (NumPy's histogram rule)."""
    b = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("_mn"),
                                   F.max("value").alias("_mx"))
    same = F.col("_mn") == F.col("_mx")
    return b.select("column_name", "n",
                    F.when(same, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
                    F.when(same, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"))


def bin_index(v: F.Column, lo: F.Column, hi: F.Column, bins: int) -> F.Column:
    """Equal-width bin, last bin closed: ``least(bins-1, floor((v-lo)*bins/(hi-lo)))``."""
    return F.least(F.lit(bins - 1), F.floor((v - lo) * bins / (hi - lo)).cast("int"))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = HIST_BINS,
              min_rows: int = MIN_ROWS_DISTRIBUTION) -> DataFrame:
    """E-8: ``column, bin, lo, hi, count`` with empty bins present; columns with < min_rows skipped."""
    long = to_long(df, cols)
    bounds = _bounds(long).where(F.col("n") >= min_rows)
    # bounds: one row per column -> broadcast join, data side not shuffled
    binned = long.join(F.broadcast(bounds), "column_name") \
        .select("column_name", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
    counts = binned.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = bounds.select("column_name", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, ["column_name", "bin"], "left").select(
        "column_name", "bin", rnd(F.col("lo") + F.col("bin") * width).alias("lo"),
        rnd(F.col("lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


#: Ranks that one row stands for when equal values are spelt out; a value holding more is split first.
RANKS_PER_ROW = 4096


def normality(df: DataFrame, cols: Sequence[str], alpha: float = NORMAL_ALPHA) -> DataFrame:
    """E-7: Shapiro-Wilk W and D'Agostino's K^2 of every column with at least 5 values, over all rows.

    Ranks come from the bucketed running totals of the distinct values; W's sums are grouped sums over ranks.
    ``w_p_value`` is null for n > 5000, where its approximation is not published, ``k2_p_value`` for n < 8.
    ``is_normal`` goes by W's p-value where there is one, else by K^2's."""
    long = to_long(df, cols)
    counted = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c"))
    mom = _shape(long).where(F.col("n") >= MIN_ROWS_DISTRIBUTION)
    ranked = running_totals(counted, ["column_name"], "value", ["c"]).join(
        F.broadcast(mom.select("column_name", "n", "_mean")), "column_name").withColumn("lo", F.col("c_cum") - F.col("c"))
    parts = ranked.select("*", F.explode(F.sequence(F.col("lo"), F.col("c_cum") - 1, F.lit(RANKS_PER_ROW).cast("long"))).alias("at"))
    rows = parts.withColumn("i", F.explode(F.sequence(F.col("at") + 1, F.least(F.col("at") + RANKS_PER_ROW, F.col("c_cum")))))
    rows = with_steps(rows.withColumn("p", (F.col("i") - 0.375) / (F.col("n") + 0.25)), INVERSE_NORMAL_STEPS)
    i, n, v = F.col("i"), F.col("n"), F.col("value")
    sums = rows.groupBy("column_name").agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * v).alias("mx"),
        F.sum((v - F.col("_mean")) * (v - F.col("_mean"))).alias("ss"), F.max(F.when(i == n, F.col("m"))).alias("m1"),
        F.max(F.when(i == n - 1, F.col("m"))).alias("m2"), F.min("value").alias("x1"), F.max("value").alias("y1"),
        F.max(F.when(i == 2, v)).alias("x2"), F.max(F.when(i == n - 1, v)).alias("y2"))
    out = sums.join(mom, "column_name").withColumn("n", F.col("n").cast("double"))
    out = with_steps(out, normality_steps.STEPS)
    k2 = F.when(F.col("n") >= MIN_ROWS_K2, dagostino_k2_pvalue(F.col("n"), F.col("_g1"), F.col("_g2")))
    return out.select("column_name", F.col("n").cast("long").alias("n"), rnd(F.col("w"), 6).alias("w_statistic"),
                      rnd(F.col("w_p"), 6).alias("w_p_value"), rnd(k2, 6).alias("k2_p_value"),
                      F.coalesce(F.coalesce(F.col("w_p"), k2) > alpha, F.lit(False)).alias("is_normal"))


def _shape(long: DataFrame) -> DataFrame:
    return long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("_mean"),
                                           F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2"))


def normality_k2(df: DataFrame, cols: Sequence[str], alpha: float = NORMAL_ALPHA) -> DataFrame:
    """E-7a alone: D'Agostino-Pearson for every column with n >= 8 (pure SQL expressions, one aggregate)."""
    mom = _shape(to_long(df, cols)).where(F.col("n") >= MIN_ROWS_K2)
    p = dagostino_k2_pvalue(F.col("n"), F.col("_g1"), F.col("_g2"))
    return mom.select("column_name", "n", safe4(p, 6).alias("p_value"), (p > alpha).alias("is_normal"))


def _co_moments(batches, k: int):
    """One row a task: for each pair of k columns, rows where both are there, their means and centred products there."""
    n, mean, square, cross = None, None, None, None  # mean, square: [a, b] of a where b is there too
    for batch in batches:
        for at in range(0, batch.num_rows, MOMENT_ROWS):
            part = batch.slice(at, MOMENT_ROWS)
            x = np.column_stack([np.asarray(c.fill_null(np.nan), float) for c in part.columns])
            here = ~np.isnan(x)
            low = np.where(here, x, 0.0).sum(axis=0) / np.maximum(here.sum(axis=0), 1)
            z, m = np.where(here, x - low, 0.0), here.astype(float)
            count = m.T @ m
            some = np.maximum(count, 1)
            own = (z.T @ m) / some
            part_square = (z * z).T @ m - count * own * own
            part_cross = z.T @ z - count * own * own.T
            own = own + low[:, None]
            if n is None:
                n, mean, square, cross = count, own, part_square, part_cross
                continue
            total = np.maximum(n + count, 1)
            apart = np.where((n > 0) & (count > 0), own - mean, 0.0)
            weight = n * count / total
            square, cross = square + part_square + weight * apart * apart, cross + part_cross + weight * apart * apart.T
            mean = np.where(n > 0, mean + apart * count / total, own)
            n = n + count
    if n is not None:
        a, b = (i.ravel() for i in np.indices((k, k)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array(v.ravel()) for v in (n, mean, mean.T, square, square.T, cross))],
                                         ["a", "b", "n", "ma", "mb", "va", "vb", "c"])


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E-9: pairwise-complete Pearson r for every ordered pair (full square), undefined -> 0.

    One scan for any number of columns: every task merges centred co-moments of blocks of rows by matrix products, one
    row a pair; the tasks' moments are merged about the pair's common means by two grouped sums.
    """
    cols = list(cols)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    fields = {f.name: f.dataType for f in df.schema.fields}
    k = len(cols)
    values = df.select(*[clean_value(col(c), fields[c]).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = values.mapInArrow(lambda batches: _co_moments(batches, k),
                              "a long, b long, n double, ma double, mb double, va double, vb double, c double").where("n > 0")
    pair = Window.partitionBy("a", "b")
    total = F.sum("n").over(pair)
    parts = parts.withColumns({"da": F.col("ma") - F.sum(F.col("n") * F.col("ma")).over(pair) / total,
                               "db": F.col("mb") - F.sum(F.col("n") * F.col("mb")).over(pair) / total})
    sums = parts.groupBy("a", "b").agg(*[F.sum(F.col(v) + F.col("n") * F.col(x) * F.col(y)).alias(v)
                                         for v, x, y in (("va", "da", "da"), ("vb", "db", "db"), ("c", "da", "db"))])
    names = F.array(*[F.lit(c) for c in cols])
    pairs = df.sparkSession.range(k * k).select(F.expr(f"id div {k}").alias("a"), (F.col("id") % k).alias("b"))
    r = F.try_divide(F.col("c"), F.sqrt(F.col("va") * F.col("vb")))
    return pairs.join(F.broadcast(sums), ["a", "b"], "left").select(  # one row a pair of columns
        names[F.col("a").cast("int")].alias("col_a"), names[F.col("b").cast("int")].alias("col_b"),
        F.when(F.col("a") == F.col("b"), F.when(F.col("va") > 0, 1.0).otherwise(0.0)).otherwise(safe4(r)).alias("r"))


def iqr_fences(df: DataFrame, cols: Sequence[str], k: float = IQR_K, exact: bool = True) -> DataFrame:
    long = to_long(df, cols)
    n = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
    probs = {"q1": 0.25, "q3": 0.75}
    qs = column_quantiles(df, cols, probs) if exact else quantile_columns(long, ["column_name"], "value", probs, exact=False)
    iqr = F.col("q3") - F.col("q1")
    return qs.join(n, "column_name").select("column_name", "n", "q1", "q3", (F.col("q1") - k * iqr).alias("lower"),
                                            (F.col("q3") + k * iqr).alias("upper"))


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = IQR_K, exact: bool = True) -> DataFrame:
    """E-10: strict IQR fences; columns with n >= 4 and at least one outlier.
    Outliers are counted on the scan, all columns side by side against one broadcast row of fences; one row a task is shuffled."""
    fences = iqr_fences(df, cols, k, exact).where(F.col("n") >= MIN_ROWS_OUTLIERS)
    values, sides, counts = [], [], []
    for i, c in enumerate(cols):
        v = col(c).cast("double")
        values.append(F.when(~F.isnan(v), v).alias(f"v{i}"))
        sides += [F.max(F.when(F.col("column_name") == c, F.col(side))).alias(f"{side}{i}") for side in ("lower", "upper")]
        out = F.count_if((F.col(f"v{i}") < F.col(f"lower{i}")) | (F.col(f"v{i}") > F.col(f"upper{i}")))
        counts.append(F.struct(F.lit(c).alias("column_name"), out.alias("n_outliers")))
    one = df.select(*values).crossJoin(F.broadcast(fences.agg(*sides))).agg(F.array(*counts).alias("r"))  # one row
    flagged = one.select(F.explode("r").alias("r")).select("r.*")
    return flagged.join(fences, "column_name").where(F.col("n_outliers") > 0).select(
        "column_name", F.col("n_outliers").cast("long").alias("n_outliers"),
        F.round(F.col("n_outliers") * 100.0 / F.col("n"), 2).alias("pct"),
        safe4(F.col("lower")).alias("lower_bound"), safe4(F.col("upper")).alias("upper_bound"))


def quality_inputs(df: DataFrame, numeric_cols: Sequence[str], exact: bool = True) -> DataFrame:
    """One row: n_rows, total_missing_cells, n_missing_cols, duplicate_rows, mean_outlier_pct, n_outlier_cols."""
    miss = missing_counts(df).groupBy().agg(
        F.max("n_rows").alias("n_rows"), F.sum("n_missing").alias("total_missing_cells"),
        F.count_if(F.col("n_missing") > 0).alias("n_missing_cols"))
    if numeric_cols:
        outl = iqr_outliers(df, numeric_cols, exact=exact).agg(F.avg("pct").alias("mean_outlier_pct"),
                                                               F.count(F.lit(1)).alias("n_outlier_cols"))
    else:
        outl = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("mean_outlier_pct"),
                                               F.lit(0).cast("long").alias("n_outlier_cols"))
    return miss.crossJoin(F.broadcast(duplicate_rows(df))).crossJoin(F.broadcast(outl))  # one-row frames


def quality_score(df: DataFrame, numeric_cols: Sequence[str], exact: bool = True) -> DataFrame:
    """E-11 + E-13: one row with the inputs, the score (1 dp), grade and missing-cell share."""
    return scored_quality(quality_inputs(df, numeric_cols, exact), len(df.columns))


def scored_quality(one: DataFrame, n_cols: int, more: Sequence[str] = ()) -> DataFrame:
    """The score of ``quality_inputs``' row; ``more`` names inputs to pass through."""
    n = F.col("n_rows").cast("double")
    missing_pct = F.col("total_missing_cells") * 100.0 / (n * n_cols)
    dup_pct = F.col("duplicate_rows") * 100.0 / n
    raw = (F.lit(100.0) - F.least(missing_pct * 2, F.lit(30.0)) - F.least(dup_pct, F.lit(20.0))
           - F.coalesce(F.least(F.col("mean_outlier_pct"), F.lit(15.0)), F.lit(0.0)))
    score = F.when(n > 0, F.round(F.greatest(raw, F.lit(0.0)), 1)).otherwise(F.lit(0.0))
    return one.select(
        F.col("n_rows").cast("long").alias("n_rows"), F.lit(n_cols).cast("long").alias("n_cols"),
        F.col("total_missing_cells").cast("long").alias("total_missing_cells"), "duplicate_rows",
        rnd(F.col("mean_outlier_pct"), 4).alias("mean_outlier_pct"),
        score.alias("quality_score"),
        F.when(score >= 80, "good").when(score >= 60, "fair").otherwise("poor").alias("quality_grade"),
        F.when(n > 0, F.round(missing_pct, 2)).otherwise(F.lit(0.0)).alias("missing_cells_pct"), *more)


def eda_report(df: DataFrame, profile: DataFrame | None = None, exact: bool = True) -> dict[str, DataFrame]:
    """E-12: the full report as named DataFrames (lazy; the caller decides what to run)."""
    from .profile import schema_profile
    profile = profile if profile is not None else schema_profile(df, exact=exact)
    num = role_columns(profile, ("numeric",))
    cat = role_columns(profile, ("categorical",))
    return {
        "profile": profile,
        "role_counts": role_counts(profile),
        "numeric_stats": numeric_stats(df, num, exact) if num else None,
        "categorical_freq": top_values(df, cat) if cat else None,
        "missing": missing_table(df),
        "histograms": histogram(df, num) if num else None,
        "normality": normality(df, num) if num else None,
        "correlations": correlations(df, num),
        "outliers": iqr_outliers(df, num, exact=exact) if num else None,
        "quality": quality_score(df, num, exact),
    }
