"""Time-series operators (TS-1 ... TS-8) and forecasters (M-16 ... M-18), keyed by series.

Raw rows are first aggregated to one value per (series, period) by Spark, so a
series is bounded by its number of periods, never by the raw row count. Index,
lags, differences and splits are window functions per series.

The forecasters are SQL expressions over each series' array of training values:

* Holt-Winters (additive): a row for each (series, alpha, beta, gamma) of the grid folds the array with level, trend, season
  and squared error as its state; the grid point with the least error forecasts.
* ARIMA(1,1,1) by conditional least squares: a fold over the differences carries the residual and its two derivatives and
  adds up the normal equations; every Gauss-Newton step takes the best of five step lengths, each by a fold of its own.
* Forest on lags: trees of all series grow level by level as rows. Every node's splits come from sums over (series, tree,
  node, lag, value), so a series is never gathered and its forecast depends on its own rows alone.

Every series of the input has rows in the result: one that is too short has a single row without step that says so in
``status``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, rnd
from ..session import materialize

# Fixed values.
MIN_POINTS = 10
TRAIN_FRACTION = 0.8
N_LAGS = 5
SEASON = 12
HW_GRID = [0.1, 0.3, 0.5, 0.7, 0.9]

OK, TOO_SHORT = "ok", "Time series requires at least 10 data points."
#: Gauss-Newton steps of ARIMA, the step lengths tried in each (0 ends it where none helps), bound of both coefficients.
ARIMA_STEPS, STEP_LENGTHS, BOUND = 12, (1.0, 0.5, 0.25, 0.0625, 0.0), 0.99
FOREST_TREES, FOREST_DEPTH = 100, 12


def period_series(df: DataFrame, ts: str, value: str, keys: Sequence[str] = (), unit: str = "month",
                  agg: str = "sum") -> DataFrame:
    """Aggregate raw rows to one value per (series_key, period); nulls dropped (TS-1)."""
    key = F.concat_ws("|", *[col(k).cast("string") for k in keys]) if keys else F.lit("all")
    v = col(value).cast("double")
    fn = {"sum": F.sum, "avg": F.avg, "count": F.count}[agg]
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(key.alias("series_key"),
                                                         F.date_trunc(unit, col(ts)).alias("t")) \
        .agg(fn(v).cast("double").alias("value"))


def indexed(series: DataFrame) -> DataFrame:
    """TS-1/TS-2: idx = 0..n-1 in time order, n per series; series shorter than 10 are left to ``too_short``."""
    w = Window.partitionBy("series_key").orderBy("t")
    return series.withColumn("idx", (F.row_number().over(w) - 1).cast("int")) \
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series_key")).cast("int")) \
        .where(F.col("n") >= MIN_POINTS)


def too_short(series: DataFrame) -> DataFrame:
    """TS-2: a forecast row with the reason for every series of fewer than 10 points."""
    short = series.groupBy("series_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < MIN_POINTS)
    return short.select("series_key", F.lit(None).cast("int").alias("step"), F.lit(None).cast("string").alias("segment"),
                        *[F.lit(None).cast("double").alias(c) for c in ("actual", "forecast", "aic")], F.lit(TOO_SHORT).alias("status"))


def lag_matrix(series: DataFrame, lags: int = N_LAGS) -> DataFrame:
    """TS-4/TS-8: lag_1 ... lag_k (lag_k oldest) and the first difference."""
    w = Window.partitionBy("series_key").orderBy("idx")
    out = indexed(series)
    for k in range(1, lags + 1):
        out = out.withColumn(f"lag_{k}", F.lag("value", k).over(w))
    return out.withColumn("diff_1", F.col("value") - F.col("lag_1"))


def split_segments(series: DataFrame, frac: float = TRAIN_FRACTION) -> DataFrame:
    """TS-3: the first floor(frac * n) points of each series are train."""
    ix = indexed(series)
    cut = F.floor(F.col("n") * frac).cast("int")
    return ix.withColumn("train_size", cut) \
        .withColumn("segment", F.when(F.col("idx") < cut, "train").otherwise("test"))


# --- folds over a series' training values -----------------------------------

def _let(value: Column, fn) -> Column:
    """fn(value) with ``value`` evaluated once."""
    return F.transform(F.array(value), fn)[0]


def _training(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points with their segment, one row a series: x, the training values in order, and horizon)."""
    points = split_segments(series).select("series_key", "idx", "n", "train_size", "segment", "value")
    train = points.where("segment = 'train'").groupBy("series_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda p: p["value"]).alias("x"),
        F.max(F.col("n") - F.col("train_size")).alias("horizon"))
    return points, train


def holt_winters(train: DataFrame, m: int = SEASON) -> DataFrame:
    """(series_key, path): the forecasts of steps 1 ... horizon by the best of the grid. A season needs two full cycles;
    without them gamma is 0 and the season stays 0."""
    grid = F.array(*[F.lit(g) for g in HW_GRID])
    x, n = F.col("x"), F.size("x")
    seasonal = n >= 2 * m
    rows = train.select("series_key", "x", "horizon", F.explode(grid).alias("a")).select("*", F.explode(grid).alias("b")).select(
        "*", F.explode(F.when(seasonal, grid).otherwise(F.array(F.lit(0.0)))).alias("g"))

    def mean(v):
        return F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / F.size(v)

    first, second = mean(F.slice(x, 1, m)), mean(F.slice(x, m + 1, m))
    level = F.when(seasonal, first).otherwise(x[0])
    trend = F.when(seasonal, (second - first) / m).otherwise(x[1] - x[0])
    season = F.when(seasonal, F.transform(F.slice(x, 1, m), lambda y: y - first)).otherwise(F.array_repeat(F.lit(0.0), m))
    start = F.struct(level.alias("level"), trend.alias("trend"), season.alias("season"), F.lit(0.0).alias("sse"))

    def step(state, y):
        s = state["season"][0]  # the queue's head is the season of this period
        ahead = state["level"] + state["trend"]
        new = F.col("a") * (y - s) + (1 - F.col("a")) * ahead
        return _let(new, lambda now: F.struct(
            now.alias("level"), (F.col("b") * (now - state["level"]) + (1 - F.col("b")) * state["trend"]).alias("trend"),
            F.concat(F.slice(state["season"], 2, m - 1), F.array(F.col("g") * (y - now) + (1 - F.col("g")) * s)).alias("season"),
            (state["sse"] + (y - ahead - s) * (y - ahead - s)).alias("sse")))

    fitted = rows.withColumn("end", F.aggregate("x", start, step))
    best = fitted.groupBy("series_key").agg(F.min(F.struct("end.sse", "a", "b", "g", "end.level", "end.trend", "end.season", "horizon")).alias("f"))
    path = F.transform(F.sequence(F.lit(1), F.col("f.horizon")), lambda h: F.col("f.level") + h * F.col("f.trend") + F.col("f.season")[(h - 1) % m])
    return best.select("series_key", F.when(F.col("f.horizon") > 0, path).alias("path"), F.lit(None).cast("double").alias("aic"))


def _residuals(phi: Column, theta: Column) -> Column:
    """Fold of the differences ``w``: squared residuals and the normal equations of their derivatives."""
    names = ("w", "e", "p", "q", "sse", "pp", "pq", "qq", "pe", "qe")
    start = F.struct(F.col("w")[0].alias("w"), *[F.lit(0.0).alias(c) for c in names[1:]])

    def step(s, w):
        # e = w - phi w' - theta e', p = de / dphi, q = de / dtheta
        now = F.array(w - phi * s["w"] - theta * s["e"], -s["w"] - theta * s["p"], -s["e"] - theta * s["q"])
        return _let(now, lambda v: F.struct(
            w.alias("w"), v[0].alias("e"), v[1].alias("p"), v[2].alias("q"), (s["sse"] + v[0] * v[0]).alias("sse"), (s["pp"] + v[1] * v[1]).alias("pp"),
            (s["pq"] + v[1] * v[2]).alias("pq"), (s["qq"] + v[2] * v[2]).alias("qq"), (s["pe"] + v[1] * v[0]).alias("pe"), (s["qe"] + v[2] * v[0]).alias("qe")))

    return F.aggregate(F.slice("w", 2, F.size("w") - 1), start, step)


def arima_111(train: DataFrame) -> DataFrame:
    """(series_key, path, aic) by conditional least squares of w_t = phi w_(t-1) + e_t + theta e_(t-1) on the differences w."""
    x, n = F.col("x"), F.size("x")
    w = F.transform(F.sequence(F.lit(1), n - 1), lambda i: x[i] - x[i - 1])
    rows = train.select("series_key", "horizon", x[n - 1].alias("last"), w.alias("w"))

    def held(v):
        return F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), v))

    def improve(state, _):
        def moved(f):
            pp, qq = f["pp"] * 1.001, f["qq"] * 1.001
            det = pp * qq - f["pq"] * f["pq"]
            move = F.when(det > 0, F.array((f["pq"] * f["qe"] - qq * f["pe"]) / det, (f["pq"] * f["pe"] - pp * f["qe"]) / det)).otherwise(
                F.array(F.lit(0.0), F.lit(0.0)))
            return _let(move, lambda d: F.array_min(F.transform(
                F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(STEP_LENGTHS)]), lambda c: _let(
                    F.struct(held(state["phi"] + c["v"] * d[0]).alias("phi"), held(state["theta"] + c["v"] * d[1]).alias("theta")),
                    lambda t: F.struct(_residuals(t["phi"], t["theta"])["sse"].alias("sse"), c["k"].alias("k"), t["phi"].alias("phi"),
                                       t["theta"].alias("theta"))))))
        return _let(_let(_residuals(state["phi"], state["theta"]), moved), lambda b: F.struct(b["phi"].alias("phi"), b["theta"].alias("theta")))

    start = F.struct(F.lit(0.1).alias("phi"), F.lit(0.1).alias("theta"))
    rows = rows.withColumn("c", F.aggregate(F.sequence(F.lit(1), F.lit(ARIMA_STEPS)), start, improve))
    rows = rows.withColumn("f", _residuals(F.col("c.phi"), F.col("c.theta")))
    size = (F.size("w") - 1).cast("double")
    variance = F.greatest(F.col("f.sse") / size, F.lit(1e-300))
    aic = size * F.log(2 * math.pi * variance) + size + 2 * 3
    ahead = F.col("c.phi") * F.col("f.w") + F.col("c.theta") * F.col("f.e")
    # the first difference ahead, then each phi times the one before; their running sum on the last value
    grown = F.aggregate(F.sequence(F.lit(1), F.col("horizon")),
                        F.struct(ahead.alias("d"), F.col("last").alias("v"), F.array().cast("array<double>").alias("path")),
                        lambda s, h: F.struct((s["d"] * F.col("c.phi")).alias("d"), (s["v"] + s["d"]).alias("v"),
                                              F.concat(s["path"], F.array(s["v"] + s["d"])).alias("path")))
    return rows.select("series_key", grown["path"].alias("path"), aic.alias("aic"))


def forecast(series: DataFrame, method: str) -> DataFrame:
    """M-16 (``arima``) / M-17 (``exponential_smoothing``): multi-step forecast of each series' test horizon. Returns train and
    test rows (``forecast`` null on train), ``aic`` and ``status``."""
    points, train = _training(series)
    fitted = holt_winters(train) if method == "exponential_smoothing" else arima_111(train)
    rows = points.join(fitted, "series_key").select(
        "series_key", F.col("idx").alias("step"), "segment", F.col("value").alias("actual"),
        F.when(F.col("segment") == "test", F.col("path")[F.col("idx") - F.col("train_size")]).alias("forecast"), "aic", F.lit(OK).alias("status"))
    return rows.unionByName(too_short(series))


# --- forest on lags ----------------------------------------------------------

def _drawn(key: Column) -> Column:
    """How often a row is in a tree's sample: Poisson of mean 1 from the row's hash, so any row's draws are its own."""
    u = F.pmod(F.xxhash64(key, "_row", "tree", F.lit("bootstrap")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    out, total, p = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, 9):
        total += p
        out = F.when(u >= total, k).otherwise(out)
        p /= k
    return out


def forecast_rf(series: DataFrame, lags: int = N_LAGS, num_trees: int = FOREST_TREES, depth: int = FOREST_DEPTH) -> DataFrame:
    """M-18: one-step forecasts from a random forest on the last ``lags`` values, grown for each series by itself; lag rows
    are split chronologically at floor(0.8 (n - lags)) per series (TS-5).

    Trees are grown on samples with replacement over all lags until nodes are pure, or to ``depth``. Test rows go down
    with the others and count nothing.
    """
    lm = lag_matrix(series, lags).where(F.col(f"lag_{lags}").isNotNull())
    x = F.array(*[F.col(f"lag_{k}") for k in range(1, lags + 1)])
    lm = lm.withColumn("_row", F.col("idx") - lags).withColumn(
        "segment", F.when(F.col("_row") < F.floor((F.col("n") - lags) * TRAIN_FRACTION), "train").otherwise("test"))
    lm = materialize(lm.select("series_key", "idx", "_row", "segment", F.col("value").alias("y"), x.alias("x")))
    rows = lm.select("*", F.explode(F.sequence(F.lit(0), F.lit(num_trees - 1))).alias("tree"))
    rows = rows.withColumn("w", F.when(F.col("segment") == "train", _drawn(F.col("series_key"))).otherwise(0))
    rows = materialize(rows.where((F.col("w") > 0) | (F.col("segment") == "test")).withColumn("node", F.lit(1).cast("long")))
    node = ["series_key", "tree", "node"]
    leaves = []
    for level in range(depth + 1):
        split = _splits(rows, node) if level < depth else rows.select(*node, F.lit(0).alias("f"), F.lit(0.0).alias("at")).limit(0)
        marked = materialize(rows.join(split, node, "left"))
        means = marked.where("f is null").groupBy(*node).agg(F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w")).alias("mean"))
        leaves.append(marked.where("f is null and segment = 'test'").join(means, node).select("series_key", "idx", "y", "mean"))
        rows = marked.where("f is not null").withColumn("node", F.col("node") * 2 + (F.col("x")[F.col("f")] > F.col("at")).cast("long")).drop("f", "at")
        if rows.isEmpty():
            break
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    # every tree has a value for every test row: a node is only split where both sides hold sampled rows
    out = found.groupBy("series_key", "idx", "y").agg(F.avg("mean").alias("forecast"))
    none = F.lit(None).cast("double")
    test = out.select("series_key", F.col("idx").alias("step"), F.lit("test").alias("segment"), F.col("y").alias("actual"), "forecast", none.alias("aic"),
                      F.lit(OK).alias("status"))
    train = lm.where("segment = 'train'").select("series_key", F.col("idx").alias("step"), "segment", F.col("y").alias("actual"), none.alias("forecast"),
                                                 none.alias("aic"), F.lit(OK).alias("status"))
    return train.unionByName(test).unionByName(too_short(series))


def _splits(rows: DataFrame, node: list[str]) -> DataFrame:
    """(node, f, at): each node's split with the largest fall of the squared error, between two values of a lag that sampled
    rows of the node have. Ties go to the smaller lag, then the smaller value; pure nodes have none."""
    w, y = F.col("w"), F.col("y")
    values = rows.where("w > 0").select(*node, "w", "y", F.posexplode("x").alias("f", "v"))
    sums = values.groupBy(*node, "f", "v").agg(F.sum("w").alias("n"), F.sum(w * y).alias("s"), F.min("y").alias("low"), F.max("y").alias("high"))
    along = Window.partitionBy(*node, "f").orderBy("v")
    so_far, whole = along.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*node, "f")
    sums = sums.select(*node, "f", "v", F.lead("v").over(along).alias("next"), F.sum("n").over(so_far).alias("n_l"), F.sum("s").over(so_far).alias("s_l"),
                       F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"), F.min("low").over(whole).alias("low"), F.max("high").over(whole).alias("high"))
    right, n_r = F.col("s") - F.col("s_l"), F.col("n") - F.col("n_l")
    gain = F.col("s_l") * F.col("s_l") / F.col("n_l") + right * right / n_r
    best = sums.where("next is not null and low < high").groupBy(*node).agg(
        F.min(F.struct((-gain).alias("loss"), F.col("f"), ((F.col("v") + F.col("next")) / 2).alias("at"))).alias("b"))
    return best.select(*node, F.col("b.f").alias("f"), F.col("b.at").alias("at"))


def forecast_metrics(fc: DataFrame, with_r2: bool = False) -> DataFrame:
    """TS-7: RMSE / MAE (+ R^2, AIC when present) and the status per series over the test rows; a series without any has
    no metrics."""
    test, e = F.col("segment") == "test", F.col("actual") - F.col("forecast")
    agg = fc.groupBy("series_key").agg(
        F.count(F.when(test, 1)).alias("n_test"), F.sum(F.when(test, e * e)).alias("_sse"), F.avg(F.when(test, F.abs(e))).alias("_mae"),
        F.var_pop(F.when(test, F.col("actual"))).alias("_v"), F.max("aic").alias("_aic"), F.max("status").alias("status"))
    cols = ["series_key", "n_test", rnd(F.sqrt(F.try_divide(F.col("_sse"), F.col("n_test")))).alias("rmse"),
            rnd(F.col("_mae")).alias("mae"), rnd(F.col("_aic")).alias("aic")]
    if with_r2:
        cols.append(rnd(F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_v") * F.col("n_test"))).alias("r2"))
    return agg.select(*cols, "status")
