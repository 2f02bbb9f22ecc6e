"""Clustering re-aims, encoders and model-key paths on small generated inputs."""

import numpy as np
from pyspark.sql import functions as F


def _blobs(spark, centers, n=60, spread=0.1, seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for c in centers:
        for p in rng.normal(c, spread, size=(n, len(c))):
            rows.append((i, [float(x) for x in p]))
            i += 1
    return spark.createDataFrame(rows, "id long, v array<double>")


def test_grid_density_separates_blobs_and_flags_noise(spark):
    from tessera.operators.cluster import grid_density_clusters
    df = _blobs(spark, [(0.0, 0.0), (5.0, 5.0)]).unionByName(
        spark.createDataFrame([(999, [20.0, -20.0])], "id long, v array<double>"))
    lab = {r["id"]: r["cluster"] for r in grid_density_clusters(df, "v", "id", eps=0.5, min_samples=5).collect()}
    assert lab[999] == -1
    assert len({lab[i] for i in range(60)}) == 1 and len({lab[i] for i in range(60, 120)}) == 1
    assert lab[0] != lab[60] and -1 not in (lab[0], lab[60])


def test_ward_recovers_three_blobs(spark):
    from tessera.operators.ward import ward_clusters
    df = _blobs(spark, [(0.0, 0.0), (6.0, 0.0), (0.0, 6.0)], n=40)
    lab = {r["id"]: r["cluster"] for r in ward_clusters(df, "v", "id", k=3).collect()}
    groups = [{lab[i] for i in range(b, b + 40)} for b in (0, 40, 80)]
    assert all(len(g) == 1 for g in groups) and len(set().union(*groups)) == 3


def test_robust_scale_and_target_encode(spark):
    from tessera.operators.features import robust_scale, target_encode
    df = spark.createDataFrame([(float(x), "a" if x < 3 else "b", float(x % 2)) for x in range(6)],
                               "x double, g string, y double")
    rs = sorted(r["x"] for r in robust_scale(df, ["x"]).collect())
    med, iqr = np.median(range(6)), np.quantile(range(6), 0.75) - np.quantile(range(6), 0.25)
    assert np.allclose(rs, [(v - med) / iqr for v in range(6)])
    te = {r["g"]: r["g_te"] for r in target_encode(df, "g", "y").collect()}
    assert te["a"] == np.mean([0, 1, 0]) and te["b"] == np.mean([1, 0, 1])


def test_kernel_and_forest_keys_fit(spark, regression_df):
    from tessera.operators.models import fit_eval
    from tessera.operators.prep import prepare
    df = regression_df.withColumn("rid", F.monotonically_increasing_id())
    prep = prepare(df.select("rid", "feature_a", "feature_b", "target"), "target", "regression", ["rid"])
    for key in ("svr", "random_forest_reg"):
        m = {r["metric"]: r["value"] for r in fit_eval(prep, key, cv_folds=2)["metrics"].collect()}
        assert {"r2", "rmse", "mae", "cv_r2_mean", "cv_r2_std"} <= set(m)
    imp = fit_eval(prep, "random_forest_reg", cv_folds=2)["importance"].collect()
    assert [r["rank"] for r in imp] == [1, 2] and abs(sum(r["importance"] for r in imp) - 1) < 1e-3


def test_density_over_all_dimensions(spark):
    """16 groups that only four dimensions together tell apart; a chain of 160 cells is one cluster."""
    from tessera.operators.cluster import grid_density_clusters
    rows = [(i * 10 + k, [float(10 * (i >> j & 1)) + 0.01 * k for j in range(4)]) for i in range(16) for k in range(6)]
    out = grid_density_clusters(spark.createDataFrame(rows, "id long, v array<double>"), "v", "id").collect()
    assert len({r["cluster"] for r in out}) == 16 and all(r["cluster"] >= 0 for r in out)
    chain = [(i * 5 + k, [0.5 * i + 0.1, 0.1]) for i in range(160) for k in range(5)]
    out = grid_density_clusters(spark.createDataFrame(chain, "id long, v array<double>"), "v", "id").collect()
    assert {r["cluster"] for r in out} == {0}


def test_ols_arena_rows_stay_where_they_are(spark, regression_df):
    """F7, F8: the fits, a row a feature and fold, go to the rows; no row is shuffled or sorted by those few keys."""
    from pyspark.sql import functions as F
    from tessera.operators.models import ols_arena_metrics
    df = regression_df.withColumn("k", F.monotonically_increasing_id())
    mode, size = "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"
    held = {c: spark.conf.get(c) for c in (mode, size)}
    try:
        spark.conf.set(mode, "false")
        spark.conf.set(size, "-1")  # as for a table whose size Spark does not know
        plan = ols_arena_metrics(df, "target", ["feature_a", "feature_b"], ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    rows = [b for b in plan.split("SortMergeJoin") [1:] if "_fold" in b.splitlines()[0]]
    assert not rows
