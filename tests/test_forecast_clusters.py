"""Forecasters, exact DBSCAN and Ward against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dbscan, ward
from tessera.operators.arena import arena_time_series, leaderboard
from tessera.operators.forecast import OK, TOO_SHORT, _splits, forecast, forecast_metrics, forecast_rf


def series(spark, values):
    rows = [(k, i, float(v)) for k, xs in values.items() for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "series_key string, i int, value double").select(
        "series_key", F.timestamp_seconds(F.col("i").cast("long") * 86400).alias("t"), "value")


def walks(lengths, seed=0):
    rng = np.random.default_rng(seed)
    return {f"s{n}": 50 + np.cumsum(rng.normal(size=n)) + 5 * np.sin(np.arange(n) * math.pi / 6) for n in lengths}


def paths_of(fc):
    out = {}
    for r in fc.where("segment = 'test'").orderBy("series_key", "step").collect():
        out.setdefault(r["series_key"], []).append(r["forecast"])
    return out


def holt_winters(x, horizon, m=12):
    seasonal, best = len(x) >= 2 * m, None
    grid = (0.1, 0.3, 0.5, 0.7, 0.9)
    for a in grid:
        for b in grid:
            for g in grid if seasonal else (0.0,):
                level = np.mean(x[:m]) if seasonal else x[0]
                trend = (np.mean(x[m:2 * m]) - np.mean(x[:m])) / m if seasonal else x[1] - x[0]
                season = [v - level if seasonal else 0.0 for v in (x[:m] if seasonal else [0.0] * m)]
                sse = 0.0
                for t, v in enumerate(x):
                    s = season[t % m]
                    sse += (v - level - trend - s) ** 2
                    level, before = a * (v - s) + (1 - a) * (level + trend), level
                    trend = b * (level - before) + (1 - b) * trend
                    season[t % m] = g * (v - level) + (1 - g) * s
                if best is None or sse < best[0] - 1e-12:
                    best = sse, [level + (h + 1) * trend + season[(len(x) + h) % m] for h in range(horizon)]
    return best[1]


def test_holt_winters_by_loops(spark):
    values = walks([10, 23, 40, 61])
    got = paths_of(forecast(series(spark, values), "exponential_smoothing"))
    for k, x in values.items():
        cut = int(len(x) * 0.8)
        assert got[k] == pytest.approx(holt_winters(x[:cut], len(x) - cut), rel=1e-9)


def arima_sse(w, phi, theta):
    e, total = 0.0, 0.0
    for before, now in zip(w, w[1:]):
        e = now - phi * before - theta * e
        total += e * e
    return total


def test_arima_finds_the_least_squares(spark):
    """No coefficients of a fine grid leave a smaller sum of squares than the fitted ones, which the AIC tells."""
    values = walks([30, 45], seed=3)
    fc = forecast(series(spark, values), "arima")
    aic = {r["series_key"]: r["aic"] for r in fc.groupBy("series_key").agg(F.max("aic").alias("aic")).collect()}
    for k, x in values.items():
        w = np.diff(x[:int(len(x) * 0.8)]).tolist()
        n = len(w) - 1
        sse = n * math.exp((aic[k] - n - 6) / n) / (2 * math.pi)
        grid = np.linspace(-0.99, 0.99, 67)
        assert sse <= min(arima_sse(w, p, t) for p in grid for t in grid) * 1.005
    assert all(math.isfinite(v) for path in paths_of(fc).values() for v in path)


def test_short_and_constant_series(spark):
    values = {"short": [1.0] * 9, "least": list(range(10)), "flat": [3.0] * 30}
    df = series(spark, values)
    for fc in (forecast(df, "arima"), forecast(df, "exponential_smoothing"), forecast_rf(df, num_trees=5)):
        found = {r["series_key"]: r for r in forecast_metrics(fc).collect()}
        assert found["short"]["status"] == TOO_SHORT and found["short"]["rmse"] is None and found["short"]["n_test"] == 0
        assert found["flat"]["rmse"] == 0 and found["least"]["status"] == OK
        assert forecast(df.limit(0), "arima").count() == 0


def test_forest_of_a_series_ignores_the_others(spark):
    values = walks([40, 55], seed=5)
    both = paths_of(forecast_rf(series(spark, values), num_trees=20))
    alone = paths_of(forecast_rf(series(spark, {"s40": values["s40"]}), num_trees=20))
    assert alone["s40"] == both["s40"]
    lows, highs = min(values["s40"]), max(values["s40"])
    assert all(lows <= v <= highs for v in both["s40"])


def test_split_by_all_thresholds(spark):
    rng = np.random.default_rng(7)
    x, y, w = rng.integers(0, 6, (40, 3)).astype(float), rng.normal(size=40), rng.integers(0, 3, 40)
    rows = spark.createDataFrame([("s", 0, 1, x[i].tolist(), float(y[i]), int(w[i])) for i in range(40)],
                                 "series_key string, tree int, node long, x array<double>, y double, w int")
    (got,) = _splits(rows, ["series_key", "tree", "node"]).collect()
    best = None
    for f in range(3):
        seen = sorted({x[i, f] for i in range(40) if w[i]})
        for low, high in zip(seen, seen[1:]):
            left = x[:, f] <= low
            loss = -sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, ~left))
            if best is None or loss < best[0] - 1e-12:
                best = loss, f, (low + high) / 2
    assert (got["f"], got["at"]) == best[1:]


def test_time_series_arena(spark):
    metrics, errors = arena_time_series(series(spark, {**walks([40, 60]), "short": [1.0, 2.0]}))
    board = leaderboard(metrics, "time_series", detail=True).collect()
    assert {r["run_id"] for r in board} == {"s40", "s60"} and len(board) == 6
    for run in ("s40", "s60"):
        values = [r["primary_value"] for r in sorted(board, key=lambda r: r["rank"]) if r["run_id"] == run]
        assert values == sorted(values)
    assert all(r["all_metrics"]["rmse"] == r["primary_value"] and r["training_time_sec"] > 0 for r in board)
    assert {r["error"] for r in errors.collect()} == {TOO_SHORT} and errors.count() == 3


# ---------------------------------------------------------------- clusters

def brute_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core, label, number = near.sum(1) >= least, -np.ones(len(x), int), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], number
            while todo:
                j = todo.pop()
                for k in np.flatnonzero(near[j]) if core[j] else ():
                    if label[k] < 0:
                        label[k] = number
                        todo.append(k)
            number += 1
    return label.tolist()


def labels(frame, n):
    got = {r["k"]: r["cluster"] for r in frame.collect()}
    return [got[i] for i in range(n)]


def points(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "k long, v array<double>")


@pytest.mark.parametrize("dims, eps, least", [(1, 0.05, 4), (2, 0.2, 5), (64, 8.0, 4)])
def test_dbscan_by_all_pairs(spark, dims, eps, least):
    rng = np.random.default_rng(dims)
    blob, copies = rng.normal(size=(60, dims)) * 0.3, np.repeat(rng.normal(size=(1, dims)), 30, axis=0)
    x = np.vstack([rng.uniform(-2, 2, (120, dims)), blob, copies, blob[:5] + 3])
    x = x[rng.permutation(len(x))]
    assert labels(dbscan.dbscan(points(spark, x), "v", "k", eps, least), len(x)) == brute_dbscan(x, eps, least)


def test_dense_cells_are_linked_by_their_borders(spark):
    """Two crowded cells whose nearest points are within eps, and two whose are not."""
    rng = np.random.default_rng(1)
    left, right = rng.uniform(0, 0.06, (150, 2)), rng.uniform(0, 0.06, (150, 2)) + [0.15, 0]
    far = rng.uniform(0, 0.06, (150, 2)) + [0.0, 0.18]
    x = np.vstack([left, right, far])
    got = labels(dbscan.dbscan(points(spark, x), "v", "k", 0.1, 5), len(x))
    assert got == brute_dbscan(x, 0.1, 5) and len(set(got)) == 2


def test_dbscan_of_odd_rows(spark):
    x = [[0.0, 0.0]] * 6 + [None, [float("nan"), 1.0], [None, 1.0], [5.0, 5.0]]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "k long, v array<double>")
    assert labels(dbscan.dbscan(frame, "v", "k", 0.1, 5), 10) == [0] * 6 + [-1] * 4
    assert dbscan.dbscan(frame.limit(0), "v", "k").count() == 0


def brute_ward(x, k):
    own = [(1.0, v.copy(), [i]) for i, v in enumerate(x)]
    while len(own) > k:
        n, c = np.array([o[0] for o in own]), np.array([o[1] for o in own])
        cost = n[:, None] * n[None] / (n[:, None] + n[None]) * ((c[:, None] - c[None]) ** 2).sum(-1)
        cost[np.tril_indices(len(own))] = np.inf
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        a, b = own[i], own[j]
        own = [o for t, o in enumerate(own) if t not in (i, j)]
        own.append((a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2] + b[2]))
    out = np.zeros(len(x), int)
    for number, members in enumerate(sorted((o[2] for o in own), key=min)):
        out[members] = number
    return out.tolist()


def test_ward_by_greedy_merges(spark):
    """500 points: the same clusters as merging the nearest pair again and again."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(490, 4)), np.repeat(rng.normal(size=(1, 4)), 10, axis=0)])
    assert labels(ward.ward_clusters(points(spark, x), "v", "k", 6), 500) == brute_ward(x, 6)


def test_ward_of_few_and_many_points(spark):
    x = np.random.default_rng(3).normal(size=(300, 3))
    x[150:] += 8
    got = labels(ward.ward_clusters(points(spark, x), "v", "k", 2, cells=40), 300)  # k-means cells
    assert got == [0] * 150 + [1] * 150
    few = points(spark, [[1.0], [1.0], [2.0], None])
    assert labels(ward.ward_clusters(few, "v", "k", 3), 4) == [0, 0, 1, None]
    assert ward.ward_clusters(few.limit(0), "v", "k", 3).count() == 0


def test_ward_rounds_are_one_job_each(spark):
    """a round of the tree costs one small job, not a rewrite of a table of all pairs; the heights are those of greedy merges."""
    x = np.random.default_rng(5).normal(size=(60, 3))
    cells = spark.createDataFrame([(i, 1, v) for i, v in enumerate(x.tolist())], "id long, n long, x array<double>")
    sc = spark.sparkContext
    sc.setJobGroup("ward-rounds", "linkage")
    tree = ward.linkage(cells)
    jobs = len(sc.statusTracker().getJobIdsForGroup("ward-rounds"))
    sc.setJobGroup("after", "after")
    rows = tree.collect()
    assert len(rows) == 59 and jobs <= max(r["round"] for r in rows) + 4
    own, heights = [(1.0, v) for v in x], []
    while len(own) > 1:
        cost, i, j = min((a[0] * b[0] / (a[0] + b[0]) * ((a[1] - b[1]) ** 2).sum(), i, j) for j, b in enumerate(own) for i, a in enumerate(own[:j]))
        a, b = own[i], own[j]
        heights.append(cost)
        own = [o for t, o in enumerate(own) if t not in (i, j)] + [(a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]))]
    assert np.allclose(sorted(r["height"] for r in rows), sorted(heights))


@pytest.mark.parametrize("held", [None, 30, 250])
def test_ward_of_more_points_is_exact(spark, held):
    """more points than cells were once made are still merged one by one, and it does not matter where centres are held."""
    x = np.random.default_rng(7).normal(size=(700, 3)) + 1000
    x[600:640] = x[:40]
    assert labels(ward.ward_clusters(points(spark, x), "v", "k", 9, cells=held), 700) == brute_ward(x, 9)


def test_ward_on_a_lattice_is_the_same_wherever_centres_are_held(spark):
    """ties on every side: the tree of tables and that of the driver have the same merges."""
    cells = spark.createDataFrame([(12 * i + j, 1 + (i * j) % 3, [float(i), float(j)]) for i in range(12) for j in range(12)], "id long, n long, x array<double>")
    trees = [sorted(tuple(r) for r in ward.linkage(cells, held).collect()) for held in (None, 1, 40)]
    assert len(trees[0]) == 143 and trees[0] == trees[1] == trees[2]


def test_dbscan_compares_boxes_of_near_cells_only(spark, monkeypatch):
    """in many dimensions most cells that meet are far apart in one; their boxes are not compared in all of them."""
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(60, 16)), 5, axis=0) + rng.normal(scale=0.01, size=(300, 16))
    seen = []
    monkeypatch.setattr(dbscan, "materialize", lambda df, keep=dbscan.materialize: (seen.append(df), keep(df))[1])
    assert labels(dbscan.dbscan(points(spark, x), "v", "k", 0.5, 5), 300) == [i // 5 for i in range(300)]
    plan = next(df for df in seen if df.columns == ["a", "b", "n_b", "dense_b", "whole"])._jdf.queryExecution().optimizedPlan().toString()
    meet = [line for line in plan.split("\n") if "Join" in line and "_c#" in line]
    assert meet and all("greatest" in line and "lambdafunction" not in line for line in meet), plan


def test_ward_of_numbers_without_end(spark):
    """infinite vectors have no cluster, and squares beyond the range of numbers end in some tree; both zeros are one point."""
    x = [[0.0], [-0.0], [1.0], [float("inf")], [1e200], [3e200]]
    assert labels(ward.ward_clusters(points(spark, x), "v", "k", 2), 6)[:4] == [0, 0, 0, None]
