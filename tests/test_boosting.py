"""Newton boosting against a plain version, one-scan moments, distinct counts and silhouettes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boosting
from tessera.operators.evaluate import silhouette
from tessera.operators.prep import hash_split, label_encode
from tessera.operators.profile import schema_profile
from tessera.operators.stats import correlations


def brute_boost(x, y, rounds, depth, logistic, eta=0.3, lam=1.0):
    mean = y.mean()
    m = np.full(len(y), np.log(mean / (1 - mean)) if logistic else mean)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = (p - y, p * (1 - p)) if logistic else (m - y, np.ones(len(y)))

        def grow(rows, level):
            best = None
            for f in range(x.shape[1]) if level < depth else ():
                for cut in np.unique(x[:, f])[:-1]:
                    left = rows & (x[:, f] <= cut)
                    right = rows & ~left
                    if h[left].sum() < 1 or h[right].sum() < 1:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + lam) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + lam)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, left, right
            if best is None:
                if level:
                    m[rows] -= eta * g[rows].sum() / (h[rows].sum() + lam)
                return
            grow(best[1], level + 1)
            grow(best[2], level + 1)
        grow(np.ones(len(y), bool), 0)
    return m


@pytest.mark.parametrize("logistic", [False, True])
def test_boosting_by_loops(spark, logistic):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (150, 3)).astype(float)
    y = x[:, 0] * 2 - x[:, 1] + rng.normal(size=150)
    y = (y > y.mean()).astype(float) if logistic else y
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(150)], "i long, x array<double>, y double")
    kind = "logistic" if logistic else "squared"
    model = boosting.fit(df, "x", "y", kind, rounds=3, depth=2)
    want = brute_boost(x, y, 3, 2, logistic)
    assert np.allclose(model.margins(x), want, atol=1e-9)
    got = {r["i"]: r for r in boosting.predict(df, model, "x", kind).collect()}
    if logistic:
        assert all(got[i]["prediction"] == (want[i] > 0) and got[i]["probability"][1] == pytest.approx(1 / (1 + np.exp(-want[i]))) for i in range(150))
    else:
        assert all(got[i]["prediction"] == pytest.approx(want[i]) for i in range(150))


def test_boosting_of_classes_and_odd_rows(spark):
    rows = [(i, [float(i % 3), float(i)], float(i % 3)) for i in range(60)] + [(90, None, 1.0), (91, [float("nan"), None], 0.0), (92, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, "i long, x array<double>, y double")
    models = boosting.fit_classes(df, "x", "y", 3, rounds=5, depth=2)
    got = {r["i"]: r for r in boosting.predict(df, models, "x", "logistic").collect()}
    assert all(got[i]["prediction"] == i % 3 and sum(got[i]["probability"]) == pytest.approx(1) for i in range(60))
    assert got[90]["prediction"] is None and got[91]["prediction"] is not None
    assert boosting.fit(df.limit(0), "x", "y").margins(np.zeros((2, 2))).tolist() == [0.0, 0.0]
    assert boosting.fit(df.where("y = 1"), "x", "y", "logistic").trees == []


def test_correlations_in_one_scan(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 20)) @ rng.normal(size=(20, 20)) + 1e6
    gone = rng.random(x.shape) < 0.2
    rows = [[None if g else float(v) for v, g in zip(r, o)] + [7.0] for r, o in zip(x, gone)]
    df = spark.createDataFrame(rows, [f"c{i}" for i in range(20)] + ["flat"]).repartition(5)
    frame = correlations(df, df.columns)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    got = {(r["col_a"], r["col_b"]): r["r"] for r in frame.collect()}
    for a in range(20):
        for b in range(20):
            ok = ~gone[:, a] & ~gone[:, b]
            assert got[f"c{a}", f"c{b}"] == pytest.approx(np.corrcoef(x[ok, a], x[ok, b])[0, 1], abs=6e-5)
    assert got["flat", "c1"] == 0 and got["flat", "flat"] == 0 and len(got) == 441


def test_distinct_counts_without_expand(spark):
    rows = [(float(i % 7), -0.0 if i % 2 else 0.0, f"s{i % 13}", None if i % 3 else float("nan")) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, z double, s string, n double")
    profile = schema_profile(df)
    assert "Expand" not in profile._jdf.queryExecution().executedPlan().toString()
    assert [r["n_unique"] for r in profile.orderBy("position").collect()] == [7, 1, 13, 0]


def test_silhouette_by_all_pairs(spark):
    rng = np.random.default_rng(6)
    x, c = rng.normal(size=(300, 4)), rng.integers(-1, 4, 300)
    x[:, 0] += 3 * c
    c[0] = 9  # alone in its cluster
    df = spark.createDataFrame([(i, x[i].tolist(), int(c[i])) for i in range(300)], "k long, v array<double>, cluster int")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(300):
        own = (c == c[i]) & (np.arange(300) != i)
        a = far[i, own].mean() if own.any() else 0
        b = min(far[i, c == o].mean() for o in set(c.tolist()) - {c[i]})
        s.append((b - a) / max(a, b) if own.any() else 0)
    got = silhouette(df, "v", "k", "cluster").first()
    assert got["silhouette"] == pytest.approx(np.mean(s), abs=6e-5) and got["n"] == 300
    assert silhouette(df, "v", "k", "cluster", sample=50).first()["n"] == 50
    assert silhouette(df.limit(0), "v", "k", "cluster").first()["silhouette"] is None
    assert silhouette(df.where("cluster = 1"), "v", "k", "cluster").first()["silhouette"] is None


def test_split_and_codes_build_few_jobs(spark):
    """Plans are built with few jobs, sizes are exact in every stratum, null strata are one."""
    df = spark.createDataFrame([(i, None if i % 10 == 0 else f"s{i % 3}") for i in range(1000)], "id long, s string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("split", "split")
    out = hash_split(df, ["id"])
    jobs = len(tracker.getJobIdsForGroup("split"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12 and out.where("is_test").count() == 200
    sizes = {r["s"]: (r["n"], r["t"]) for r in hash_split(df, ["id"], strata="s").groupBy("s").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert all(t == -(-n * 20 // 100) for n, t in sizes.values()) and None in sizes
    coded = label_encode(df, ["s"])
    got = {(r["v"], r["s"]) for r in df.select("id", F.col("s").alias("v")).join(coded, "id").select("v", "s").distinct().collect()}
    assert got == {(None, 0.0), ("s0", 1.0), ("s1", 2.0), ("s2", 3.0)}
