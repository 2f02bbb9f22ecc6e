"""Invariants and brute-force checks on small inputs (skew included)."""

import math
import re

import numpy as np
from pyspark.sql import functions as F


def _skewed(spark, n=3000, seed=7):
    rng = np.random.default_rng(seed)
    hot = np.full(n // 3, 5.0)                     # one value holds a third of the rows
    rest = np.round(rng.normal(0, 10, n - len(hot)), 1)
    vals = np.concatenate([hot, rest])
    return spark.createDataFrame([(float(v), int(i % 2)) for i, v in enumerate(vals)], "x double, g int"), vals


def test_exact_quantiles_match_numpy(spark):
    from tessera.operators.order_stats import exact_quantiles, to_long
    df, vals = _skewed(spark)
    qs = exact_quantiles(to_long(df, ["x"]), ["column_name"], "value", [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1],
                         n_buckets=7).collect()
    got = {r["p"]: r["q"] for r in qs}
    for p, q in got.items():
        assert abs(q - np.quantile(vals, p)) < 1e-9


def test_running_totals_and_ranks(spark):
    from tessera.operators.order_stats import row_ranks
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.xxhash64("id").alias("h"))
    r = row_ranks(df, ["g"], ["h"], "rank", n_buckets=5).toPandas()
    for _, grp in r.groupby("g"):
        assert list(grp.sort_values("h")["rank"]) == list(range(1, len(grp) + 1))


def test_dense_codes_code_point_order(spark):
    from tessera.operators.order_stats import dense_codes
    vals = ["b", "B", "a", "é", "Z", "aa", "nan"]
    df = spark.createDataFrame([(v,) for v in vals * 3], "v string")
    m = {r["v"]: r["c"] for r in dense_codes(df, "v", "c", n_buckets=3).collect()}
    assert [m[v] for v in sorted(set(vals))] == list(range(len(set(vals))))


def test_top_k_matches_pandas(spark):
    from tessera.operators.stats import top_values
    df, vals = _skewed(spark)
    got = [(r["value"], r["count"]) for r in top_values(df, ["x"], k=5).orderBy("rank").collect()]
    import pandas as pd
    s = pd.Series(vals).value_counts()
    exp = sorted(((str(float(k)), int(c)) for k, c in s.items()), key=lambda t: (-t[1], t[0]))[:5]
    assert got == exp


def test_drift_identity_and_js_bounds(spark):
    from tessera.operators.drift import drift
    df, _ = _skewed(spark)
    r = drift(df, df, ["x"]).first()
    assert r["ks_statistic"] == 0 and r["psi"] == 0 and r["js_distance"] == 0 and not r["drift_detected"]
    a = spark.range(300).select(F.randn(1).alias("x"))
    b = spark.range(300).select((F.randn(2) * 3 + 1).alias("x"))
    ab, ba = drift(a, b, ["x"]).first(), drift(b, a, ["x"]).first()
    assert ab["js_distance"] == ba["js_distance"] and ab["js_distance"] <= math.sqrt(math.log(2))
    assert ab["ks_statistic"] == ba["ks_statistic"]


def test_ks_matches_brute_force(spark):
    from tessera.operators.drift import drift
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(0, 1, 400), 2), np.round(rng.normal(0.3, 1, 150), 2)
    a = spark.createDataFrame([(float(v),) for v in x], "v double")
    b = spark.createDataFrame([(float(v),) for v in y], "v double")
    grid = np.union1d(x, y)
    d = max(abs(np.searchsorted(np.sort(x), t, "right") / len(x) - np.searchsorted(np.sort(y), t, "right") / len(y))
            for t in grid)
    assert abs(drift(a, b, ["v"]).first()["ks_statistic"] - round(d, 4)) < 1e-12


def test_stratified_split_sizes(spark):
    from tessera.operators.prep import hash_split
    df = spark.range(1003).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"))
    out = hash_split(df, ["id"], strata="s").groupBy("s").agg(F.count("*").alias("n"),
                                                              F.count_if("is_test").alias("t")).collect()
    for r in out:
        assert r["t"] == math.ceil(0.2 * r["n"])


def test_edge_tables(spark):
    from tessera.operators.profile import schema_profile
    from tessera.operators.stats import histogram, numeric_stats
    empty = spark.createDataFrame([], "a double, b string")
    assert {r["n_rows"] for r in schema_profile(empty).collect()} == {0}
    df = spark.createDataFrame([(1.0, None, float("nan")), (1.0, None, 2.0), (1.0, None, None),
                                (1.0, None, 3.0), (1.0, None, 4.0)], "c double, n string, m double")
    prof = {r["column_name"]: r for r in schema_profile(df).collect()}
    assert prof["m"]["n_missing"] == 2 and prof["n"]["n_missing"] == 5 and prof["n"]["role"] == "categorical"
    h = histogram(df, ["c"]).collect()
    assert sum(r["count"] for r in h) == 5 and [r["bin"] for r in h if r["count"]] == [10]
    st = numeric_stats(df, ["c"]).first()
    assert st["std"] == 0.0 and st["skewness"] == 0.0


def test_normal_steps(spark):
    from statistics import NormalDist
    from tessera.functions.exprs import INVERSE_NORMAL_STEPS, normal_tail_steps, with_steps
    ps = [1e-12, 1e-4, 0.02, 0.075, 0.3, 0.5, 0.7, 0.925, 0.99, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    rows = with_steps(with_steps(df, INVERSE_NORMAL_STEPS), normal_tail_steps("m", "tail")).collect()
    for r in rows:
        assert abs(r["m"] - NormalDist().inv_cdf(r["p"])) < 1e-9 and abs(r["tail"] - (1 - r["p"])) < 1e-9


def test_normality_over_all_rows(spark):
    """W of samples: null rejection rate, power, ties, few values; the weights of a published n = 10 table."""
    from tessera.operators.stats import normality
    rng = np.random.default_rng(0)
    cols = {f"c{i}": rng.normal(size=60) for i in range(150)}
    rej = np.mean([r["w_p_value"] < 0.05 for r in normality(_frame(spark, cols), list(cols)).collect()])
    assert 0.01 < rej < 0.11
    skewed = normality(_frame(spark, {"x": rng.exponential(size=6000)}), ["x"]).first()
    assert skewed["w_p_value"] is None and skewed["w_statistic"] < 0.9 and skewed["k2_p_value"] < 0.01 and not skewed["is_normal"]
    rounded = normality(_frame(spark, {"x": np.round(rng.normal(size=4000) * 2)}), ["x"]).first()
    assert rounded["w_statistic"] < 0.99 and not rounded["is_normal"]  # ties over all rows, no sample
    # weights for n = 10 are 0.5739, 0.3291, 0.2141, 0.1224, 0.0399 (Shapiro and Wilk's table); W of this sample by them
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, ], float)
    a = np.array([0.5739, 0.3291, 0.2141, 0.1224, 0.0399])
    w = (a @ (x[::-1][:5] - x[:5])) ** 2 / ((x - x.mean()) ** 2).sum()
    got = normality(_frame(spark, {"x": x, "five": np.r_[x[:5], [np.nan] * 5]}), ["x", "five"]).collect()
    assert {r["column_name"]: r["k2_p_value"] is None for r in got} == {"x": False, "five": True}
    assert abs([r for r in got if r["column_name"] == "x"][0]["w_statistic"] - w) < 2e-3


def _frame(spark, columns):
    return spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*columns.values())],
                                 ", ".join(f"{c} double" for c in columns))


def test_stream_equals_batch(spark):
    from tessera.plans.catalog import QUERIES, _event_halves
    from tessera.session import table
    from tessera.streaming.drift_stream import window_drift
    sf = "/root/testdata/sf0.001"
    s = QUERIES["drift_stream"](spark, sf).toPandas().sort_values(["window_start", "feature"]).reset_index(drop=True)
    ref, _ = _event_halves(spark, sf)
    b = window_drift(table(spark, sf, "events"), ref, "ts", ["value", "user_id"]).toPandas()
    b = b.sort_values(["window_start", "feature"]).reset_index(drop=True)  # every window, the last one too
    assert len(s) > 0 and len(s) == len(b)
    same = ["psi", "js_distance", "n_current", "ks_statistic", "ks_pvalue", "drift_flag"]
    assert (s[same].values == b[same].values).all()


def test_stream_ks_is_near_the_exact_one_and_survives_compaction(spark, tmp_path):
    """The statistic from 128 bins is at most 1/128 below the exact one; compaction keeps every row."""
    import numpy as np
    from pyspark.sql import functions as F
    from tessera.streaming.drift_stream import drift_stream
    rng = np.random.default_rng(0)
    ref, days = rng.normal(size=5000), {d: rng.normal(0.1 * d, 1 + 0.1 * d, 400) for d in range(1, 5)}
    reference = spark.createDataFrame([(float(v),) for v in ref], "v double")
    for k, (d, x) in enumerate(days.items()):
        part = spark.createDataFrame([(d * 86400 + i, float(v)) for i, v in enumerate(x)], "s long, v double")
        part.select(F.timestamp_seconds("s").alias("ts"), "v").write.parquet(str(tmp_path / "in" / f"d={k}"))
    schema = "ts timestamp, v double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    monitor = drift_stream(stream, reference, "ts", ["v"], path=str(tmp_path / "out"))
    monitor.query.awaitTermination()
    before = sorted(map(tuple, monitor.result().collect()))
    monitor.compact()
    assert sorted(map(tuple, monitor.result().collect())) == before and len(before) == 4
    assert len([p for p in (tmp_path / "out" / "counts").iterdir() if p.name.startswith("batch_id=")]) == 1
    for r in monitor.result().collect():
        x = days[int(r["window_start"].timestamp() // 86400)]
        both = np.concatenate([ref, x])
        exact = np.abs(np.searchsorted(np.sort(ref), both, "right") / len(ref) - np.searchsorted(np.sort(x), both, "right") / len(x)).max()
        assert exact - 1 / 128 - 1e-4 <= r["ks_statistic"] <= exact + 1e-4


def test_bucket_counts_do_not_matter(spark):
    """Any number of buckets gives the exact answer."""
    from tessera.operators.order_stats import first_k_flag, weighted_quantiles
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"), "id")
    k = F.ceil(F.lit(0.2) * 667)
    a = {r["id"]: r["f"] for r in first_k_flag(df, ["g"], ["h", "id"], k, "f", n_buckets=9).collect()}
    b = {r["id"]: r["f"] for r in first_k_flag(df, ["g"], ["h", "id"], k, "f").collect()}
    assert a == b and sum(a.values()) == 3 * 134
    rng = np.random.default_rng(5)
    vals = rng.integers(0, 50, 500)
    w = np.bincount(vals)
    counted = spark.createDataFrame([("x", float(v), int(c)) for v, c in enumerate(w) if c > 0],
                                    "k string, v double, c long")
    probs = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    got = {r["p"]: r["q"] for r in weighted_quantiles(counted, ["k"], "v", "c", probs, n_buckets=6).collect()}
    got1 = {r["p"]: r["q"] for r in weighted_quantiles(counted, ["k"], "v", "c", probs).collect()}
    for p in probs:
        assert abs(got[p] - np.quantile(vals, p)) < 1e-9 and abs(got1[p] - np.quantile(vals, p)) < 1e-9


def test_keyed_join_spreads_keys(spark):
    """Per-column frames are broadcast, frames keyed by data values meet them by key and salt; results are plain joins'."""
    from tessera.operators.order_stats import keyed_join
    df = spark.createDataFrame([(i, "x", "c") for i in range(1000)], "id long, g string, column_name string")
    by_name = spark.createDataFrame([("c", 1)], "column_name string, v int")
    by_value = spark.createDataFrame([("x", 2), ("y", 3)], "g string, w int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = keyed_join(df, by_name, ["column_name"], "id"), keyed_join(df, by_value, ["g"], "id", "left")
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (a, b)]
        assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
        assert re.search(r"SortMergeJoin \[g#\d+, _salt#\d+\]", plans[1]), plans[1]
        assert a.count() == 1000 and b.count() == 1000 and b.agg(F.sum("w")).first()[0] == 2000
        assert keyed_join(df, by_value.where("g = 'x'").drop("g"), [], "id").count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_string_buckets_ignore_common_prefixes(spark):
    from tessera.operators.order_stats import _tagged, row_ranks
    df = spark.range(1000).select(F.format_string("Customer#%09d", "id").alias("s"), "id")
    assert _tagged(df, [], "s", 64).select("_bucket").distinct().count() > 32
    assert all(r["rank"] == r["id"] + 1 for r in row_ranks(df, [], ["s"]).collect())


def test_column_quantiles_of_odd_columns(spark):
    """Against NumPy, all rows counted: ties over every bound, missing values, infinities, one value, none; names with quotes."""
    from tessera.operators.order_stats import column_quantiles
    rng = np.random.default_rng(1)
    n = 20000
    x = {"plain": rng.normal(size=n), "ties": np.where(rng.random(n) < 0.6, 3.0, rng.integers(0, 9, n)), "odd `name`": rng.exponential(size=n),
         "one": np.full(n, np.nan), "none": np.full(n, np.nan)}
    x["odd `name`"][:40] = np.nan
    x["odd `name`"][40:60] = np.inf
    x["one"][7] = -2.5
    df = spark.createDataFrame([tuple(None if k % 2 and np.isnan(v) else float(v) for k, v in enumerate(r)) for r in zip(*x.values())],
                               ", ".join(f"`{c.replace('`', '``')}` double" for c in x))
    probs = {"lo": 0.0, "q1": 0.25, "med": 0.5, "q9": 0.9, "hi": 1.0}
    got = {r["column_name"]: r for r in column_quantiles(df, list(x), probs).collect()}
    assert set(got) == set(x) - {"none"}
    for c in got:
        v = x[c][~np.isnan(x[c])]
        for name, p in probs.items():
            want = np.quantile(v, p)
            assert math.isclose(got[c][name], want, rel_tol=1e-12, abs_tol=1e-12) or p == 1 and np.isinf(v.max())
    assert column_quantiles(df.limit(0), list(x), probs).count() == 0


def test_quantiles_shuffle_only_values_near_them(spark):
    """of a column of distinct values only the slices around the quantiles are shuffled; a scan once shuffled each value."""
    from tessera.operators import order_stats
    df = spark.range(200000).select((F.col("id") * 1.5).alias("x"))
    seen, real = [], order_stats._located_quantiles

    def watched(choose, *rest):
        return real(lambda need: seen.append(choose(need)) or seen[-1], *rest)
    order_stats._located_quantiles = watched
    try:
        rows = order_stats.column_quantiles(df, ["x"], {"q1": 0.25, "q3": 0.75}).collect()
    finally:
        order_stats._located_quantiles = real
    assert rows[0]["q1"] == 1.5 * 49999.75 and rows[0]["q3"] == 1.5 * 149999.25
    assert seen[0].count() < 200000 * 0.01


def test_distinct_counts_without_arrays(spark):
    """the (column, hash) pairs are flat rows; an array of structs a row took five times the time."""
    import contextlib
    import io
    from tessera.operators.profile import distinct_counts
    df = spark.createDataFrame([(1, 0.0, "a", None), (1, -0.0, None, None), (2, float("nan"), "b", None)], "i long, d double, s string, n int")
    found = distinct_counts(df)
    assert tuple(found.first()) == (2, 1, 2, 0)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        found.explain()
    assert "Generate" not in text.getvalue() and "Expand" in text.getvalue()
