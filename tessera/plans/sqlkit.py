"""Small helpers that write the DuckDB oracle SQL for the query catalogue.

They only assemble SQL text (the oracle is an independent engine); nothing
here parses or plans queries.
"""

from __future__ import annotations


def safe4(expr: str, digits: int = 4) -> str:
    """SQL twin of ``functions.exprs.safe4``."""
    return (f"(CASE WHEN ({expr}) IS NULL OR isnan(({expr})::DOUBLE) OR isinf(({expr})::DOUBLE) "
            f"THEN 0.0 ELSE round(({expr})::DOUBLE, {digits}) + 0.0 END)")


def rnd(expr: str, digits: int = 4) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"


def split_hash(key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT)"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def long_values(table: str, cols: list[str], where: str = "") -> str:
    """Unpivot numeric columns to (column, value) with NaN/NULL removed."""
    w = f" AND ({where})" if where else ""
    return union_all([
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM {table} "
        f"WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE)){w}" for c in cols])


def skew_g1(n: str, m2: str, m3: str) -> str:
    """Population skewness from central moments."""
    return f"(CASE WHEN {m2} > 0 THEN {m3} / pow({m2}, 1.5) END)"


def dagostino_sql(n: str, g1: str, g2: str) -> str:
    """D'Agostino-Pearson p-value in SQL (same formulas as the Spark expression)."""
    n = f"CAST({n} AS DOUBLE)"
    y = f"({g1} * sqrt(({n} + 1) * ({n} + 3) / (6.0 * ({n} - 2))))"
    beta2 = f"(3.0 * ({n}*{n} + 27*{n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2) * ({n} + 5) * ({n} + 7) * ({n} + 9)))"
    w2 = f"(-1.0 + sqrt(2.0 * ({beta2} - 1)))"
    delta = f"(1.0 / sqrt(0.5 * ln({w2})))"
    alpha = f"sqrt(2.0 / ({w2} - 1))"
    ya = f"({y} / {alpha})"
    z1 = f"({delta} * ln({ya} + sqrt({ya} * {ya} + 1)))"
    b2 = f"({g2} + 3.0)"
    e = f"(3.0 * ({n} - 1) / ({n} + 1))"
    var = f"(24.0 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1) * ({n} + 1) * ({n} + 3) * ({n} + 5)))"
    x = f"(({b2} - {e}) / sqrt({var}))"
    s = (f"(6.0 * ({n}*{n} - 5*{n} + 2) / (({n} + 7) * ({n} + 9)) * "
         f"sqrt(6.0 * ({n} + 3) * ({n} + 5) / ({n} * ({n} - 2) * ({n} - 3))))")
    a = f"(6.0 + (8.0 / {s}) * (2.0 / {s} + sqrt(1 + 4.0 / ({s} * {s}))))"
    dd = f"(1 + {x} * sqrt(2.0 / ({a} - 4.0)))"
    term = f"(sign({dd}) * cbrt((1 - 2.0 / {a}) / abs({dd})))"
    z2 = f"(((1 - 2.0 / (9.0 * {a})) - {term}) / sqrt(2.0 / (9.0 * {a})))"
    return f"exp(-({z1} * {z1} + {z2} * {z2}) / 2.0)"


def ks_pvalue_sql(d: str, n1: str, n2: str) -> str:
    m = f"(CAST({n1} AS DOUBLE) * CAST({n2} AS DOUBLE) / CAST({n1} + {n2} AS DOUBLE))"
    lam = f"((sqrt({m}) + 0.12 + 0.11 / sqrt({m})) * {d})"
    series = (f"(SELECT sum(pow(-1.0, k - 1) * exp(-2.0 * k * k * {lam} * {lam})) "
              f"FROM range(1, 101) t(k))")
    return f"(CASE WHEN {lam} < 0.2 THEN 1.0 ELSE least(greatest(2.0 * {series}, 0.0), 1.0) END)"


def drift_sql(ref: str, cur: str, cols: list[str], segs: list[str] = ()) -> str:
    """SQL twin of ``operators.drift.drift`` (KS, PSI, JS, moments, vote, severity)."""
    segs = list(segs)
    sg = "".join(f"{s}, " for s in segs)
    keys = ", ".join(segs + ["feature"])
    u = union_all(
        [f"SELECT {sg}'{c}' AS feature, CAST({c} AS DOUBLE) AS value, {side} AS side FROM ({src}) "
         f"WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))"
         for side, src in ((0, ref), (1, cur)) for c in cols])
    probs = ", ".join(repr(i / 10) for i in range(11))
    lo = "CASE WHEN lo_ = hi_ THEN lo_ - 0.5 ELSE lo_ END"
    hi = "CASE WHEN lo_ = hi_ THEN hi_ + 0.5 ELSE hi_ END"
    ksp = ks_pvalue_sql("ks_statistic", "n_train", "n_test")
    return f"""
WITH u AS ({u}),
sz AS (SELECT {keys}, count(*) FILTER (WHERE side = 0) AS n_train, count(*) FILTER (WHERE side = 1) AS n_test,
              avg(value) FILTER (WHERE side = 0) AS m0, avg(value) FILTER (WHERE side = 1) AS m1,
              stddev_pop(value) FILTER (WHERE side = 0) AS s0, stddev_pop(value) FILTER (WHERE side = 1) AS s1,
              min(value) AS lo_, max(value) AS hi_
       FROM u GROUP BY {keys} HAVING n_train >= 5 AND n_test >= 5),
v AS (SELECT u.*, sz.n_train, sz.n_test, {lo} AS lo, {hi} AS hi FROM u JOIN sz USING ({keys})),
vc AS (SELECT {keys}, value, count(*) FILTER (WHERE side = 0) AS c0, count(*) FILTER (WHERE side = 1) AS c1,
              any_value(n_train) AS n_train, any_value(n_test) AS n_test FROM v GROUP BY {keys}, value),
cu AS (SELECT *, sum(c0) OVER w AS cc0, sum(c1) OVER w AS cc1 FROM vc
       WINDOW w AS (PARTITION BY {keys} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT {keys}, max(abs(cc0 / n_train - cc1 / n_test)) AS ks_statistic FROM cu GROUP BY {keys}),
ed AS (SELECT {keys}, list_sort(list_distinct(quantile_cont(value, [{probs}]))) AS edges
       FROM v WHERE side = 0 GROUP BY {keys}),
bn AS (SELECT {keys}, side, least(len(list_filter(edges, lambda e: e <= value)) - 1, len(edges) - 2) AS bin
       FROM v JOIN ed USING ({keys})
       WHERE len(edges) >= 3 AND value >= edges[1] AND value <= edges[len(edges)]),
bc AS (SELECT {keys}, bin, count(*) FILTER (WHERE side = 0) AS c0, count(*) FILTER (WHERE side = 1) AS c1
       FROM bn GROUP BY {keys}, bin),
gr AS (SELECT {keys}, CAST(b.bin AS INTEGER) AS bin, len(edges) - 1 AS nb
       FROM ed, range(0, 10) b(bin) WHERE len(edges) >= 3 AND b.bin < len(edges) - 1),
pq AS (SELECT {keys}, (coalesce(c0, 0) + 1.0) / (n_train + nb) AS p, (coalesce(c1, 0) + 1.0) / (n_test + nb) AS q
       FROM gr LEFT JOIN bc USING ({keys}, bin) JOIN sz USING ({keys})),
ps AS (SELECT {keys}, sum((q - p) * ln(q / p)) AS psi FROM pq GROUP BY {keys}),
jb AS (SELECT {keys}, least(19, CAST(floor((value - lo) * 20 / (hi - lo)) AS INTEGER)) AS bin,
              count(*) FILTER (WHERE side = 0) AS c0, count(*) FILTER (WHERE side = 1) AS c1
       FROM v GROUP BY ALL),
jg AS (SELECT {keys}, n_train, n_test, ({hi}) - ({lo}) AS rng, CAST(b.bin AS INTEGER) AS bin
       FROM sz, range(0, 20) b(bin)),
de AS (SELECT {keys}, coalesce(c0, 0) / (n_train * (rng / 20)) + 1e-10 AS p,
              coalesce(c1, 0) / (n_test * (rng / 20)) + 1e-10 AS q
       FROM jg LEFT JOIN jb USING ({keys}, bin)),
nm AS (SELECT {keys}, p / sum(p) OVER (PARTITION BY {keys}) AS p, q / sum(q) OVER (PARTITION BY {keys}) AS q FROM de),
js AS (SELECT {keys}, sqrt((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2) AS js
       FROM nm GROUP BY {keys}),
r0 AS (SELECT sz.*, ks.ks_statistic, coalesce(ps.psi, 0.0) AS psi, js.js
       FROM sz JOIN ks USING ({keys}) LEFT JOIN ps USING ({keys}) JOIN js USING ({keys})),
r1 AS (SELECT *, {ksp} AS ks_pvalue FROM r0),
r2 AS (SELECT *, (CAST(ks_pvalue < 0.05 AS INTEGER) + CAST(psi > 0.1 AS INTEGER) + CAST(js > 0.05 AS INTEGER)) >= 2
                 AS drift_detected FROM r1)
SELECT {keys}, n_train, n_test, drift_detected,
       CASE WHEN drift_detected AND (ks_pvalue < 0.01 OR psi > 0.25) THEN 'critical'
            WHEN drift_detected THEN 'warning' ELSE 'none' END AS severity,
       {rnd('ks_statistic')} AS ks_statistic, {rnd('ks_pvalue', 6)} AS ks_pvalue, {rnd('psi')} AS psi,
       {rnd('js')} AS js_distance, {rnd('m0')} AS train_mean, {rnd('m1')} AS test_mean,
       {rnd('s0')} AS train_std, {rnd('s1')} AS test_std
FROM r2"""


def drift_rollup_sql(report_sql: str, total: int) -> str:
    return f"""
WITH rep AS ({report_sql}),
a AS (SELECT count(*) FILTER (WHERE drift_detected) AS features_drifted,
             count(*) FILTER (WHERE severity = 'critical') AS critical_count FROM rep),
b AS (SELECT *, CASE WHEN critical_count > 0 OR features_drifted / {max(total, 1)} > 0.3 THEN 'critical'
                     WHEN features_drifted > 0 THEN 'warning' ELSE 'none' END AS drift_severity FROM a)
SELECT features_drifted > 0 AS overall_drift_detected, drift_severity, features_drifted, critical_count,
       CAST({total} AS BIGINT) AS total_features,
       CASE WHEN drift_severity = 'none' THEN 'No significant distribution drift detected between train and test sets. Model predictions should be reliable on this data split.'
            WHEN drift_severity = 'warning' THEN CAST(features_drifted AS VARCHAR) || '/{total} features show distribution drift (KS test + PSI). Consider investigating these features — they may reduce model generalizability.'
            ELSE '⚠ CRITICAL: ' || CAST(critical_count AS VARCHAR) || ' features show severe distribution shift. ' || CAST(features_drifted AS VARCHAR) || '/{total} features drifted total. Model performance on test data may be unreliable. Recommend re-sampling or stratified splitting.'
       END AS summary
FROM b"""


def window_drift_sql(ref: str, cur: str, ts: str, cols: list[str]) -> str:
    """SQL twin of ``streaming.drift_stream``: KS at the edges, PSI and JS of each day of ``cur`` against ``ref``."""
    def long(src, more=""):
        return union_all([f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value{more} FROM ({src}) "
                          f"WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in cols])
    probs = ", ".join(repr(i / 10) for i in range(11))
    fine = ", ".join(repr(i / 128) for i in range(1, 128))
    psi_bin = "CASE WHEN len(edges) >= 3 AND value >= edges[1] AND value <= edges[len(edges)] THEN " \
              "least(len(list_filter(edges, lambda e: e <= value)) - 1, len(edges) - 2) END"
    js_bin = "least(19, greatest(0, CAST(floor((value - lo) * 20 / (hi - lo)) AS INTEGER)))"
    day = f", date_trunc('day', {ts}) AS d"
    return f"""
WITH r AS ({long(ref)}), c AS ({long(cur, day)}),
b AS (SELECT feature, count(*) AS ref_n, list_sort(list_distinct(quantile_cont(value, [{probs}]))) AS edges,
             list_sort(list_distinct(quantile_cont(value, [{fine}]))) AS ks_edges,
             CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
             CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM r GROUP BY feature),
rb AS (SELECT feature, {psi_bin} AS pb, {js_bin} AS jb, value FROM r JOIN b USING (feature)),
cb AS (SELECT d, feature, {psi_bin} AS pb, {js_bin} AS jb, value FROM c JOIN b USING (feature)),
w AS (SELECT d, feature, count(*) AS n_current FROM cb GROUP BY d, feature),
pg AS (SELECT w.*, ref_n, len(edges) - 1 AS nb, CAST(g.g AS INTEGER) AS bin
       FROM w JOIN b USING (feature), range(0, 10) g(g) WHERE len(edges) >= 3 AND g.g < len(edges) - 1),
pr AS (SELECT feature, pb AS bin, count(*) AS x FROM rb WHERE pb IS NOT NULL GROUP BY ALL),
pc AS (SELECT d, feature, pb AS bin, count(*) AS y FROM cb WHERE pb IS NOT NULL GROUP BY ALL),
pq AS (SELECT d, feature, (coalesce(x, 0) + 1.0::DOUBLE) / (ref_n + nb) AS p, (coalesce(y, 0) + 1.0::DOUBLE) / (n_current + nb) AS q
       FROM pg LEFT JOIN pr USING (feature, bin) LEFT JOIN pc USING (d, feature, bin)),
ps AS (SELECT d, feature, sum((q - p) * ln(q / p)) AS psi FROM pq GROUP BY d, feature),
jg AS (SELECT w.*, ref_n, CAST(g.g AS INTEGER) AS bin FROM w JOIN b USING (feature), range(0, 20) g(g)),
jr AS (SELECT feature, jb AS bin, count(*) AS x FROM rb GROUP BY ALL),
jc AS (SELECT d, feature, jb AS bin, count(*) AS y FROM cb GROUP BY ALL),
de AS (SELECT d, feature, coalesce(x, 0)::DOUBLE / ref_n + 1e-10 AS p, coalesce(y, 0)::DOUBLE / n_current + 1e-10 AS q
       FROM jg LEFT JOIN jr USING (feature, bin) LEFT JOIN jc USING (d, feature, bin)),
nm AS (SELECT d, feature, p / sum(p) OVER (PARTITION BY d, feature) AS p, q / sum(q) OVER (PARTITION BY d, feature) AS q FROM de),
js AS (SELECT d, feature, sqrt((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2) AS js FROM nm GROUP BY d, feature),
ke AS (SELECT feature, ref_n, unnest(ks_edges) AS e FROM b),
kr AS (SELECT ke.feature, e, count(*) FILTER (value <= e) / any_value(ref_n) AS f FROM ke JOIN r ON r.feature = ke.feature GROUP BY ke.feature, e),
kc AS (SELECT d, ke.feature, e, count(*) FILTER (value <= e) / count(*) AS f FROM ke JOIN c ON c.feature = ke.feature GROUP BY d, ke.feature, e),
ks AS (SELECT d, feature, max(abs(kc.f - kr.f)) AS ks FROM kc JOIN kr USING (feature, e) GROUP BY d, feature),
kp AS (SELECT d, feature, ks, {ks_pvalue_sql('ks', 'ref_n', 'n_current')} AS p FROM ks JOIN w USING (d, feature) JOIN b USING (feature))
SELECT d AS window_start, d + INTERVAL 1 DAY AS window_end, feature, n_current, {rnd('ks')} AS ks_statistic, {rnd('p', 6)} AS ks_pvalue,
       {rnd('coalesce(psi, 0.0)')} AS psi, {rnd('js')} AS js_distance,
       (CAST(p < 0.05 AS INTEGER) + CAST(coalesce(psi, 0.0) > 0.1 AS INTEGER) + CAST(js > 0.05 AS INTEGER)) >= 2 AS drift_flag
FROM w JOIN js USING (d, feature) JOIN kp USING (d, feature) LEFT JOIN ps USING (d, feature)"""
