"""Query catalogue: every registered operator as (Spark query, DuckDB oracle SQL).

Each query reads the driver tables under ``sf_dir`` in full. Spark callables take
``(spark, sf_dir)``; ``ORACLE[name]`` is the same computation in SQL over the
pre-registered views (absent where SQL cannot express the operator).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, small_frame, table
from . import sqlkit as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Column sets used by the driver queries (fixed per table).

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_KINDS = {"l_orderkey": ("bigint", "numeric"), "l_partkey": ("bigint", "numeric"),
                  "l_suppkey": ("bigint", "numeric"), "l_linenumber": ("int", "numeric"),
                  "l_quantity": ("double", "numeric"), "l_extendedprice": ("double", "numeric"),
                  "l_discount": ("double", "numeric"), "l_tax": ("double", "numeric"),
                  "l_returnflag": ("string", "string"), "l_linestatus": ("string", "string"),
                  "l_shipdate": ("timestamp_ntz", "datetime")}
LINEITEM_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVENTS_NUMERIC = ["event_id", "user_id", "value"]


# ---------------------------------------------------------------------------
# P: schema profile

def _profile_sql() -> str:
    parts = []
    for i, c in enumerate(LINEITEM_COLS):
        dtype, kind = LINEITEM_KINDS[c]
        num = kind == "numeric"
        nu = f"count(DISTINCT {c})"
        if kind == "numeric":
            role = (f"CASE WHEN {nu} <= 20 AND {nu} / greatest(count(*), 1) < 0.05 "
                    f"THEN 'categorical' ELSE 'numeric' END")
        elif kind == "datetime":
            role = "'datetime'"
        else:
            dt = f"(count({c}) > 0 AND count({c}) = count(TRY_CAST({c} AS TIMESTAMP)))"
            role = f"CASE WHEN {dt} THEN 'datetime' WHEN {nu} <= 50 THEN 'categorical' ELSE 'text' END"

        def stat(e):
            return S.safe4(e) if num else "NULL::DOUBLE"
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS position, '{dtype}' AS dtype, count(*) AS n_rows, "
            f"{nu} AS n_unique, count(*) - count({c}) AS n_missing, "
            f"CASE WHEN count(*) > 0 THEN round((count(*) - count({c})) * 100.0 / count(*), 2) ELSE 0.0 END AS missing_pct, "
            f"{role} AS role, {stat(f'min({c})')} AS _min, {stat(f'max({c})')} AS _max, "
            f"{stat(f'avg({c})')} AS _mean, {stat(f'stddev_samp({c})')} AS _std FROM lineitem")
    return f"""
WITH p AS ({S.union_all(parts)})
SELECT column_name, position, dtype, n_rows, n_unique, n_missing, missing_pct, role,
       CASE WHEN role = 'numeric' THEN _min END AS min_value,
       CASE WHEN role = 'numeric' THEN _max END AS max_value,
       CASE WHEN role = 'numeric' THEN _mean END AS mean_value,
       CASE WHEN role = 'numeric' THEN _std END AS std_value,
       role IN ('numeric', 'categorical') AND n_unique > 1 AS is_potential_target,
       role = 'datetime' AS is_datetime,
       bool_or(role = 'datetime') OVER () AS has_datetime
FROM p"""


@register("schema_profile", _profile_sql())
def q_schema_profile(spark, sf):
    from ..operators.profile import clean, schema_profile
    return schema_profile(clean(table(spark, sf, "lineitem")))


@register("role_counts", f"""
WITH p AS ({_profile_sql()})
SELECT role, count(*) AS n_columns FROM p GROUP BY role""")
def q_role_counts(spark, sf):
    from ..operators.profile import clean, schema_profile
    from ..operators.stats import role_counts
    return role_counts(schema_profile(clean(table(spark, sf, "lineitem"))))


# ---------------------------------------------------------------------------
# E: exploratory statistics

def _numeric_stats_sql(tbl: str, cols: list[str]) -> str:
    return f"""
WITH l AS ({S.long_values(tbl, cols)}),
m AS (SELECT column_name, count(*) AS n, avg(value) AS mean_, stddev_samp(value) AS std_,
             min(value) AS min_, max(value) AS max_,
             quantile_cont(value, 0.25) AS q25_, quantile_cont(value, 0.5) AS med_,
             quantile_cont(value, 0.75) AS q75_,
             skewness(value) AS skew_, kurtosis(value) AS kurt_
      FROM l GROUP BY column_name)
SELECT column_name, n, {S.safe4('mean_')} AS mean, {S.safe4('med_')} AS median, {S.safe4('std_')} AS std,
       {S.safe4('min_')} AS min, {S.safe4('max_')} AS max, {S.safe4('q25_')} AS q25, {S.safe4('q75_')} AS q75,
       {S.safe4('skew_')} AS skewness, {S.safe4('kurt_')} AS kurtosis
FROM m"""


@register("numeric_stats", _numeric_stats_sql("lineitem", LINEITEM_MEASURES + ["l_orderkey"]))
def q_numeric_stats(spark, sf):
    from ..operators.stats import numeric_stats
    return numeric_stats(table(spark, sf, "lineitem"), LINEITEM_MEASURES + ["l_orderkey"])


@register("numeric_stats_part", _numeric_stats_sql("part", ["p_retailprice", "p_size"]))
def q_numeric_stats_part(spark, sf):
    from ..operators.stats import numeric_stats
    return numeric_stats(table(spark, sf, "part"), ["p_retailprice", "p_size"])


def _top_sql(tbl: str, cols: list[str], k: int = 10) -> str:
    parts = S.union_all([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {tbl} WHERE {c} IS NOT NULL"
                         for c in cols])
    return f"""
WITH l AS ({parts}),
c AS (SELECT column_name, value, count(*) AS n FROM l GROUP BY column_name, value),
r AS (SELECT column_name, value, n, sum(n) OVER (PARTITION BY column_name) AS total,
             row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM c)
SELECT column_name, rank, value, n AS count, round(n / total, 4) AS freq FROM r WHERE rank <= {k}"""


TOP_LINEITEM = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax", "l_suppkey"]


@register("categorical_top10", _top_sql("lineitem", TOP_LINEITEM))
def q_categorical_top10(spark, sf):
    from ..operators.stats import top_values
    return top_values(table(spark, sf, "lineitem"), TOP_LINEITEM)


@register("categorical_top10_events", _top_sql("events", ["event_type", "user_id"]))
def q_categorical_top10_events(spark, sf):
    from ..operators.stats import top_values
    return top_values(table(spark, sf, "events"), ["event_type", "user_id"])


@register("duplicate_rows", """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang, source)""")
def q_duplicate_rows(spark, sf):
    from ..operators.stats import duplicate_rows
    return duplicate_rows(table(spark, sf, "documents").select("text", "lang", "source"))


def _docs_labels(spark, sf):
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left")


DOCS_LABELS_SQL = ("(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                   "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")


@register("missing_table", f"""
WITH t AS {DOCS_LABELS_SQL},
m AS ({S.union_all([f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, count(*) AS n FROM t"
                    for c in ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]])})
SELECT column_name, missing_count, round(missing_count * 100.0 / n, 2) AS missing_pct FROM m WHERE missing_count > 0""")
def q_missing_table(spark, sf):
    from ..operators.stats import missing_table
    return missing_table(_docs_labels(spark, sf))


def _hist_sql(tbl: str, cols: list[str], bins: int = 20) -> str:
    return f"""
WITH l AS ({S.long_values(tbl, cols)}),
b AS (SELECT column_name, count(*) AS n,
             CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
             CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
      FROM l GROUP BY column_name HAVING count(*) >= 5),
c AS (SELECT l.column_name, least({bins - 1}, CAST(floor((value - lo) * {bins} / (hi - lo)) AS INTEGER)) AS bin,
             count(*) AS cnt
      FROM l JOIN b USING (column_name) GROUP BY ALL),
g AS (SELECT column_name, lo, hi, CAST(x.bin AS INTEGER) AS bin FROM b, range(0, {bins}) x(bin))
SELECT g.column_name, g.bin, {S.rnd(f'g.lo + g.bin * (g.hi - g.lo) / {bins}')} AS lo,
       {S.rnd(f'g.lo + (g.bin + 1) * (g.hi - g.lo) / {bins}')} AS hi,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON g.column_name = c.column_name AND g.bin = c.bin"""


@register("histogram20", _hist_sql("events", ["value"]))
def q_histogram20(spark, sf):
    from ..operators.stats import histogram
    return histogram(table(spark, sf, "events"), ["value"])


@register("histogram20_lineitem", _hist_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def q_histogram20_lineitem(spark, sf):
    from ..operators.stats import histogram
    return histogram(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


def _moments_cte(tbl: str, cols: list[str]) -> str:
    return f"""
l AS ({S.long_values(tbl, cols)}),
mu AS (SELECT column_name, avg(value) AS mean_ FROM l GROUP BY column_name),
mom AS (SELECT l.column_name, count(*) AS n, avg(pow(value - mean_, 2)) AS m2,
               avg(pow(value - mean_, 3)) AS m3, avg(pow(value - mean_, 4)) AS m4
        FROM l JOIN mu USING (column_name) GROUP BY l.column_name),
g AS (SELECT column_name, n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) - 3.0 AS g2 FROM mom)"""


@register("normality_k2", f"""
WITH {_moments_cte('events', ['value'])}
SELECT column_name, n, {S.safe4(S.dagostino_sql('n', 'g1', 'g2'), 6)} AS p_value,
       {S.dagostino_sql('n', 'g1', 'g2')} > 0.05 AS is_normal
FROM g WHERE n >= 8""")
def q_normality_k2(spark, sf):
    from ..operators.stats import normality_k2
    return normality_k2(table(spark, sf, "events"), ["value"])


def _normality_sql(tbl, cols):
    """Row by row: every rank's expected order statistic, then the shared closing formulas."""
    from ..functions.exprs import INVERSE_NORMAL_STEPS
    from ..operators.normality import STEPS

    def chain(name, steps):
        return "".join(f",\n{name}{k} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in step.items())} FROM {name}{k - 1})"
                       for k, step in enumerate(steps, 1))
    steps, ranks = chain("t", STEPS), chain("o", INVERSE_NORMAL_STEPS)
    k2 = f"CASE WHEN n >= 8 THEN {S.dagostino_sql('n', 'g1', 'g2')} END"
    return f"""
WITH {_moments_cte(tbl, cols)},
r AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) AS i,
             count(*) OVER (PARTITION BY column_name) AS n FROM l),
o0 AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM r WHERE n >= 5){ranks},
o AS (SELECT * FROM o{len(INVERSE_NORMAL_STEPS)}),
t0 AS (SELECT o.column_name, o.n::DOUBLE AS n, sum(m * m) AS mm, sum(m * value) AS mx,
              sum((value - mean_) * (value - mean_)) AS ss, max(CASE WHEN i = o.n THEN m END) AS m1,
              max(CASE WHEN i = o.n - 1 THEN m END) AS m2, min(value) AS x1, max(value) AS y1,
              max(CASE WHEN i = 2 THEN value END) AS x2, max(CASE WHEN i = o.n - 1 THEN value END) AS y2,
              any_value(g1) AS g1, any_value(g2) AS g2
       FROM o JOIN mu USING (column_name) JOIN g USING (column_name) GROUP BY o.column_name, o.n){steps}
SELECT column_name, n::BIGINT AS n, round(w, 6) + 0.0 AS w_statistic, round(w_p, 6) + 0.0 AS w_p_value,
       round({k2}, 6) + 0.0 AS k2_p_value, coalesce(coalesce(w_p, {k2}) > 0.05, false) AS is_normal
FROM t{len(STEPS)}"""


@register("normality", _normality_sql("documents", ["n_chars", "doc_id"]))
def q_normality(spark, sf):
    """E-7: W and K^2 over all rows."""
    from ..operators.stats import normality
    return normality(table(spark, sf, "documents"), ["n_chars", "doc_id"])


PEARSON_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _pearson_sql() -> str:
    parts = []
    for i, a in enumerate(PEARSON_COLS):
        for b in PEARSON_COLS[i:]:
            r = (f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) = 0 THEN 0.0 "
                 f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {S.safe4(r)} AS r FROM lineitem")
            if a != b:
                parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {S.safe4(r)} AS r FROM lineitem")
    return S.union_all(parts)


@register("pearson_matrix", _pearson_sql())
def q_pearson_matrix(spark, sf):
    from ..operators.stats import correlations
    return correlations(table(spark, sf, "lineitem"), PEARSON_COLS)


def _iqr_cte(tbl: str, cols: list[str]) -> str:
    return f"""
l AS ({S.long_values(tbl, cols)}),
f AS (SELECT column_name, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM l GROUP BY column_name),
b AS (SELECT column_name, n, q1 - 1.5 * (q3 - q1) AS lower_, q3 + 1.5 * (q3 - q1) AS upper_ FROM f WHERE n >= 4),
o AS (SELECT b.column_name, any_value(b.n) AS n, count(*) FILTER (WHERE value < lower_ OR value > upper_) AS n_outliers,
             any_value(lower_) AS lower_, any_value(upper_) AS upper_
      FROM l JOIN b USING (column_name) GROUP BY b.column_name)"""


def _iqr_sql(tbl: str, cols: list[str]) -> str:
    return f"""
WITH {_iqr_cte(tbl, cols)}
SELECT column_name, n_outliers, round(n_outliers * 100.0 / n, 2) AS pct,
       {S.safe4('lower_')} AS lower_bound, {S.safe4('upper_')} AS upper_bound
FROM o WHERE n_outliers > 0"""


@register("iqr_outliers", _iqr_sql("events", ["value", "user_id"]))
def q_iqr_outliers(spark, sf):
    from ..operators.stats import iqr_outliers
    return iqr_outliers(table(spark, sf, "events"), ["value", "user_id"])


@register("iqr_outliers_documents", _iqr_sql("documents", ["n_chars"]))
def q_iqr_outliers_documents(spark, sf):
    from ..operators.stats import iqr_outliers
    return iqr_outliers(table(spark, sf, "documents"), ["n_chars"])


def _quality_sql(tbl: str, all_cols: list[str], num_cols: list[str]) -> str:
    miss = " + ".join(f"(count(*) - count({c}))" for c in all_cols)
    cols = ", ".join(all_cols)
    return f"""
WITH {_iqr_cte(tbl, num_cols)},
ol AS (SELECT avg(round(n_outliers * 100.0 / n, 2)) AS mean_outlier_pct FROM o WHERE n_outliers > 0),
mi AS (SELECT count(*) AS n_rows, {miss} AS total_missing_cells FROM {tbl}),
du AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows
       FROM (SELECT count(*) AS c FROM {tbl} GROUP BY {cols})),
s AS (SELECT n_rows, total_missing_cells, duplicate_rows, mean_outlier_pct,
             CASE WHEN n_rows > 0 THEN round(greatest(100.0
                  - least(total_missing_cells * 100.0 / (n_rows * {len(all_cols)}) * 2, 30.0)
                  - least(duplicate_rows * 100.0 / n_rows, 20.0)
                  - coalesce(least(mean_outlier_pct, 15.0), 0.0), 0.0), 1) ELSE 0.0 END AS quality_score
      FROM mi, du, ol)
SELECT CAST(n_rows AS BIGINT) AS n_rows, CAST({len(all_cols)} AS BIGINT) AS n_cols,
       CAST(total_missing_cells AS BIGINT) AS total_missing_cells, duplicate_rows,
       {S.rnd('mean_outlier_pct')} AS mean_outlier_pct, quality_score,
       CASE WHEN quality_score >= 80 THEN 'good' WHEN quality_score >= 60 THEN 'fair' ELSE 'poor' END AS quality_grade,
       CASE WHEN n_rows > 0 THEN round(total_missing_cells * 100.0 / (n_rows * {len(all_cols)}), 2) ELSE 0.0 END
           AS missing_cells_pct
FROM s"""


EVENTS_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@register("quality_score", _quality_sql("events", EVENTS_COLS, EVENTS_NUMERIC))
def q_quality_score(spark, sf):
    from ..operators.stats import quality_score
    return quality_score(table(spark, sf, "events"), EVENTS_NUMERIC)


@register("quality_score_documents", _quality_sql(DOCS_LABELS_SQL, ["doc_id", "text", "lang", "source", "n_chars",
                                                                    "quality", "toxic"], ["n_chars"]))
def q_quality_score_documents(spark, sf):
    from ..operators.stats import quality_score
    return quality_score(_docs_labels(spark, sf), ["n_chars"])


# ---------------------------------------------------------------------------
# D: drift

EVENTS_SPLIT = "2024-01-16"
DRIFT_EVENT_COLS = ["value", "user_id", "event_id"]
EV_REF_SQL = f"SELECT * FROM events WHERE ts < TIMESTAMP '{EVENTS_SPLIT}'"
EV_CUR_SQL = f"SELECT * FROM events WHERE ts >= TIMESTAMP '{EVENTS_SPLIT}'"


def _event_halves(spark, sf):
    ev = table(spark, sf, "events")
    cut = F.lit(EVENTS_SPLIT).cast("timestamp_ntz")
    return ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)


@register("drift_report", S.drift_sql(EV_REF_SQL, EV_CUR_SQL, DRIFT_EVENT_COLS))
def q_drift_report(spark, sf):
    from ..operators.drift import drift
    ref, cur = _event_halves(spark, sf)
    return drift(ref, cur, DRIFT_EVENT_COLS)


@register("drift_rollup", S.drift_rollup_sql(S.drift_sql(EV_REF_SQL, EV_CUR_SQL, DRIFT_EVENT_COLS),
                                             len(DRIFT_EVENT_COLS)))
def q_drift_rollup(spark, sf):
    from ..operators.drift import drift, drift_rollup
    ref, cur = _event_halves(spark, sf)
    return drift_rollup(drift(ref, cur, DRIFT_EVENT_COLS), len(DRIFT_EVENT_COLS))


@register("drift_by_segment", S.drift_sql(EV_REF_SQL, EV_CUR_SQL, ["value", "user_id"], ["event_type"]))
def q_drift_by_segment(spark, sf):
    """D-12 keyed by segment: one drift row per (event_type, feature)."""
    from ..operators.drift import drift
    ref, cur = _event_halves(spark, sf)
    return drift(ref, cur, ["value", "user_id"], segments=["event_type"])


LI_FEATURES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus"]
LI_TARGET = "l_extendedprice"
LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]   # unique in lineitem
LI_KEY_SQL = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _lineitem_encoded_split_sql() -> str:
    """lineitem: strings label-encoded over the table, medians imputed, exact 80/20 hash split."""
    enc = ", ".join(f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'nan')) - 1 AS DOUBLE) AS {c}"
                    for c in ["l_returnflag", "l_linestatus"])
    nums = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LI_FEATURES if c not in ("l_returnflag", "l_linestatus"))
    return f"""
SELECT *, row_number() OVER (ORDER BY {S.split_hash('k')}, k) <= ceil(count(*) OVER () * 0.2) AS is_test
FROM (SELECT {LI_KEY_SQL} AS k, {nums}, {enc} FROM lineitem)"""


@register("drift_self_split", S.drift_sql(
    f"SELECT * FROM ({_lineitem_encoded_split_sql()}) WHERE NOT is_test",
    f"SELECT * FROM ({_lineitem_encoded_split_sql()}) WHERE is_test", LI_FEATURES))
def q_drift_self_split(spark, sf):
    """D-11: encode + impute (fitted on the table, as the reference does), split 80/20, compare."""
    from ..operators.drift import self_split_drift
    return self_split_drift(table(spark, sf, "lineitem"), LI_KEYS, LI_FEATURES)


# ---------------------------------------------------------------------------
# X: preprocessing

ORDERS_KEY = "o_orderkey"


@register("stratified_split", f"""
SELECT o_orderstatus AS stratum, count(*) AS n_rows, count(*) FILTER (WHERE is_test) AS n_test,
       CAST(sum({S.split_hash('o_orderkey')}) FILTER (WHERE is_test) AS BIGINT) AS test_hash_sum
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {S.split_hash('o_orderkey')},
                                   CAST(o_orderkey AS VARCHAR))
                <= ceil(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test FROM orders)
GROUP BY o_orderstatus""")
def q_stratified_split(spark, sf):
    """X-8: exact per-class ceil(20 %) test rows chosen by md5 hash of the key."""
    from ..functions.exprs import split_hash
    from ..operators.prep import hash_split
    o = table(spark, sf, "orders")
    s = hash_split(o, [ORDERS_KEY], strata="o_orderstatus")
    return s.groupBy(F.col("o_orderstatus").alias("stratum")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_test").alias("n_test"),
        F.sum(F.when(F.col("is_test"), split_hash(F.col(ORDERS_KEY)))).cast("long").alias("test_hash_sum"))


def _orders_prep_sql() -> str:
    """orders, classification on o_orderstatus: codes/medians/scaling fitted on train."""
    h = S.split_hash("k")
    return f"""
WITH b AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_custkey, o_totalprice, o_orderpriority,
                  coalesce(o_orderstatus, 'nan') AS lab FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY {h}, k)
                <= ceil(count(*) OVER (PARTITION BY lab) * 0.2) AS is_test FROM b),
pc AS (SELECT o_orderpriority AS v, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS code
       FROM (SELECT DISTINCT coalesce(o_orderpriority, 'nan') AS o_orderpriority FROM s WHERE NOT is_test)),
lc AS (SELECT lab AS v, CAST(dense_rank() OVER (ORDER BY lab) - 1 AS DOUBLE) AS code
       FROM (SELECT DISTINCT lab FROM s WHERE NOT is_test)),
e AS (SELECT s.k, s.is_test, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, pc.code AS o_orderpriority,
             lc.code AS label
      FROM s LEFT JOIN pc ON coalesce(s.o_orderpriority, 'nan') = pc.v LEFT JOIN lc ON s.lab = lc.v),
md AS (SELECT quantile_cont(o_custkey, 0.5) AS m1, quantile_cont(o_totalprice, 0.5) AS m2,
              quantile_cont(o_orderpriority, 0.5) AS m3 FROM e WHERE NOT is_test),
i AS (SELECT k, is_test, coalesce(o_custkey, m1) AS o_custkey, coalesce(o_totalprice, m2) AS o_totalprice,
             coalesce(o_orderpriority, m3) AS o_orderpriority, label FROM e, md),
st AS (SELECT avg(o_custkey) AS a1, stddev_pop(o_custkey) AS d1, avg(o_totalprice) AS a2,
              stddev_pop(o_totalprice) AS d2, avg(o_orderpriority) AS a3, stddev_pop(o_orderpriority) AS d3
       FROM i WHERE NOT is_test)
SELECT k AS _key, is_test,
       {S.rnd('(o_custkey - a1) / CASE WHEN d1 = 0 THEN 1.0 ELSE d1 END', 6)} AS o_custkey,
       {S.rnd('(o_totalprice - a2) / CASE WHEN d2 = 0 THEN 1.0 ELSE d2 END', 6)} AS o_totalprice,
       {S.rnd('(o_orderpriority - a3) / CASE WHEN d3 = 0 THEN 1.0 ELSE d3 END', 6)} AS o_orderpriority,
       label
FROM i, st"""


@register("prep_matrix", _orders_prep_sql())
def q_prep_matrix(spark, sf):
    """X-1 ... X-9 on orders (target o_orderstatus): stratified split, codes, medians and
    scaling fitted on train, applied to both sides; one row per order."""
    from ..functions.exprs import rnd
    from ..operators.prep import prepare, standardize
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
                                          "o_orderstatus")
    prep = prepare(o, "o_orderstatus", "classification", ["o_orderkey"])
    feats = prep["features"]
    tr = standardize(prep["train"], feats, fit=prep["train"]).withColumn("is_test", F.lit(False))
    te = standardize(prep["test"], feats, fit=prep["train"]).withColumn("is_test", F.lit(True))
    both = tr.unionByName(te)
    return both.select("_key", "is_test", *[rnd(F.col(c), 6).alias(c) for c in feats], "label")


# ---------------------------------------------------------------------------
# Generic per-table profile SQL (the twin of operators.profile.schema_profile)

TABLE_KINDS = {
    "lineitem": [(c, *LINEITEM_KINDS[c]) for c in LINEITEM_COLS],
    "orders": [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
               ("o_orderstatus", "string", "string"), ("o_totalprice", "double", "numeric"),
               ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "string")],
    "events": [("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"),
               ("user_id", "bigint", "numeric"), ("event_type", "string", "string"),
               ("value", "double", "numeric"), ("props", "string", "string")],
    "documents": [("doc_id", "bigint", "numeric"), ("text", "string", "string"), ("lang", "string", "string"),
                  ("source", "string", "string"), ("n_chars", "bigint", "numeric")],
    "part": [("p_partkey", "bigint", "numeric"), ("p_name", "string", "string"), ("p_brand", "string", "string"),
             ("p_type", "string", "string"), ("p_size", "int", "numeric"), ("p_retailprice", "double", "numeric")],
    "labels": [("doc_id", "bigint", "numeric"), ("quality", "int", "numeric"), ("toxic", "int", "numeric")],
    "customer": [("c_custkey", "bigint", "numeric"), ("c_name", "string", "string"), ("c_nationkey", "int", "numeric"),
                 ("c_acctbal", "double", "numeric"), ("c_mktsegment", "string", "string")],
}


def profile_sql(tbl: str, dataset_id: int | None = None) -> str:
    parts = []
    ds = f"{dataset_id} AS dataset_id, " if dataset_id is not None else ""
    for i, (c, dtype, kind) in enumerate(TABLE_KINDS[tbl]):
        num = kind == "numeric"
        nu = f"count(DISTINCT {c})"
        if kind == "numeric":
            role = (f"CASE WHEN {nu} <= 20 AND {nu} / greatest(count(*), 1) < 0.05 "
                    f"THEN 'categorical' ELSE 'numeric' END")
        elif kind == "datetime":
            role = "'datetime'"
        else:
            dt = f"(count({c}) > 0 AND count({c}) = count(TRY_CAST({c} AS TIMESTAMP)))"
            role = f"CASE WHEN {dt} THEN 'datetime' WHEN {nu} <= 50 THEN 'categorical' ELSE 'text' END"

        def stat(e):
            return S.safe4(e) if num else "NULL::DOUBLE"
        parts.append(
            f"SELECT {ds}'{c}' AS column_name, {i} AS position, '{dtype}' AS dtype, count(*) AS n_rows, "
            f"{nu} AS n_unique, count(*) - count({c}) AS n_missing, "
            f"CASE WHEN count(*) > 0 THEN round((count(*) - count({c})) * 100.0 / count(*), 2) ELSE 0.0 END AS missing_pct, "
            f"{role} AS role, {stat(f'min({c})')} AS _min, {stat(f'max({c})')} AS _max, "
            f"{stat(f'avg({c})')} AS _mean, {stat(f'stddev_samp({c})')} AS _std FROM {tbl}")
    return S.union_all(parts)


# ---------------------------------------------------------------------------
# T: task detection

TASK_CASES = [(1, "lineitem", "l_extendedprice"), (2, "orders", "o_orderstatus"), (3, "orders", None),
              (4, "part", "p_retailprice"), (5, "labels", "quality")]


def _task_sql() -> str:
    profs = S.union_all([f"SELECT * FROM ({profile_sql(t, i)})" for i, t, _ in TASK_CASES])
    tg = S.union_all([f"SELECT {i} AS dataset_id, {repr(tc) if tc else 'NULL::VARCHAR'} AS target_column"
                      for i, _, tc in TASK_CASES])
    return f"""
WITH p AS ({profs}),
tg AS ({tg}),
fl AS (SELECT dataset_id, bool_or(role = 'datetime') AS has_datetime FROM p GROUP BY dataset_id),
j AS (SELECT tg.dataset_id, tg.target_column, fl.has_datetime, p.role AS trole0, p.n_unique AS tnu0,
             coalesce(p.role, 'numeric') AS trole, coalesce(p.n_unique, 10) AS tnu,
             tg.target_column IS NOT NULL AND tg.target_column <> '' AS has_t
      FROM tg LEFT JOIN fl USING (dataset_id) LEFT JOIN p ON p.dataset_id = tg.dataset_id AND p.column_name = tg.target_column),
k AS (SELECT *, coalesce(has_datetime, false) AND has_t AND trole0 = 'numeric' AS ts,
             trole = 'categorical' OR (trole = 'numeric' AND tnu <= 20) AS cls FROM j)
SELECT dataset_id, CASE WHEN has_t THEN target_column END AS target_column,
       CASE WHEN ts THEN 'time_series' WHEN NOT has_t THEN 'clustering' WHEN cls THEN 'classification'
            WHEN trole = 'numeric' THEN 'regression' ELSE 'classification' END AS task_type,
       CASE WHEN ts THEN 0.85 WHEN NOT has_t THEN 0.75 WHEN cls THEN 0.88 WHEN trole = 'numeric' THEN 0.90 ELSE 0.60 END
           ::DOUBLE AS confidence,
       CASE WHEN ts THEN 'Dataset has datetime column(s) and a numeric target, suggesting time-series forecasting.'
            WHEN NOT has_t THEN 'No target column specified — unsupervised clustering is the natural approach.'
            WHEN cls THEN 'Target ''' || target_column || ''' has ' || CAST(tnu AS VARCHAR) || ' unique values — classification task.'
            WHEN trole = 'numeric' THEN 'Target ''' || target_column || ''' is continuous numeric — regression task.'
            ELSE 'Fallback to classification based on target column analysis.' END AS reasoning,
       'heuristic' AS source
FROM k"""


def _profiles_with_ids(spark, sf, cases):
    from ..operators.profile import clean, schema_profile
    out = None
    for i, t, _ in cases:
        p = schema_profile(clean(table(spark, sf, t))).withColumn("dataset_id", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


@register("task_detect", _task_sql())
def q_task_detect(spark, sf):
    """T-1 ... T-4 for five (table, target) cases in one keyed job."""
    from ..operators.task import detect_task
    targets = spark.createDataFrame([(i, tc) for i, _, tc in TASK_CASES], "dataset_id int, target_column string")
    return detect_task(_profiles_with_ids(spark, sf, TASK_CASES), targets)


@register("class_distribution", """
WITH c AS (SELECT CAST(o_orderstatus AS VARCHAR) AS class_value, count(*) AS n FROM orders
           WHERE o_orderstatus IS NOT NULL GROUP BY 1)
SELECT class_value, count(*) OVER () AS n_classes, count(*) OVER () = 2 AS is_binary,
       round(n / sum(n) OVER (), 4) AS share FROM c""")
def q_class_distribution(spark, sf):
    """T-6 on orders.o_orderstatus."""
    from ..operators.task import class_distribution
    return class_distribution(table(spark, sf, "orders"), "o_orderstatus")


@register("regression_detail", f"""
SELECT min(o_totalprice) AS target_min, max(o_totalprice) AS target_max, avg(o_totalprice) AS target_mean,
       stddev_samp(o_totalprice) AS target_std FROM orders""".replace(
    "min(o_totalprice) AS target_min", f"{S.rnd('min(o_totalprice)', 6)} AS target_min").replace(
    "max(o_totalprice) AS target_max", f"{S.rnd('max(o_totalprice)', 6)} AS target_max").replace(
    "avg(o_totalprice) AS target_mean", f"{S.rnd('avg(o_totalprice)', 6)} AS target_mean").replace(
    "stddev_samp(o_totalprice) AS target_std", f"{S.rnd('stddev_samp(o_totalprice)', 6)} AS target_std"))
def q_regression_detail(spark, sf):
    """T-7 on orders.o_totalprice."""
    from ..functions.exprs import rnd
    from ..operators.task import regression_detail
    r = regression_detail(table(spark, sf, "orders"), "o_totalprice")
    return r.select(*[rnd(F.col(c), 6).alias(c) for c in r.columns])


@register("suggested_k", """
SELECT CAST(least(greatest(2, floor(sqrt(count(*)) / 5)), 10) AS INTEGER) AS suggested_k, count(*) AS n_rows
FROM embeddings""")
def q_suggested_k(spark, sf):
    """T-8 on embeddings."""
    from ..operators.task import suggested_k
    return suggested_k(table(spark, sf, "embeddings"))


# ---------------------------------------------------------------------------
# F: feature suggestions and transforms

def _suggest_sql(tbl: str, numeric: list[str]) -> str:
    hint = {"log1p": "'F.log1p(F.greatest(F.col(''' || column_name || '''), F.lit(0)))'",
            "sqrt": "'F.sqrt(F.greatest(F.col(''' || column_name || '''), F.lit(0)))'"}
    if len(numeric) >= 2:
        pairs = []
        for i, a in enumerate(numeric):
            for b in numeric[i + 1:]:
                r = (f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) = 0 THEN 0.0 "
                     f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")
                pairs.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {S.safe4(r)} AS r FROM {tbl}")
        cr = S.union_all(pairs)
    else:
        cr = "SELECT NULL::VARCHAR AS col_a, NULL::VARCHAR AS col_b, NULL::DOUBLE AS r WHERE false"
    return f"""
WITH prof AS ({profile_sql(tbl)}),
l AS ({S.long_values(tbl, numeric)}),
sk AS (SELECT column_name, {S.safe4('skewness(value)')} AS skewness FROM l GROUP BY column_name HAVING count(*) >= 5),
{_iqr_cte(tbl, numeric).strip().replace('l AS (', 'l2 AS (', 1).replace('FROM l GROUP', 'FROM l2 GROUP').replace('FROM l JOIN', 'FROM l2 JOIN')},
ol AS (SELECT column_name, round(n_outliers * 100.0 / n, 2) AS pct FROM o WHERE n_outliers > 0),
cr AS ({cr}),
num AS (SELECT prof.column_name, position, abs(coalesce(skewness, 0.0)) AS s, pct
        FROM prof LEFT JOIN sk USING (column_name) LEFT JOIN ol USING (column_name) WHERE role = 'numeric'),
r AS (
  SELECT column_name AS feature, 'log1p' AS transform, printf('High skewness (%.2f) — log transform will normalize distribution', s) AS reason,
         'high' AS priority, 'Reduces outlier influence, improves linear model performance' AS impact,
         {hint['log1p']} AS code_hint, 0 AS g, position AS p1, 0 AS p2, 0 AS sub FROM num WHERE s > 2.0
  UNION ALL
  SELECT column_name, 'sqrt', printf('Moderate skewness (%.2f) — square root can help', s), 'medium',
         'Reduces tail effects for parametric models', {hint['sqrt']}, 0, position, 0, 0 FROM num WHERE s > 1.0 AND s <= 2.0
  UNION ALL
  SELECT column_name, 'robust_scale', CAST(pct AS VARCHAR) || '% outliers detected — robust scaling recommended', 'high',
         'IQR-based scaling resists outlier distortion', 'pyspark.ml.feature.RobustScaler', 0, position, 0, 1
  FROM num WHERE pct > 5
  UNION ALL
  SELECT cr.col_a || ' × ' || cr.col_b, 'interaction',
         printf('High correlation (%.2f) — interaction term may capture non-linear relationship', cr.r), 'medium',
         'Captures multiplicative effects between related features',
         'F.col(''' || cr.col_a || ''') * F.col(''' || cr.col_b || ''')', 1, a.position, b.position, 0
  FROM cr JOIN num a ON a.column_name = cr.col_a JOIN num b ON b.column_name = cr.col_b
  WHERE a.position < b.position AND abs(cr.r) > 0.7
  UNION ALL
  SELECT column_name, CASE WHEN n_unique > 10 THEN 'target_encode' ELSE 'one_hot' END,
         CASE WHEN n_unique > 10 THEN printf('High cardinality (%d categories) — target encoding preferred over one-hot', n_unique)
              ELSE printf('Low cardinality (%d categories) — one-hot encoding is safe', n_unique) END,
         CASE WHEN n_unique > 10 THEN 'high' ELSE 'low' END,
         CASE WHEN n_unique > 10 THEN 'Avoids dimensionality explosion from one-hot encoding'
              ELSE 'Standard encoding for tree-based and linear models' END,
         CASE WHEN n_unique > 10 THEN 'pyspark.ml.feature.TargetEncoder(inputCols=[''' || column_name || '''])'
              ELSE 'pyspark.ml.feature.OneHotEncoder(inputCols=[''' || column_name || '''])' END,
         2, position, 0, 0 FROM prof WHERE role = 'categorical'
  UNION ALL
  SELECT column_name, 'datetime_extract', 'Datetime column — extract year, month, day_of_week, hour for temporal patterns',
         'high', 'Unlocks seasonal and cyclical patterns in the data', 'F.month(F.col(''' || column_name || '''))',
         3, position, 0, 0 FROM prof WHERE role = 'datetime'),
k AS (SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END,
                                   g, p1, p2, sub) AS rank FROM r)
SELECT rank, feature, transform, reason, priority, impact, code_hint FROM k WHERE rank <= 8"""


def _suggest_spark(spark, sf, tbl):
    from ..operators.features import suggest_features
    from ..operators.profile import clean, schema_profile
    from ..operators.stats import correlations, iqr_outliers, numeric_stats, role_columns
    df = clean(table(spark, sf, tbl) if isinstance(tbl, str) else tbl)
    prof = small_frame(schema_profile(df))  # one row per column: metadata, not data
    num = role_columns(prof)
    skew = numeric_stats(df, num).where(F.col("n") >= 5) if num else None
    outl = iqr_outliers(df, num) if num else None
    corr = correlations(df, num)
    empty = spark.createDataFrame([], "column_name string, skewness double, pct double")
    return suggest_features(prof, skew if skew is not None else empty, outl if outl is not None else empty, corr)


@register("feature_suggest", _suggest_sql("documents", ["doc_id", "n_chars"]))
def q_feature_suggest(spark, sf):
    """F-1 ... F-8 on documents (n_chars is heavily skewed)."""
    return _suggest_spark(spark, sf, "documents")


@register("feature_suggest_events", _suggest_sql("events", ["event_id", "user_id", "value"]))
def q_feature_suggest_events(spark, sf):
    """F-1 ... F-8 on events (moderate skew, one-hot, datetime)."""
    return _suggest_spark(spark, sf, "events")


_PRICES_SQL = "SELECT l_orderkey, l_extendedprice, l_extendedprice * (1 - l_discount) AS net_price, l_extendedprice * (1 + l_tax) AS gross_price FROM lineitem"


TABLE_KINDS[f"({_PRICES_SQL})"] = [("l_orderkey", "bigint", "numeric"), *[(c, "double", "numeric") for c in ("l_extendedprice", "net_price", "gross_price")]]


@register("feature_suggest_derived", _suggest_sql(f"({_PRICES_SQL})", ["l_orderkey", "l_extendedprice", "net_price", "gross_price"]))
def q_feature_suggest_derived(spark, sf):
    """F-4: prices before and after discount and tax, whose pairs are correlated enough for interactions."""
    return _suggest_spark(spark, sf, spark.sql(_PRICES_SQL.replace("FROM lineitem", "FROM {li}"), li=table(spark, sf, "lineitem")))


@register("feature_apply", f"""
SELECT doc_id, n_chars,
       {S.rnd('CASE WHEN n_chars IS NOT NULL THEN ln(1 + greatest(CAST(n_chars AS DOUBLE), 0.0)) END', 6)} AS n_chars_log,
       {S.rnd('CASE WHEN n_chars IS NOT NULL THEN sqrt(greatest(CAST(n_chars AS DOUBLE), 0.0)) END', 6)} AS n_chars_sqrt,
       doc_id * n_chars AS doc_id_x_n_chars,
       year(ts) AS ts_year, month(ts) AS ts_month, CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS ts_day_of_week,
       hour(ts) AS ts_hour
FROM (SELECT d.doc_id, d.n_chars, e.ts FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id)""")
def q_feature_apply(spark, sf):
    """F-9 ... F-12 and F-16: log1p/sqrt/interaction in one projection, datetime parts."""
    from ..functions.exprs import rnd
    from ..operators.features import apply_features, datetime_extract
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    e = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts")
    sugg = [{"feature": "n_chars", "transform": "log1p"}, {"feature": "n_chars", "transform": "sqrt"},
            {"feature": "doc_id × n_chars", "transform": "interaction"}, {"feature": "x", "transform": "unknown"}]
    out = datetime_extract(apply_features(d, sugg).join(e, "doc_id", "left"), "ts").drop("ts")
    return out.withColumn("n_chars_log", rnd(F.col("n_chars_log"), 6)).withColumn("n_chars_sqrt", rnd(F.col("n_chars_sqrt"), 6))


# ---------------------------------------------------------------------------
# C: recommendation

REC_CASES = [(1, "orders", "classification", ["o_orderkey", "o_custkey", "o_totalprice"]),
             (2, "lineitem", "regression", ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]),
             (3, "customer", "clustering", ["c_custkey", "c_nationkey", "c_acctbal"])]


def _registry_sql() -> str:
    from ..operators.recommend import REGISTRY

    def lit(s):
        return "'" + s.replace("'", "''") + "'"
    def many(items):
        return f"[{', '.join(lit(p) for p in items)}]"
    rows = [f"({lit(k)}, {lit(n)}, {lit(t)}, {many(pros)}, {many(cons)}, {lit(cx)}, {lit(it)}, {lit(uw)}, {lit(impl)}, {i})"
            for i, (k, n, t, pros, cons, cx, it, uw, impl) in enumerate(REGISTRY)]
    return (f"SELECT * FROM (VALUES {', '.join(rows)}) "
            f"AS reg(model_key, model_name, task, pros, cons, complexity, interpretability, use_when, spark_impl, registry_pos)")


def _summary_sql(i: int, tbl: str, task: str, num: list[str]) -> str:
    cols = [c for c, _, _ in TABLE_KINDS[tbl]]
    miss = S.union_all([f"SELECT count(*) - count({c}) AS m FROM {tbl}" for c in cols])
    return f"""
SELECT {i} AS dataset_id, '{task}' AS task_type, q.n_rows, q.n_cols, q.quality_score,
       (SELECT count(*) FROM ({miss}) WHERE m > 0) AS n_missing_cols,
       (SELECT count(*) FROM ({_iqr_sql(tbl, num)})) AS n_outlier_cols,
       (SELECT count(*) FILTER (WHERE role = 'numeric') FROM ({profile_sql(tbl)})) AS numeric_count,
       (SELECT count(*) FILTER (WHERE role = 'categorical') FROM ({profile_sql(tbl)})) AS cat_count
FROM ({_quality_sql(tbl, cols, num)}) q"""


def _recommend_sql(summ: str | None = None, more: str = "") -> str:
    summ = summ or S.union_all([_summary_sql(*c) for c in REC_CASES])
    return f"""
WITH s AS ({summ}),
reg AS ({_registry_sql()}),
j AS (SELECT s.*, reg.*, array_to_string(pros, ' ') AS pj FROM s JOIN reg ON s.task_type = reg.task),
sc AS (SELECT *, round(least(CAST(50.0
         + CASE WHEN n_rows < 500 THEN CASE WHEN complexity = 'low' THEN 15 WHEN complexity = 'high' THEN -10 ELSE 0 END
                WHEN n_rows < 10000 THEN CASE WHEN complexity IN ('low', 'medium') THEN 10 ELSE 5 END
                ELSE CASE WHEN complexity = 'high' THEN 15 ELSE 5 END END
         + CASE WHEN quality_score < 60 THEN (CASE WHEN contains(pj, 'Robust') THEN 10 ELSE 0 END)
                + (CASE WHEN contains(pj, 'Handles missing values') THEN 8 ELSE 0 END) ELSE 0 END
         + CASE WHEN n_outlier_cols > 2 AND model_key IN ('random_forest_reg', 'random_forest_clf', 'xgboost_reg',
                'xgboost_clf', 'dbscan') THEN 8 ELSE 0 END
         + CASE WHEN interpretability IN ('high', 'very_high') THEN 5 ELSE 0 END
         + CASE WHEN model_key IN ('xgboost_reg', 'xgboost_clf', 'gradient_boosting_reg', 'gradient_boosting_clf') THEN 10 ELSE 0 END
         - CASE WHEN model_key IN ('linear_regression', 'ridge', 'logistic_regression', 'svr', 'svm_clf')
                AND cat_count > numeric_count THEN 8 ELSE 0 END AS DOUBLE), 100.0), 2) AS score FROM j),
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY score DESC, registry_pos) AS rank FROM sc)
SELECT dataset_id, rank, model_key, model_name, score, complexity, interpretability, rank = 1 AS recommended,
       CASE WHEN score >= 75 THEN '**' || model_name || '** is highly recommended for this dataset.'
            WHEN score >= 60 THEN '**' || model_name || '** is a solid choice.'
            ELSE '**' || model_name || '** may work but consider alternatives.' END
       || ' Best suited when: *' || use_when || '*.'
       || CASE WHEN n_rows < 500 THEN ' With a small dataset, simpler models may generalize better.'
               WHEN n_rows > 50000 THEN ' With large data, ensemble methods will shine.' ELSE '' END AS reasoning{more}
FROM rk"""


@register("recommend", _recommend_sql())
def q_recommend(spark, sf):
    """C-1 ... C-8: summaries of three tables (from their profiles and EDA) x the registry."""
    from ..operators.profile import clean, schema_profile
    from ..operators.recommend import dataset_summary, recommend, registry
    from ..operators.stats import role_columns
    summ = None
    for i, t, task, _ in REC_CASES:
        df = clean(table(spark, sf, t))
        prof = small_frame(schema_profile(df))          # one row per column
        s = dataset_summary(df, prof, role_columns(prof), i, task)
        summ = s if summ is None else summ.unionByName(s)
    return recommend(summ, registry(spark))


# ---------------------------------------------------------------------------
# M / V: models and evaluation

def _li_split_sql() -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY {S.split_hash('k')}, k) <= ceil(count(*) OVER () * 0.2) AS is_test
FROM (SELECT *, {LI_KEY_SQL} AS k FROM lineitem)"""


@register("linreg_simple", f"""
WITH s AS ({_li_split_sql()}),
f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
      FROM s WHERE NOT is_test),
p AS (SELECT l_extendedprice AS y, a + b * l_quantity AS yhat FROM s, f WHERE is_test),
m AS (SELECT count(*) AS n, sum((y - yhat) * (y - yhat)) AS sse, sum(abs(y - yhat)) AS sae, var_pop(y) AS vy FROM p)
SELECT {S.rnd('b')} AS slope, {S.rnd('a')} AS intercept, {S.rnd('1 - sse / (vy * n)')} AS r2,
       {S.rnd('sqrt(sse / n)')} AS rmse, {S.rnd('sae / n')} AS mae FROM m, f""")
def q_linreg_simple(spark, sf):
    """M-1 + V-1: ordinary least squares (normal equations) on the 80 % hash split, metrics on the 20 %."""
    from pyspark.ml.regression import LinearRegression
    from ..functions.exprs import rnd
    from ..operators.evaluate import regression_metrics
    from ..operators.prep import assemble, hash_split
    li = materialize(hash_split(table(spark, sf, "lineitem").select(
        *LI_KEYS, "l_quantity", F.col("l_extendedprice").alias("label")), LI_KEYS))
    model = LinearRegression(regParam=0.0, solver="normal").fit(assemble(li.where(~F.col("is_test")), ["l_quantity"]))
    pred = model.transform(assemble(li.where(F.col("is_test")), ["l_quantity"]))
    coef = spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "b double, a double")
    return coef.crossJoin(regression_metrics(pred)).select(rnd(F.col("b")).alias("slope"),
                                                           rnd(F.col("a")).alias("intercept"), "r2", "rmse", "mae")


CLS_PRED_SQL = """SELECT CAST(l.quality AS DOUBLE) AS label, CASE WHEN d.n_chars > 500 THEN 1.0 ELSE 0.0 END AS prediction
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def _cls_pred(spark, sf):
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents")
    return lab.join(d, "doc_id").select(F.col("quality").cast("double").alias("label"),
                                        F.when(F.col("n_chars") > 500, 1.0).otherwise(0.0).alias("prediction"))


@register("class_metrics", f"""
WITH p AS ({CLS_PRED_SQL}),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = prediction) AS ok,
             count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
             count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn FROM p)
SELECT {S.rnd('ok / n')} AS accuracy,
       {S.rnd('coalesce(tp / nullif(tp + fp, 0), 0.0)')} AS precision,
       {S.rnd('coalesce(tp / nullif(tp + fn, 0), 0.0)')} AS recall,
       {S.rnd('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)')} AS f1 FROM c""")
def q_class_metrics(spark, sf):
    """V-2/V-3: binary metrics of the rule n_chars > 500 against labels.quality."""
    from ..operators.evaluate import classification_metrics
    return classification_metrics(_cls_pred(spark, sf), n_classes=2)


@register("class_metrics_weighted", f"""
WITH p AS (SELECT CAST(l.quality + l.toxic AS DOUBLE) AS label,
                  CASE WHEN d.n_chars > 2000 THEN 2.0 WHEN d.n_chars > 500 THEN 1.0 ELSE 0.0 END AS prediction
           FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
cls AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
per AS (SELECT c, count(*) FILTER (WHERE label = c AND prediction = c) AS tp,
               count(*) FILTER (WHERE label <> c AND prediction = c) AS fp,
               count(*) FILTER (WHERE label = c AND prediction <> c) AS fn,
               count(*) FILTER (WHERE label = c) AS support FROM cls, p GROUP BY c),
w AS (SELECT sum(support * coalesce(tp / nullif(tp + fp, 0), 0.0)) / sum(support) AS precision,
             sum(support * coalesce(tp / nullif(tp + fn, 0), 0.0)) / sum(support) AS recall,
             sum(support * coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)) / sum(support) AS f1 FROM per)
SELECT {S.rnd('(SELECT count(*) FILTER (WHERE label = prediction) / count(*) FROM p)')} AS accuracy,
       {S.rnd('precision')} AS precision, {S.rnd('recall')} AS recall, {S.rnd('f1')} AS f1 FROM w""")
def q_class_metrics_weighted(spark, sf):
    """V-3 weighted branch: 3-class target (quality + toxic) vs a length rule."""
    from ..operators.evaluate import classification_metrics
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents")
    p = lab.join(d, "doc_id").select(
        (F.col("quality") + F.col("toxic")).cast("double").alias("label"),
        F.when(F.col("n_chars") > 2000, 2.0).when(F.col("n_chars") > 500, 1.0).otherwise(0.0).alias("prediction"))
    return classification_metrics(p, n_classes=3)


@register("confusion_matrix", f"""
SELECT label AS actual, prediction AS predicted, count(*) AS n FROM ({CLS_PRED_SQL}) GROUP BY ALL""")
def q_confusion_matrix(spark, sf):
    """V-4."""
    from ..operators.evaluate import confusion
    return confusion(_cls_pred(spark, sf))


EMB_LONG_SQL = """SELECT vec_id AS key, label AS cluster, CAST(d AS INTEGER) AS dim, CAST(embedding[d + 1] AS DOUBLE) AS x
FROM (SELECT *, unnest(range(len(embedding))) AS d FROM embeddings) WHERE label <> -1"""


@register("cluster_metrics", f"""
WITH l AS ({EMB_LONG_SQL}),
pt AS (SELECT key, cluster, sum(x * x) AS sq FROM l GROUP BY key, cluster),
csz AS (SELECT cluster, count(*) AS nk, sum(sq) AS qk FROM pt GROUP BY cluster),
cdim AS (SELECT cluster, dim, sum(x) AS sk, avg(x) AS ck FROM l GROUP BY cluster, dim),
kk AS (SELECT count(*) AS k, sum(nk) AS n FROM csz),
dots AS (SELECT l.key, l.cluster, c.cluster AS other, sum(l.x * c.sk) AS dot FROM l JOIN cdim c USING (dim)
         GROUP BY l.key, l.cluster, c.cluster),
md AS (SELECT dots.key, dots.cluster, dots.other, o.nk, pt.sq - 2 * dots.dot / o.nk + o.qk / o.nk AS d
       FROM dots JOIN pt USING (key) JOIN csz o ON o.cluster = dots.other),
pp AS (SELECT key, cluster,
              max(CASE WHEN other = cluster THEN CASE WHEN nk > 1 THEN d * nk / (nk - 1) ELSE 0.0 END END) AS a,
              min(CASE WHEN other <> cluster THEN d END) AS b, max(CASE WHEN other = cluster THEN nk END) AS nk
       FROM md GROUP BY key, cluster),
sil AS (SELECT avg(CASE WHEN nk > 1 THEN coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) ELSE 0.0 END) AS s FROM pp),
g AS (SELECT dim, avg(x) AS g FROM l GROUP BY dim),
bt AS (SELECT sum(nk * (ck - g) * (ck - g)) AS bb FROM cdim JOIN g USING (dim) JOIN csz USING (cluster)),
wp AS (SELECT key, l.cluster, sum((x - ck) * (x - ck)) AS w2 FROM l JOIN cdim USING (cluster, dim) GROUP BY key, l.cluster),
wt AS (SELECT sum(w2) AS ww FROM wp),
sk AS (SELECT cluster, avg(sqrt(w2)) AS s FROM wp GROUP BY cluster),
cd AS (SELECT a.cluster AS ka, b.cluster AS kb, sqrt(sum((a.ck - b.ck) * (a.ck - b.ck))) AS m
       FROM cdim a JOIN cdim b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY a.cluster, b.cluster),
rt AS (SELECT ka, max(coalesce((sa.s + sb.s) / nullif(m, 0), 0.0)) AS mx
       FROM cd JOIN sk sa ON sa.cluster = cd.ka JOIN sk sb ON sb.cluster = cd.kb GROUP BY ka),
db AS (SELECT avg(mx) AS db FROM rt)
SELECT k AS n_clusters_found, {S.rnd('s')} AS silhouette_sq,
       {S.rnd('coalesce(bb * (n - k) / nullif(ww * (k - 1), 0), 0.0)')} AS calinski_harabasz,
       {S.rnd('db')} AS davies_bouldin
FROM kk, sil, bt, wt, db""")
def q_cluster_metrics(spark, sf):
    """V-10 ... V-12 on embeddings with the given label as the clustering."""
    from ..operators.evaluate import cluster_metrics
    return cluster_metrics(table(spark, sf, "embeddings"), "embedding", "vec_id", "label")


@register("silhouette", """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x)) AS d, count(*) AS n
      FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
p AS (SELECT vec_id, max(CASE WHEN own = other THEN d / n END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette, count(*) AS n FROM p""")
def q_silhouette(spark, sf):
    """V-10: Euclidean silhouette of the embeddings' labels (sampled beyond 5000 points, as in the reference)."""
    from ..operators.evaluate import silhouette
    return silhouette(table(spark, sf, "embeddings"), "embedding", "vec_id", "label")


@register("cluster_sizes", "SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY label")
def q_cluster_sizes(spark, sf):
    """V-13."""
    from ..operators.evaluate import cluster_sizes
    return cluster_sizes(table(spark, sf, "embeddings"), "label")


@register("cluster_centers", f"SELECT cluster, dim, {S.rnd('avg(x)', 6)} AS center FROM ({EMB_LONG_SQL}) GROUP BY cluster, dim")
def q_cluster_centers(spark, sf):
    """V-14 (centers given the labels)."""
    from ..operators.evaluate import cluster_centers
    return cluster_centers(table(spark, sf, "embeddings"), "embedding", "vec_id", "label")


@register("fit_eval_regression")
def q_fit_eval_regression(spark, sf):
    """M-1/M-2 + V-1, V-5: linear and ridge regression of orders.o_totalprice, 5-fold CV."""
    from ..operators.models import fit_eval
    from ..operators.prep import prepare
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus",
                                          "o_totalprice")
    prep = prepare(o, "o_totalprice", "regression", ["o_orderkey"])
    out = None
    for key in ("linear_regression", "ridge"):
        m = fit_eval(prep, key)["metrics"]
        out = m if out is None else out.unionByName(m)
    return out


@register("fit_eval_classification")
def q_fit_eval_classification(spark, sf):
    """M-7/M-12 + V-2 ... V-5: logistic regression and a decision tree for labels.quality."""
    from ..operators.models import fit_eval
    from ..operators.prep import prepare
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    df = table(spark, sf, "labels").join(d, "doc_id").select("doc_id", "lang", "source", "n_chars", "toxic", "quality")
    prep = prepare(df, "quality", "classification", ["doc_id"])
    out = None
    for key in ("logistic_regression", "decision_tree"):
        m = fit_eval(prep, key)["metrics"]
        out = m if out is None else out.unionByName(m)
    return out


@register("kmeans_clusters")
def q_kmeans_clusters(spark, sf):
    """M-13 + V-10 ... V-13: k-means (k=3) on standardized embeddings, then its metrics."""
    from pyspark.ml.functions import array_to_vector
    from ..operators.evaluate import cluster_metrics
    from ..operators.models import kmeans
    e = table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    labels, _ = kmeans(e, "v", "vec_id", k=3)
    return cluster_metrics(materialize(labels), "_s", "vec_id", "cluster")


@register("pca_2d")
def q_pca_2d(spark, sf):
    """V-15: 2-D PCA of standardized embeddings (sign-fixed)."""
    from ..operators.evaluate import pca_2d
    return pca_2d(table(spark, sf, "embeddings"), "embedding", "vec_id")


# ---------------------------------------------------------------------------
# TS: time series

def _ev_daily(spark, sf):
    from ..operators.forecast import period_series
    return period_series(table(spark, sf, "events"), "ts", "value", ["event_type"], "day")


def _orders_monthly(spark, sf, keys=()):
    from ..operators.forecast import period_series
    return period_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", list(keys), "month")


@register("lag_matrix", f"""
WITH s AS (SELECT CAST(event_type AS VARCHAR) AS series_key, date_trunc('day', ts) AS t, CAST(sum(value) AS DOUBLE) AS value
           FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_key ORDER BY t) - 1 AS INTEGER) AS idx,
             CAST(count(*) OVER (PARTITION BY series_key) AS INTEGER) AS n FROM s),
l AS (SELECT *, {', '.join(f'lag(value, {k}) OVER (PARTITION BY series_key ORDER BY idx) AS lag_{k}' for k in range(1, 6))}
      FROM i WHERE n >= 10)
SELECT series_key, strftime(t, '%Y-%m-%d') AS period, idx, n, {S.rnd('value')} AS value,
       {', '.join(S.rnd(f'lag_{k}') + f' AS lag_{k}' for k in range(1, 6))}, {S.rnd('value - lag_1')} AS diff_1
FROM l""")
def q_lag_matrix(spark, sf):
    """TS-1, TS-2, TS-4, TS-8: daily event value per event_type, 5 lags and the first difference."""
    from ..functions.exprs import rnd
    from ..operators.forecast import lag_matrix
    lm = lag_matrix(_ev_daily(spark, sf))
    return lm.select("series_key", F.date_format("t", "yyyy-MM-dd").alias("period"), "idx", "n",
                     rnd(F.col("value")).alias("value"), *[rnd(F.col(f"lag_{k}")).alias(f"lag_{k}") for k in range(1, 6)],
                     rnd(F.col("diff_1")).alias("diff_1"))


@register("ts_split", f"""
WITH s AS (SELECT o_orderpriority AS series_key, date_trunc('month', o_orderdate) AS t,
                  CAST(sum(o_totalprice) AS DOUBLE) AS value
           FROM orders WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) GROUP BY ALL),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_key ORDER BY t) - 1 AS INTEGER) AS idx,
             CAST(count(*) OVER (PARTITION BY series_key) AS INTEGER) AS n FROM s)
SELECT series_key, strftime(t, '%Y-%m') AS period, idx, n, CAST(floor(n * 0.8) AS INTEGER) AS train_size,
       CASE WHEN idx < floor(n * 0.8) THEN 'train' ELSE 'test' END AS segment, {S.rnd('value')} AS value
FROM i WHERE n >= 10""")
def q_ts_split(spark, sf):
    """TS-2/TS-3: monthly order value per priority, chronological 80/20 split."""
    from ..functions.exprs import rnd
    from ..operators.forecast import split_segments
    s = split_segments(_orders_monthly(spark, sf, ["o_orderpriority"]))
    return s.select("series_key", F.date_format("t", "yyyy-MM").alias("period"), "idx", "n", "train_size", "segment",
                    rnd(F.col("value")).alias("value"))


def _monthly_training_sql(test: str = "") -> str:
    """CTEs ending in ``tr``: each priority's training values x and test values y in time order."""
    return """s AS (SELECT o_orderpriority AS series_key, date_trunc('month', o_orderdate) AS t, CAST(sum(o_totalprice) AS DOUBLE) AS value
      FROM orders WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY series_key) AS n FROM s),
tr AS (SELECT series_key, list(value ORDER BY idx) FILTER (idx < floor(n * 0.8)) AS x, list(value ORDER BY idx) FILTER (idx >= floor(n * 0.8)) AS y
       FROM i WHERE n >= 10 GROUP BY series_key)"""


#: The grid search as a recursion over periods; ``fit``: the best end state of each series; ``e``: step, actual, forecast.
HW_SQL = f"""WITH RECURSIVE {_monthly_training_sql()},
grid AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS v),
start AS (SELECT tr.*, len(x) >= 24 AS seasonal, list_sum(x[1:12]) / 12 AS m1, list_sum(x[13:24]) / 12 AS m2 FROM tr),
hw AS (
  SELECT series_key, a.v AS a, b.v AS b, g.v AS g, 0 AS t, CASE WHEN seasonal THEN m1 ELSE x[1] END AS level,
         CASE WHEN seasonal THEN (m2 - m1) / 12 ELSE x[2] - x[1] END AS trend,
         CASE WHEN seasonal THEN list_transform(x[1:12], lambda q: q - m1) ELSE list_transform(range(12), lambda q: 0.0::DOUBLE) END AS season,
         0.0::DOUBLE AS sse
  FROM start, grid a, grid b, (SELECT v FROM grid UNION ALL SELECT 0.0) g WHERE (g.v > 0) = seasonal
  UNION ALL
  SELECT series_key, a, b, g, t + 1, nl, b * (nl - level) + (1 - b) * trend,
         list_append(season[2:12], g * (q - nl) + (1 - g) * season[1]), sse + (q - (level + trend) - season[1]) * (q - (level + trend) - season[1])
  FROM (SELECT hw.*, tr.x[t + 1] AS q, a * (tr.x[t + 1] - season[1]) + (1 - a) * (level + trend) AS nl
        FROM hw JOIN tr USING (series_key) WHERE t < len(tr.x))),
fit AS (SELECT h.*, row_number() OVER (PARTITION BY series_key ORDER BY sse, a, b, g) AS r FROM hw h JOIN tr USING (series_key) WHERE t = len(x)),
e AS (SELECT series_key, len(x) + h - 1 AS step, y[h] AS actual, level + h * trend + season[((h - 1) % 12 + 1)::INT] AS forecast
      FROM fit JOIN tr USING (series_key), unnest(range(1, len(y) + 1)) AS u(h) WHERE r = 1)"""


def _arima_fold_sql(phi: str, theta: str) -> str:
    zero = ", ".join(f"'{c}': 0.0::DOUBLE" for c in ("e", "p", "q", "sse", "pp", "pq", "qq", "pe", "qe"))
    e, p, q = f"(r.w - {phi} * f.w - {theta} * f.e)", f"(-f.w - {theta} * f.p)", f"(-f.e - {theta} * f.q)"
    return f"""list_reduce(list_transform(w, lambda v: {{'w': v, {zero}}}), lambda f, r: {{'w': r.w, 'e': {e}, 'p': {p}, 'q': {q},
      'sse': f.sse + {e} * {e}, 'pp': f.pp + {p} * {p}, 'pq': f.pq + {p} * {q}, 'qq': f.qq + {q} * {q}, 'pe': f.pe + {p} * {e}, 'qe': f.qe + {q} * {e}}})"""


#: Gauss-Newton steps as a recursion, each fold a list_reduce.
ARIMA_SQL = f"""WITH RECURSIVE {_monthly_training_sql()},
d AS (SELECT *, list_transform(range(2, len(x) + 1), lambda k: x[k] - x[k - 1]) AS w FROM tr),
it AS (
  SELECT series_key, w, 0 AS k, 0.1::DOUBLE AS phi, 0.1::DOUBLE AS theta FROM d
  UNION ALL
  SELECT series_key, w, k + 1, best.phi, best.theta FROM (
    SELECT series_key, w, k, list_min(list_transform(moved, lambda c: {{'sse': {_arima_fold_sql('c.phi', 'c.theta')}.sse, 'j': c.j, 'phi': c.phi,
                                                                     'theta': c.theta}})) AS best FROM (
      SELECT series_key, w, k, list_transform([{{'j': 0, 'v': 1.0}}, {{'j': 1, 'v': 0.5}}, {{'j': 2, 'v': 0.25}}, {{'j': 3, 'v': 0.0625}}, {{'j': 4, 'v': 0.0}}],
               lambda c: {{'j': c.j, 'phi': greatest(-0.99, least(0.99, phi + c.v::DOUBLE * d1)), 'theta': greatest(-0.99, least(0.99, theta + c.v::DOUBLE * d2))}})
               AS moved FROM (
        SELECT *, CASE WHEN det > 0 THEN (f.pq * f.qe - qq * f.pe) / det ELSE 0.0 END AS d1,
               CASE WHEN det > 0 THEN (f.pq * f.pe - pp * f.qe) / det ELSE 0.0 END AS d2 FROM (
          SELECT *, pp * qq - f.pq * f.pq AS det FROM (
            SELECT *, f.pp * 1.001::DOUBLE AS pp, f.qq * 1.001::DOUBLE AS qq FROM (
              SELECT *, {_arima_fold_sql('phi', 'theta')} AS f FROM it WHERE k < 12))))))),
fit AS (SELECT series_key, phi, f, len(w) - 1 AS size, phi * f.w + theta * f.e AS ahead FROM (
          SELECT *, {_arima_fold_sql('phi', 'theta')} AS f FROM it WHERE k = 12)),
e AS (SELECT series_key, len(x) + h - 1 AS step, y[h] AS actual, x[len(x)] + list_sum(list_transform(range(0, h), lambda j: ahead * pow(phi, j))) AS forecast,
             size * ln(2 * pi() * greatest(f.sse / size, 1e-300)) + size + 6 AS aic
      FROM fit JOIN tr USING (series_key), unnest(range(1, len(y) + 1)) AS u(h))"""


def _forecast_metrics_sql(cte: str, aic: str) -> str:
    return f"""{cte}
SELECT series_key, count(*) AS n_test, {S.rnd('sqrt(sum((actual - forecast) * (actual - forecast)) / count(*))')} AS rmse,
       {S.rnd('avg(abs(actual - forecast))')} AS mae, {aic} AS aic, 'ok' AS status FROM e GROUP BY series_key"""


@register("forecast_hw", _forecast_metrics_sql(HW_SQL, "NULL::DOUBLE"))
def q_forecast_hw(spark, sf):
    """M-17 + TS-6/TS-7: additive Holt-Winters (m=12, grid-searched) per priority series."""
    from ..operators.forecast import forecast, forecast_metrics
    return forecast_metrics(forecast(_orders_monthly(spark, sf, ["o_orderpriority"]), "exponential_smoothing"))


@register("forecast_arima", _forecast_metrics_sql(ARIMA_SQL, S.rnd("max(aic)")))
def q_forecast_arima(spark, sf):
    """M-16 + TS-7: ARIMA(1,1,1) by conditional least squares per priority series, with AIC."""
    from ..operators.forecast import forecast, forecast_metrics
    return forecast_metrics(forecast(_orders_monthly(spark, sf, ["o_orderpriority"]), "arima"))


@register("forecast_status", f"""
WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS series_key, date_trunc('month', o_orderdate) AS t FROM orders
           WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) GROUP BY ALL),
n AS (SELECT series_key, count(*) AS n FROM s GROUP BY series_key)
SELECT series_key, CASE WHEN n >= 10 THEN 'ok' ELSE 'Time series requires at least 10 data points.' END AS status,
       CASE WHEN n >= 10 THEN n ELSE 1 END AS steps, CASE WHEN n >= 10 THEN n - floor(n * 0.8) ELSE 0 END::BIGINT AS n_test
FROM n""")
def q_forecast_status(spark, sf):
    """TS-2: every customer's monthly series, forecast or with the reason why not."""
    from ..operators.forecast import forecast
    fc = forecast(_orders_monthly(spark, sf, ["o_custkey"]), "exponential_smoothing")
    return fc.groupBy("series_key").agg(F.max("status").alias("status"), F.count(F.lit(1)).alias("steps"),
                                        F.count(F.when(F.col("segment") == "test", 1)).alias("n_test"))


_TS_MODELS = [("arima", "ARIMA", 0, ARIMA_SQL, S.rnd("max(aic)")),
              ("exponential_smoothing", "Exponential Smoothing (Holt-Winters)", 1, HW_SQL, "NULL::DOUBLE")]


@register("leaderboard_time_series", "WITH m AS (" + " UNION ALL ".join(
    f"SELECT series_key AS run_id, '{k}' AS model_key, '{n}' AS model_name, {p} AS pos, rmse FROM ({_forecast_metrics_sql(c, aic)})"
    for k, n, p, c, aic in _TS_MODELS) + """),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rmse, pos) AS rank FROM m)
SELECT run_id, rank, model_key, model_name, 'rmse' AS primary_metric, rmse AS primary_value,
       CASE rank WHEN 1 THEN '🥇 CHAMPION' ELSE '🥈 RUNNER-UP' END AS badge FROM r""")
def q_leaderboard_time_series(spark, sf):
    """R-1...R-4 for time series: ARIMA and Holt-Winters ranked by RMSE for each priority's series."""
    from ..operators.arena import arena_time_series, leaderboard
    metrics, _ = arena_time_series(_orders_monthly(spark, sf, ["o_orderpriority"]), keys=["arima", "exponential_smoothing"])
    return leaderboard(metrics, "time_series")


@register("arena_time_series")
def q_arena_time_series(spark, sf):
    """R-1...R-4 for time series with all its models: the board with every metric."""
    from ..operators.arena import arena_time_series, leaderboard
    metrics, _ = arena_time_series(_orders_monthly(spark, sf, ["o_orderpriority"]))
    return leaderboard(metrics, "time_series", detail=True)


@register("forecast_rf")
def q_forecast_rf(spark, sf):
    """M-18 + TS-5/TS-7: 5-lag random forest, one-step forecasts, per-series metrics with R^2."""
    from ..operators.forecast import forecast_metrics, forecast_rf
    return forecast_metrics(forecast_rf(_orders_monthly(spark, sf, ["o_orderpriority"])), with_r2=True)


# ---------------------------------------------------------------------------
# R / H / L: arena, chart data, explanation

ARENA_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _ols_arena_sql() -> str:
    feats = ARENA_FEATURES
    un = S.union_all([f"SELECT '{f}' AS feature, {i} AS run_pos, CAST({f} AS DOUBLE) AS x, y, is_test, fold FROM s"
                      for i, f in enumerate(feats)])
    return f"""
WITH s0 AS ({_li_split_sql()}),
s AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, is_test, (floor({S.split_hash('k')} / 100) % 5) AS fold, * FROM s0),
l AS ({un}),
tr AS (SELECT * FROM l WHERE NOT is_test), te AS (SELECT * FROM l WHERE is_test),
sm AS (SELECT feature, fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy
       FROM tr GROUP BY feature, fold),
tt AS (SELECT feature, sum(n) AS tn, sum(sx) AS tsx, sum(sy) AS tsy, sum(sxx) AS tsxx, sum(sxy) AS tsxy FROM sm GROUP BY feature),
ft AS (SELECT feature, (tn * tsxy - tsx * tsy) / nullif(tn * tsxx - tsx * tsx, 0) AS b, tn, tsx, tsy FROM tt),
ft2 AS (SELECT feature, b, (tsy - b * tsx) / tn AS a FROM ft),
tm AS (SELECT te.feature, 1.0 - sum(pow(y - (a + b * x), 2)) / nullif(var_pop(y) * count(*), 0) AS r2,
              sqrt(sum(pow(y - (a + b * x), 2)) / count(*)) AS rmse, sum(abs(y - (a + b * x))) / count(*) AS mae
       FROM te JOIN ft2 USING (feature) GROUP BY te.feature),
cf AS (SELECT sm.feature, sm.fold,
              ((tn - n) * (tsxy - sxy) - (tsx - sx) * (tsy - sy)) / nullif((tn - n) * (tsxx - sxx) - (tsx - sx) * (tsx - sx), 0) AS b,
              tn - n AS nn, tsx - sx AS ssx, tsy - sy AS ssy FROM sm JOIN tt USING (feature)),
cf2 AS (SELECT feature, fold, b, (ssy - b * ssx) / nn AS a FROM cf),
cvk AS (SELECT tr.feature, tr.fold, 1.0 - sum(pow(y - (a + b * x), 2)) / nullif(var_pop(y) * count(*), 0) AS r2k
        FROM tr JOIN cf2 USING (feature, fold) GROUP BY tr.feature, tr.fold),
cv AS (SELECT feature, avg(r2k) AS cv_r2_mean, stddev_pop(r2k) AS cv_r2_std FROM cvk GROUP BY feature),
w AS (SELECT * FROM tm JOIN cv USING (feature)),
pos AS (SELECT DISTINCT feature, run_pos FROM l)
SELECT 1 AS run_id, 'ols_' || w.feature AS model_key, 'OLS on ' || w.feature AS model_name, pos.run_pos, u.metric,
       {S.rnd('u.value')} AS value
FROM w JOIN pos USING (feature),
     LATERAL (VALUES ('r2', w.r2), ('rmse', w.rmse), ('mae', w.mae), ('cv_r2_mean', w.cv_r2_mean),
                     ('cv_r2_std', w.cv_r2_std)) u(metric, value)"""


def _ols_arena(spark, sf):
    from ..operators.models import ols_arena_metrics
    li = table(spark, sf, "lineitem")
    return materialize(ols_arena_metrics(li, "l_extendedprice", ARENA_FEATURES, LI_KEYS))


@register("arena_metrics", _ols_arena_sql())
def q_arena_metrics(spark, sf):
    """R-2 over SQL-expressible candidates: one least-squares model per lineitem feature,
    test metrics and 5-fold CV, all from grouped sums."""
    return _ols_arena(spark, sf)


@register("leaderboard", f"""
WITH m AS ({_ols_arena_sql()}),
p AS (SELECT run_id, model_key, model_name, run_pos,
             {S.rnd("coalesce(max(CASE WHEN metric = 'r2' THEN value END), 0.0)")} AS primary_value
      FROM m GROUP BY run_id, model_key, model_name, run_pos),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY primary_value DESC, run_pos) AS rank FROM p)
SELECT run_id, rank, model_key, model_name, 'r2' AS primary_metric, primary_value,
       CASE rank WHEN 1 THEN '🥇 CHAMPION' WHEN 2 THEN '🥈 RUNNER-UP' WHEN 3 THEN '🥉 BRONZE' ELSE '' END AS badge
FROM r""")
def q_leaderboard(spark, sf):
    """R-3/R-4 on the regression arena."""
    from ..operators.arena import leaderboard
    return leaderboard(_ols_arena(spark, sf), "regression")


@register("radar", f"""
WITH m AS ({_ols_arena_sql()}),
w AS (SELECT run_id, model_key, model_name, run_pos, max(CASE WHEN metric = 'r2' THEN value END) AS r2,
             max(CASE WHEN metric = 'cv_r2_mean' THEN value END) AS cv_r2_mean,
             max(CASE WHEN metric = 'cv_r2_std' THEN value END) AS cv_r2_std
      FROM m GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY run_pos) AS o FROM w),
v AS (SELECT run_id, model_key, model_name, run_pos,
             round(CASE WHEN coalesce(r2, 0.0) <= 1.0 THEN coalesce(r2, 0.0) * 100.0 ELSE r2 END, 1) AS a0,
             round(CASE WHEN coalesce(cv_r2_mean, 0.0) <= 1.0 THEN coalesce(cv_r2_mean, 0.0) * 100.0 ELSE cv_r2_mean END, 1) AS a1,
             round(least(greatest(1.0 - coalesce(cv_r2_std, 0.0), 0.0), 1.0) * 100.0, 1) AS a2
      FROM f WHERE o <= 5)
SELECT run_id, model_key, model_name, run_pos, u.axis_pos, u.axis_label, u.value + 0.0 AS value
FROM v, LATERAL (VALUES (0, 'R²', a0), (1, 'CV R²', a1), (2, 'Consistency', a2)) u(axis_pos, axis_label, value)""")
def q_radar(spark, sf):
    """R-6 on the regression arena."""
    from ..operators.arena import radar
    r = radar(_ols_arena(spark, sf), "regression")
    return r.withColumn("value", F.col("value") + F.lit(0.0))


@register("explain_rules", f"""
WITH m AS ({_ols_arena_sql()}),
w AS (SELECT model_key, model_name, max(CASE WHEN metric = 'r2' THEN value END) AS r2 FROM m GROUP BY ALL)
SELECT model_key, model_name, r2, 'Completed regression using ' || model_name || '.' AS summary,
       'R² = ' || (CASE WHEN ends_with(rtrim(printf('%.4f', r2), '0'), '.') THEN rtrim(printf('%.4f', r2), '0') || '0'
                        ELSE rtrim(printf('%.4f', r2), '0') END) || '. ' || CASE WHEN r2 > 0.9 THEN 'Excellent fit.' WHEN r2 > 0.7 THEN 'Good fit.'
           ELSE 'Moderate fit — consider feature engineering.' END AS performance_analysis,
       'Check feature importance chart for top predictors.' AS key_drivers,
       'Consider cross-validation and hyperparameter tuning for better results.' AS recommendations,
       'Always validate results on unseen data before production deployment.' AS cautions
FROM w""")
def q_explain_rules(spark, sf):
    """L-1 over every arena model's metrics."""
    from ..operators.chartdata import explain
    m = _ols_arena(spark, sf)
    wide = m.groupBy("model_key", "model_name").agg(F.max(F.when(F.col("metric") == "r2", F.col("value"))).alias("r2"))
    return explain(wide, "regression")


@register("prediction_sample", f"""
WITH s AS ({_li_split_sql()}),
f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
      FROM s WHERE NOT is_test),
p AS (SELECT k, {S.split_hash('k')} AS h, l_extendedprice AS actual, a + b * l_quantity AS predicted FROM s, f WHERE is_test),
t AS (SELECT * FROM p ORDER BY h, k LIMIT 50)
SELECT k AS _key, {S.rnd('actual')} AS actual, {S.rnd('predicted')} AS predicted, {S.rnd('actual - predicted')} AS residual,
       {S.rnd('least(min(actual) OVER (), min(predicted) OVER ())')} AS diag_min,
       {S.rnd('greatest(max(actual) OVER (), max(predicted) OVER ())')} AS diag_max
FROM t""")
def q_prediction_sample(spark, sf):
    """V-8 + H-1/H-2: first 50 test predictions (split order) of the least-squares fit,
    residuals and the diagonal range. The 50-row limit is the operator itself."""
    from pyspark.ml.regression import LinearRegression
    from ..functions.exprs import rnd, split_hash
    from ..operators.evaluate import prediction_sample
    from ..operators.prep import assemble, hash_split
    li = materialize(hash_split(table(spark, sf, "lineitem").select(
        *LI_KEYS, "l_quantity", F.col("l_extendedprice").alias("label")), LI_KEYS)
        .withColumn("_key", F.concat_ws("|", *LI_KEYS)))
    model = LinearRegression(regParam=0.0, solver="normal").fit(assemble(li.where(~F.col("is_test")), ["l_quantity"]))
    test = li.where(F.col("is_test")).withColumn("_h", split_hash(F.col("_key")))
    s2 = prediction_sample(model.transform(assemble(test, ["l_quantity"])), "_key", ["_h", "_key"])
    out = s2.crossJoin(F.broadcast(s2.agg(F.least(F.min("label"), F.min("prediction")).alias("_lo"),
                                          F.greatest(F.max("label"), F.max("prediction")).alias("_hi"))))
    return out.select("_key", rnd(F.col("label")).alias("actual"), rnd(F.col("prediction")).alias("predicted"),
                      rnd(F.col("label") - F.col("prediction")).alias("residual"),
                      rnd(F.col("_lo")).alias("diag_min"), rnd(F.col("_hi")).alias("diag_max"))


@register("drift_bars", f"""
SELECT feature, ks_statistic, psi, drift_detected, 0.05 AS ks_warning, 0.1 AS psi_warning
FROM ({S.drift_sql(EV_REF_SQL, EV_CUR_SQL, DRIFT_EVENT_COLS)})""".replace("0.05 AS ks_warning", "CAST(0.05 AS DOUBLE) AS ks_warning").replace("0.1 AS psi_warning", "CAST(0.1 AS DOUBLE) AS psi_warning"))
def q_drift_bars(spark, sf):
    """H-12: KS / PSI bars with warning lines."""
    from ..operators.chartdata import drift_bars
    from ..operators.drift import drift
    ref, cur = _event_halves(spark, sf)
    return drift_bars(drift(ref, cur, DRIFT_EVENT_COLS))


@register("target_distribution", _hist_sql("orders", ["o_totalprice"], 30).replace("HAVING count(*) >= 5", "HAVING count(*) >= 1"))
def q_target_distribution(spark, sf):
    """H-9 (regression target): 30 equal-width bins of orders.o_totalprice."""
    from ..operators.chartdata import target_distribution
    return target_distribution(table(spark, sf, "orders"), "o_totalprice", "regression")


@register("forecast_frame", f"""{HW_SQL}
SELECT series_key, (u.k - 1)::INTEGER AS step, 'train' AS segment, x[u.k] AS value FROM tr, unnest(range(1, len(x) + 1)) AS u(k)
UNION ALL SELECT series_key, step::INTEGER, 'actual', actual FROM e
UNION ALL SELECT series_key, step::INTEGER, 'forecast', {S.rnd('forecast')} FROM e""".replace("x[u.k] AS value", S.rnd("x[u.k]") + " AS value").replace(
    "'actual', actual FROM", "'actual', " + S.rnd("actual") + " FROM"))
def q_forecast_frame(spark, sf):
    """H-8: train / actual / forecast rows of the Holt-Winters forecast per priority."""
    from ..operators.chartdata import forecast_frame
    from ..operators.forecast import forecast
    from ..functions.exprs import rnd
    out = forecast_frame(forecast(_orders_monthly(spark, sf, ["o_orderpriority"]), "exponential_smoothing"))
    return out.withColumn("value", rnd(F.col("value")))


# ---------------------------------------------------------------------------
# D-13: streaming drift

@register("drift_stream", S.window_drift_sql(EV_REF_SQL, "SELECT * FROM events", "ts", ["value", "user_id"]))
def q_drift_stream(spark, sf):
    """D-13: events replayed as a file stream; daily PSI / JS distance per feature against the
    first half of the month as reference; every window that has events, the last one included."""
    from ..streaming.drift_stream import drift_stream
    ref, _ = _event_halves(spark, sf)
    path = f"{sf.rstrip('/')}/event[s].parquet"
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(path)
    monitor = drift_stream(stream, ref, "ts", ["value", "user_id"], window="1 day", delay="1 hour")
    monitor.query.awaitTermination()
    return monitor.result().withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


# ---------------------------------------------------------------------------
# branches that no table reaches as it is: data derived from the tables

#: A summary for each nation and task whose figures run through all sides of the scoring rules.
_NATION_SUMMARIES = """SELECT CAST(c_nationkey AS INTEGER) AS dataset_id,
    CASE c_nationkey % 4 WHEN 0 THEN 'regression' WHEN 1 THEN 'classification' WHEN 2 THEN 'clustering' ELSE 'time_series' END AS task_type,
    CAST(count(*) * CASE c_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 10000 END AS BIGINT) AS n_rows,
    CAST(c_nationkey * 4 AS DOUBLE) AS quality_score, CAST(c_nationkey % 5 AS BIGINT) AS n_outlier_cols,
    CAST(c_nationkey % 7 AS BIGINT) AS numeric_count, CAST(c_nationkey % 6 AS BIGINT) AS cat_count
FROM customer GROUP BY c_nationkey"""


@register("recommend_detail", _recommend_sql(_NATION_SUMMARIES, ", pros, cons, use_when, spark_impl"))
def q_recommend_detail(spark, sf):
    """C-1 ... C-8 with the registry's texts over one summary a nation: small, poor, outlying and categorical datasets."""
    from ..operators.recommend import recommend, registry
    return recommend(spark.sql(_NATION_SUMMARIES.replace("FROM customer", "FROM {c}"), c=table(spark, sf, "customer")), registry(spark), detail=True)


_GAPS_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(o_custkey AS DOUBLE) END AS cust,
    CAST(NULL AS DOUBLE) AS nothing FROM orders"""


def _orders_with_gaps(spark, sf):
    return spark.sql(_GAPS_SQL.replace("FROM orders", "FROM {o}"), o=table(spark, sf, "orders"))


@register("impute_medians", f"""
WITH g AS (SELECT o_orderkey, price, CASE WHEN isnan(cust) THEN NULL ELSE cust END AS cust FROM ({_GAPS_SQL})),
m AS (SELECT quantile_cont(price, 0.5) AS mp, quantile_cont(cust, 0.5) AS mc FROM g)
SELECT o_orderkey, {S.rnd('coalesce(price, mp)')} AS price, {S.rnd('coalesce(cust, mc)')} AS cust, 0.0::DOUBLE AS nothing FROM g, m""")
def q_impute_medians(spark, sf):
    """X-4: exact medians for nulls and NaN; a column without values becomes 0."""
    from ..functions.exprs import rnd
    from ..operators.prep import impute_median
    out = impute_median(_orders_with_gaps(spark, sf), ["price", "cust", "nothing"])
    return out.select("o_orderkey", rnd(F.col("price")).alias("price"), rnd(F.col("cust")).alias("cust"), "nothing")


@register("null_targets", f"""
WITH g AS (SELECT * FROM ({_GAPS_SQL}) WHERE price IS NOT NULL),
s AS (SELECT price, row_number() OVER (ORDER BY {S.split_hash('o_orderkey')}, CAST(o_orderkey AS VARCHAR)) <= ceil(count(*) OVER () * 0.2) AS is_test FROM g)
SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS part, count(*) AS n, {S.rnd('sum(price)', 2)} AS label_sum FROM s GROUP BY 1""")
def q_null_targets(spark, sf):
    """X-6: rows without a target leave before the split; sizes and labels of both parts."""
    from ..functions.exprs import rnd
    from ..operators.prep import prepare
    parts = prepare(_orders_with_gaps(spark, sf).select("o_orderkey", "price", "cust"), "price", "regression", ["o_orderkey"])
    both = parts["train"].withColumn("part", F.lit("train")).unionByName(parts["test"].withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("label"), 2).alias("label_sum"))


@register("task_second_opinion", f"""
WITH h AS ({_task_sql()}),
o AS (SELECT CAST(r_regionkey AS INTEGER) AS dataset_id, 0.5 + 0.1 * r_regionkey AS c, r_name FROM region)
SELECT h.dataset_id, target_column, CASE WHEN c > 0.7 THEN 'clustering' ELSE task_type END AS task_type,
       CASE WHEN c > 0.7 THEN c ELSE confidence END::DOUBLE AS confidence, CASE WHEN c > 0.7 THEN r_name ELSE reasoning END AS reasoning,
       CASE WHEN c > 0.7 THEN 'second_opinion' ELSE 'heuristic' END AS source
FROM h LEFT JOIN o ON o.dataset_id = h.dataset_id""".replace("0.5 + 0.1 * r_regionkey", "CAST(r_regionkey AS DOUBLE) / 4"))
def q_task_second_opinion(spark, sf):
    """T-5: a second opinion replaces the heuristic where its confidence is above 0.7."""
    from ..operators.task import detect_task
    targets = spark.createDataFrame([(i, tc) for i, _, tc in TASK_CASES], "dataset_id int, target_column string")
    second = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("dataset_id"), F.lit("clustering").alias("task_type"),
                                               (F.col("r_regionkey").cast("double") / 4).alias("confidence"), F.col("r_name").alias("reasoning"))
    return detect_task(_profiles_with_ids(spark, sf, TASK_CASES), targets, second)


_BOARD_SQL = f"""SELECT run_id, model_key, row_number() OVER (PARTITION BY run_id ORDER BY v DESC, run_pos) AS rank FROM (
    SELECT run_id, model_key, run_pos, {S.rnd("coalesce(max(CASE WHEN metric = 'r2' THEN value END), 0.0)")} AS v
    FROM ({_ols_arena_sql()}) GROUP BY run_id, model_key, model_name, run_pos)"""


@register("arena_summary", f"""
WITH b AS ({_BOARD_SQL}), e AS (SELECT run_id, count(*) AS failed FROM b WHERE rank > 2 GROUP BY run_id),
ok AS (SELECT run_id, count(*) AS successful, max(CASE WHEN rank = 1 THEN model_key END) AS winner FROM b WHERE rank <= 2 GROUP BY run_id)
SELECT run_id, winner, successful, coalesce(failed, 0)::BIGINT AS failed, (successful + coalesce(failed, 0))::BIGINT AS total_models
FROM ok LEFT JOIN e USING (run_id)""")
def q_arena_summary(spark, sf):
    """R-5: winner and counts; the models behind the second place stand for failed ones."""
    from ..operators.arena import arena_summary, leaderboard
    board = materialize(leaderboard(_ols_arena(spark, sf), "regression"))
    return arena_summary(board.where("rank <= 2"), board.where("rank > 2"))


@register("pca_2d_customer", f"""
WITH s AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS x,
                  (c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER () AS y FROM customer),
r AS (SELECT CASE WHEN corr(x, y) >= 0 THEN 1 ELSE -1 END AS g FROM s)
SELECT c_custkey, {S.rnd('abs((x + g * y) / sqrt(2))')} AS pc1, {S.rnd('abs((x - g * y) / sqrt(2))')} AS pc2 FROM s, r""")
def q_pca_2d_customer(spark, sf):
    """V-15 in closed form: of two standardized features the axes are the diagonals (compared without their signs)."""
    from ..functions.exprs import rnd
    from ..operators.evaluate import pca_2d
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("a"), F.col("c_nationkey").cast("double").alias("n"))
    out = pca_2d(c, ["a", "n"], "c_custkey")
    return out.select("c_custkey", rnd(F.abs("pc1")).alias("pc1"), rnd(F.abs("pc2")).alias("pc2"))


@register("ridge_supplier", f"""
WITH s AS (SELECT s_acctbal AS y, (s_nationkey - avg(s_nationkey) OVER ()) / stddev_pop(s_nationkey) OVER () AS x FROM supplier),
f AS (SELECT regr_sxy(y, x) / (regr_sxx(y, x) + 1) AS b, avg(y) AS a FROM s),
m AS (SELECT count(*) AS n, sum((y - a - b * x) * (y - a - b * x)) AS sse, sum(abs(y - a - b * x)) AS sae, var_pop(y) AS vy FROM s, f)
SELECT {S.rnd('b')} AS slope, {S.rnd('a')} AS intercept, {S.rnd('1 - sse / (vy * n)')} AS r2, {S.rnd('sqrt(sse / n)')} AS rmse, {S.rnd('sae / n')} AS mae
FROM m, f""")
def q_ridge_supplier(spark, sf):
    """M-2 + V-1: ridge with alpha 1 on one standardized feature, against its normal equation."""
    from ..functions.exprs import rnd
    from ..operators.evaluate import regression_metrics
    from ..operators.models import estimator
    from ..operators.prep import assemble, standardize
    c = table(spark, sf, "supplier").select(F.col("s_acctbal").cast("double").alias("label"), F.col("s_nationkey").cast("double").alias("x"))
    data = materialize(assemble(standardize(c, ["x"]), ["x"]))
    about = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    model = estimator("ridge", "regression", about["n"], 0, about["s"]).fit(data)
    coef = spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "b double, a double")
    return coef.crossJoin(regression_metrics(model.transform(data))).select(rnd(F.col("b")).alias("slope"), rnd(F.col("a")).alias("intercept"),
                                                                            "r2", "rmse", "mae")


def _newton_sql() -> str:
    """Two stumps of Newton boosting of the balance on the nation, one after the other."""
    def stump(src: str, m: str) -> str:
        return f"""(SELECT k AS cut, -0.3 * gl / (hl + 1) AS l, -0.3 * (g - gl) / (h - hl + 1) AS r FROM (
    SELECT b.k, sum({m} - y) FILTER (x <= b.k) AS gl, count(*) FILTER (x <= b.k) AS hl, sum({m} - y) AS g, count(*) AS h
    FROM {src}, (SELECT DISTINCT x AS k FROM {src}) b GROUP BY b.k)
  WHERE hl >= 1 AND h - hl >= 1 ORDER BY gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) DESC, k LIMIT 1)"""
    return f"""WITH p AS (SELECT c_acctbal AS y, c_nationkey AS x, avg(c_acctbal) OVER () AS m0 FROM customer),
t1 AS {stump('p', 'm0')},
q AS (SELECT y, x, m0 + CASE WHEN x > cut THEN r ELSE l END AS m1 FROM p, t1),
t2 AS {stump('q', 'm1')},
e AS (SELECT y AS label, m1 + CASE WHEN x > cut THEN r ELSE l END AS prediction FROM q, t2),
m AS (SELECT count(*) AS n, sum((label - prediction) * (label - prediction)) AS sse, sum(abs(label - prediction)) AS sae, var_pop(label) AS v FROM e)
SELECT {S.rnd('1 - sse / (v * n)')} AS r2, {S.rnd('sqrt(sse / n)')} AS rmse, {S.rnd('sae / n')} AS mae FROM m"""


@register("newton_boosting", _newton_sql())
def q_newton_boosting(spark, sf):
    """M-5: second-order boosting, two trees of one split, with the regression metrics (V-1)."""
    from ..operators import boosting
    from ..operators.evaluate import regression_metrics
    c = table(spark, sf, "customer").select(F.col("c_acctbal").cast("double").alias("label"), F.array(F.col("c_nationkey").cast("double")).alias("x"))
    return regression_metrics(boosting.predict(c, boosting.fit(c, "x", "label", rounds=2, depth=1), "x"))


# ---------------------------------------------------------------------------
# M-14 / M-15 and the remaining chart frames

def _scaled_customer(spark, sf):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    v = VectorAssembler(inputCols=["c_acctbal", "c_nationkey"], outputCol="_v").transform(c)
    return StandardScaler(inputCol="_v", outputCol="v", withMean=True, withStd=True).fit(v).transform(v) \
        .select("c_custkey", "v")


@register("density_clusters", """
WITH RECURSIVE s AS (SELECT avg(c_acctbal) AS ma, stddev_samp(c_acctbal) AS sa, avg(c_nationkey) AS mn,
                            stddev_samp(c_nationkey) AS sn FROM customer),
p AS (SELECT c_custkey, floor((c_acctbal - ma) / sa / 0.5)::BIGINT AS x, floor((c_nationkey - mn) / sn / 0.5)::BIGINT AS y
      FROM customer, s),
c AS (SELECT x, y, count(*) AS n FROM p GROUP BY x, y),
d AS (SELECT x, y FROM c WHERE n >= 5),
r AS (SELECT x, y, x AS rx, y AS ry FROM d
      UNION SELECT d.x, d.y, r.rx, r.ry FROM r JOIN d ON abs(d.x - r.x) <= 1 AND abs(d.y - r.y) <= 1),
lab AS (SELECT x, y, min(rx || ',' || ry) AS lab FROM r GROUP BY x, y),
near AS (SELECT c.x, c.y, min(lab) AS lab FROM c JOIN lab ON abs(lab.x - c.x) <= 1 AND abs(lab.y - c.y) <= 1
         WHERE c.n < 5 GROUP BY c.x, c.y),
cells AS (SELECT * FROM lab UNION ALL SELECT * FROM near),
codes AS (SELECT lab, row_number() OVER (ORDER BY lab) - 1 AS code FROM (SELECT DISTINCT lab FROM lab))
SELECT coalesce(code, -1)::INTEGER AS cluster, count(*) AS size
FROM p LEFT JOIN cells USING (x, y) LEFT JOIN codes USING (lab) GROUP BY 1""")
def q_density_clusters(spark, sf):
    """M-14 re-aim: grid-density clustering (eps 0.5, min_samples 5) of standardized customer
    balance and nation; cluster sizes with noise (-1) included (V-13)."""
    from ..operators.cluster import grid_density_clusters
    from ..operators.evaluate import cluster_sizes
    return cluster_sizes(grid_density_clusters(_scaled_customer(spark, sf), "v", "c_custkey"), "cluster")


@register("dbscan_clusters", """
WITH RECURSIVE s AS (SELECT avg(c_acctbal) AS ma, stddev_samp(c_acctbal) AS sa, avg(c_nationkey) AS mn,
                            stddev_samp(c_nationkey) AS sn FROM customer),
p AS (SELECT c_custkey AS k, (c_acctbal - ma) / sa AS x, (c_nationkey - mn) / sn AS y FROM customer, s),
near AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.1 * 0.1),
core AS (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= 5),
link AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
r AS (SELECT k AS a, k AS root FROM core UNION SELECT link.b, r.root FROM r JOIN link ON link.a = r.a),
lab AS (SELECT a AS k, min(root) AS root FROM r GROUP BY a),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM lab)),
reached AS (SELECT near.a AS k, min(c) AS c FROM near JOIN lab ON lab.k = near.b JOIN num USING (root) GROUP BY near.a),
own AS (SELECT k, c FROM lab JOIN num USING (root))
SELECT p.k AS c_custkey, coalesce(own.c, reached.c, -1)::INTEGER AS cluster FROM p LEFT JOIN own USING (k) LEFT JOIN reached USING (k)""")
def q_dbscan_clusters(spark, sf):
    """M-14: exact DBSCAN (eps 0.1, min_samples 5) of standardized customer balance and nation, a label for each customer."""
    from ..operators.dbscan import dbscan
    return dbscan(_scaled_customer(spark, sf), "v", "c_custkey", eps=0.1)


@register("ward_clusters", """
WITH RECURSIVE p AS (SELECT s_suppkey AS k, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS x,
                            (s_nationkey - avg(s_nationkey) OVER ()) / stddev_samp(s_nationkey) OVER () AS y FROM supplier),
st AS (
  SELECT list({'id': k, 'n': 1.0::DOUBLE, 'x': x, 'y': y, 'm': [k]} ORDER BY k) AS c FROM p
  UNION ALL
  SELECT list_append(list_filter(c, lambda q: q.id <> best.a.id AND q.id <> best.b.id),
           {'id': best.a.id, 'n': best.a.n + best.b.n, 'x': (best.a.n * best.a.x + best.b.n * best.b.x) / (best.a.n + best.b.n),
            'y': (best.a.n * best.a.y + best.b.n * best.b.y) / (best.a.n + best.b.n), 'm': list_concat(best.a.m, best.b.m)})
  FROM (SELECT c, list_min(list_transform(flatten(list_transform(c, lambda a: list_transform(list_filter(c, lambda b: a.id < b.id), lambda b: {
           'd': a.n * b.n / (a.n + b.n) * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 'a': a, 'b': b}))), lambda o: o)) AS best
        FROM st WHERE len(c) > 5)),
f AS (SELECT unnest(c) AS q FROM st WHERE len(c) = 5),
g AS (SELECT q.m AS m, row_number() OVER (ORDER BY list_min(q.m)) - 1 AS cluster FROM f)
SELECT unnest(m) AS s_suppkey, cluster::INTEGER AS cluster FROM g""")
def q_ward_clusters(spark, sf):
    """M-15: Ward's five clusters of suppliers by standardized balance and nation, a label for each supplier."""
    from ..operators.ward import ward_clusters
    c = table(spark, sf, "supplier")
    w = c.agg(*[f(x).alias(f"{n}_{x}") for x in ("s_acctbal", "s_nationkey") for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    scaled = c.crossJoin(F.broadcast(w)).select("s_suppkey", F.array(*[(F.col(x) - F.col(f"m_{x}")) / F.col(f"s_{x}")
                                                                       for x in ("s_acctbal", "s_nationkey")]).alias("v"))
    return ward_clusters(scaled, "v", "s_suppkey", k=5)


@register("agglomerative_clusters")
def q_agglomerative_clusters(spark, sf):
    """M-15: Ward's three clusters of the embeddings, with their metrics."""
    from ..operators.ward import ward_clusters
    from ..operators.evaluate import cluster_metrics
    e = table(spark, sf, "embeddings")
    labels = materialize(ward_clusters(e, "embedding", "vec_id", k=3))
    return cluster_metrics(e.join(labels, "vec_id"), "embedding", "vec_id", "cluster")


@register("class_counts", f"""
SELECT label AS code, count(*) AS n, 'actual' AS series FROM ({CLS_PRED_SQL}) GROUP BY label
UNION ALL
SELECT prediction, count(*), 'predicted' FROM ({CLS_PRED_SQL}) GROUP BY prediction""")
def q_class_counts(spark, sf):
    """H-3: actual vs predicted class counts of the length rule."""
    from ..operators.chartdata import class_counts
    return class_counts(_cls_pred(spark, sf))


@register("radar_frame", f"""
WITH r AS (SELECT * FROM ({ORACLE['radar']})),
f AS (SELECT * FROM r WHERE run_pos IN (SELECT DISTINCT run_pos FROM r ORDER BY run_pos LIMIT 4))
SELECT * FROM f
UNION ALL
SELECT run_id, model_key, model_name, run_pos,
       (SELECT max(axis_pos) + 1 FROM f f2 WHERE f2.model_key = f.model_key) AS axis_pos, axis_label, value
FROM f WHERE axis_pos = 0""")
def q_radar_frame(spark, sf):
    """H-11: first four arena models, polygons closed."""
    from ..operators.arena import radar
    from ..operators.chartdata import radar_frame
    r = radar(_ols_arena(spark, sf), "regression").withColumn("value", F.col("value") + F.lit(0.0))
    return radar_frame(r).withColumn("axis_pos", F.col("axis_pos").cast("int"))


@register("importance_bars")
def q_importance_bars(spark, sf):
    """V-7 + H-5: random-forest importances for orders.o_totalprice, top 15 with median highlight."""
    from ..operators.chartdata import importance_bars
    from ..operators.models import estimator, feature_importance
    from ..operators.prep import assemble, prepare
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus",
                                          "o_totalprice")
    prep = prepare(o, "o_totalprice", "regression", ["o_orderkey"])
    model = estimator("random_forest_reg", "regression", 0, 0).fit(assemble(prep["train"], prep["features"]))
    return importance_bars(feature_importance(model, prep["features"], spark))


@register("cluster_scatter")
def q_cluster_scatter(spark, sf):
    """V-15 + H-6/H-7: k-means labels on the 2-D PCA of embeddings, with cluster shares."""
    from pyspark.ml.functions import array_to_vector
    from ..operators.chartdata import cluster_scatter, cluster_shares
    from ..operators.evaluate import pca_2d
    from ..operators.models import kmeans
    e = table(spark, sf, "embeddings")
    vec = e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    labels, _ = kmeans(vec, "v", "vec_id", k=3)
    sc = cluster_scatter(pca_2d(e, "embedding", "vec_id"), labels, "vec_id")
    return sc.join(F.broadcast(cluster_shares(sc).select("label", "size")), "label")  # three clusters


@register("cluster_shares", """
SELECT CAST(label AS VARCHAR) AS label, count(*) AS size, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share FROM embeddings GROUP BY 1""")
def q_cluster_shares(spark, sf):
    """H-7: share of every label of the embeddings."""
    from ..operators.chartdata import cluster_shares
    return cluster_shares(table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("label")))


@register("subtask_info", f"""
WITH c AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1),
n AS (SELECT count(*) AS n FROM orders)
SELECT 'classification' AS task_type, count(*)::DOUBLE AS n_classes, (count(*) = 2)::INTEGER::DOUBLE AS is_binary,
       string_agg(v || '=' || CAST(round(c.n / (SELECT sum(n) FROM c), 4) AS VARCHAR), ',' ORDER BY v) AS classes, NULL::DOUBLE AS target_min,
       NULL::DOUBLE AS target_max, NULL::DOUBLE AS target_mean, NULL::DOUBLE AS target_std, NULL::DOUBLE AS suggested_k, NULL::VARCHAR AS datetime_cols,
       NULL::VARCHAR AS freq_hint FROM c
UNION ALL SELECT 'regression', NULL, NULL, NULL, {S.rnd('min(o_totalprice)')}, {S.rnd('max(o_totalprice)')}, {S.rnd('avg(o_totalprice)')},
       {S.rnd('stddev_samp(o_totalprice)')}, NULL, NULL, NULL FROM orders
UNION ALL SELECT 'clustering', NULL, NULL, NULL, NULL, NULL, NULL, NULL, least(greatest(2, CAST(floor(sqrt(n) / 5) AS INTEGER)), 10), NULL, NULL FROM n
UNION ALL SELECT 'time_series', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'o_orderdate', 'inferred'""")
def q_subtask_info(spark, sf):
    """T-6 ... T-9 composed: what each task's verdict on orders carries."""
    from ..functions.exprs import rnd
    from ..operators.profile import schema_profile
    from ..operators.task import subtask_info
    o = table(spark, sf, "orders")
    prof = small_frame(schema_profile(o))
    out = None
    for task, target in (("classification", "o_orderstatus"), ("regression", "o_totalprice"), ("clustering", None), ("time_series", "o_totalprice")):
        one = subtask_info(o, prof, task, target)
        out = one if out is None else out.unionByName(one)
    classes = F.array_join(F.transform(F.map_entries("class_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    number = lambda c: F.col(c).cast("double").alias(c)  # noqa: E731 - null beside numbers
    return out.select("task_type", number("n_classes"), number("is_binary"), classes.alias("classes"), *[rnd(F.col(c)).alias(c) for c in (
        "target_min", "target_max", "target_mean", "target_std")], number("suggested_k"), F.array_join("datetime_cols", ",").alias("datetime_cols"), "freq_hint")


# ---------------------------------------------------------------------------
# Sources, sinks and the remaining small operators

def _scratch(spark, name):
    """A fresh folder under the session's checkpoint directory (shared storage on a cluster)."""
    import uuid
    from ..session import ensure_checkpoint_dir
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/{name}-{uuid.uuid4().hex}"


@register("csv_roundtrip", f"""
SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers, {S.rnd('sum(o_totalprice)', 2)} AS total_price,
       count(DISTINCT o_orderpriority) AS n_priorities, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day
FROM orders""")
def q_csv_roundtrip(spark, sf):
    """S-1/S-4/S-5/S-6/S-12: orders written as CSV with header, loaded back by extension with
    type inference and cleaning, then aggregated."""
    from ..functions.exprs import rnd
    from ..sources.readers import load, write_csv
    path = _scratch(spark, "orders-csv") + "/orders.csv"
    write_csv(table(spark, sf, "orders"), path)
    o = load(spark, path)
    return o.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_customers"),
                 rnd(F.sum("o_totalprice"), 2).alias("total_price"),
                 F.count_distinct("o_orderpriority").alias("n_priorities"),
                 F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"))


@register("json_roundtrip", """
SELECT count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS total_chars, count(DISTINCT lang) AS n_langs,
       count(*) FILTER (WHERE text IS NULL) AS null_texts
FROM documents""")
def q_json_roundtrip(spark, sf):
    """S-3/S-13: documents written as JSON lines (``to_json`` per row), loaded back and aggregated."""
    from ..sources.readers import load, to_json_rows
    path = _scratch(spark, "documents-json") + "/documents.json"
    to_json_rows(table(spark, sf, "documents")).write.text(path)
    d = load(spark, path, orient="lines")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").cast("long").alias("total_chars"),
                 F.count_distinct("lang").alias("n_langs"), F.count_if(F.col("text").isNull()).alias("null_texts"))


_LABELLED_SQL = """
SELECT count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(sum(quality) AS BIGINT) AS good,
       count(*) FILTER (WHERE quality IS NULL) AS unlabelled, count(*) FILTER (WHERE toxic = 1) AS toxic_docs,
       round(avg(n_chars * quality), 4) + 0.0 AS mean_chars
FROM documents LEFT JOIN labels USING (doc_id)"""


def _labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id", "left")


def _labelled_summary(d):
    from ..functions.exprs import rnd
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").cast("long").alias("ids"),
                 F.sum("quality").cast("long").alias("good"), F.count_if(F.col("quality").isNull()).alias("unlabelled"),
                 F.count_if(F.col("toxic") == 1).alias("toxic_docs"), rnd(F.avg(F.col("n_chars") * F.col("quality"))).alias("mean_chars"))


@register("csv_missing_roundtrip", _LABELLED_SQL)
def q_csv_missing_roundtrip(spark, sf):
    """S-1/S-5/S-6/S-12: labels with missing values written as NA tokens under padded column names, and an
    all-missing row; loaded back as numbers with the names stripped and the empty row dropped."""
    from ..sources.readers import load, write_csv
    d = _labelled(spark, sf)
    text = d.select(*[F.coalesce(F.col(c).cast("string"), F.lit(t)).alias(f"  {c} ") for c, t in
                      zip(d.columns, ("NA", "nan", "NULL", "NA", "n/a"))])
    empty = spark.range(1).select(*[F.lit("NA").alias(c) for c in text.columns])
    path = _scratch(spark, "labelled-csv") + "/labelled.csv"
    write_csv(text.unionByName(empty), path)
    return _labelled_summary(load(spark, path))


@register("json_missing_roundtrip", _LABELLED_SQL)
def q_json_missing_roundtrip(spark, sf):
    """S-3/S-13: the same rows as JSON lines that keep their nulls."""
    from ..sources.readers import load, to_json_rows
    path = _scratch(spark, "labelled-json") + "/labelled.json"
    to_json_rows(_labelled(spark, sf)).write.text(path)
    return _labelled_summary(load(spark, path, orient="lines"))


@register("sample_values", """
WITH l AS (SELECT 'o_custkey' AS column_name, o_orderkey AS ord, CAST(o_custkey AS VARCHAR) AS value FROM orders
           WHERE o_custkey IS NOT NULL
           UNION ALL SELECT 'o_orderstatus', o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL
           UNION ALL SELECT 'o_totalprice', o_orderkey, CAST(o_totalprice AS VARCHAR) FROM orders WHERE o_totalprice IS NOT NULL),
r AS (SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY ord, value) AS rank FROM l)
SELECT column_name, rank, value FROM r WHERE rank <= 5""")
def q_sample_values(spark, sf):
    """P-8: first five non-null values per column in key order (two-stage top-k)."""
    from ..operators.profile import sample_values
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return sample_values(o, "o_orderkey", long_form=True)


@register("class_names", """
SELECT CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS code, v AS class_name
FROM (SELECT DISTINCT coalesce(o_orderpriority, 'nan') AS v FROM orders)""")
def q_class_names(spark, sf):
    """V-6 / X-5: class codes in code-point order, null as 'nan'."""
    from ..operators.order_stats import dense_codes
    o = table(spark, sf, "orders").select(F.coalesce(F.col("o_orderpriority"), F.lit("nan")).alias("class_name"))
    return dense_codes(o, "class_name", "code")


@register("split_sizes", f"""
SELECT count(*) FILTER (WHERE NOT is_test) AS train_size, count(*) FILTER (WHERE is_test) AS test_size,
       {len(LI_FEATURES)} AS n_features FROM ({_li_split_sql()})""")
def q_split_sizes(spark, sf):
    """V-9: train/test sizes of the exact 80/20 hash split and the feature count."""
    from ..operators.evaluate import run_sizes
    from ..operators.prep import hash_split
    return run_sizes(hash_split(table(spark, sf, "lineitem").select(*LI_KEYS), LI_KEYS), len(LI_FEATURES))


@register("datetime_columns", f"""
SELECT column_name, position FROM ({profile_sql('orders')}) WHERE role = 'datetime'
UNION ALL
SELECT column_name, position FROM ({profile_sql('events')}) WHERE role = 'datetime'""")
def q_datetime_columns(spark, sf):
    """T-9 / P-11: datetime-role columns of orders and events."""
    from ..operators.profile import clean, schema_profile
    from ..operators.task import datetime_columns
    a = datetime_columns(schema_profile(clean(table(spark, sf, "orders"))))
    b = datetime_columns(schema_profile(clean(table(spark, sf, "events"))))
    return a.unionByName(b)


@register("eda_report_json")
def q_eda_report_json(spark, sf):
    """E-12 + S-13: the full exploratory report of events, one JSON document per section row."""
    from ..operators.profile import clean, schema_profile
    from ..operators.stats import eda_report
    from ..sources.readers import to_json_rows
    df = clean(table(spark, sf, "events"))
    rep = eda_report(df, small_frame(schema_profile(df)))
    out = None
    for name, frame in rep.items():
        if frame is None:
            continue
        j = to_json_rows(frame).select(F.lit(name).alias("section"), "json")
        out = j if out is None else out.unionByName(j)
    return out


@register("arena_clustering")
def q_arena_clustering(spark, sf):
    """R-1/R-2/R-4/R-5: the three clustering candidates on standardized embeddings, ranked by
    silhouette (squared Euclidean), with winner and counts."""
    from ..operators.arena import arena_clustering, arena_summary, leaderboard
    metrics, errors = arena_clustering(table(spark, sf, "embeddings"), "embedding", "vec_id")
    board = leaderboard(metrics, "clustering")
    return board.join(arena_summary(board, errors), "run_id")


@register("feature_encoders", f"""
WITH d AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
q AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS med, quantile_cont(n_chars, 0.75) AS q3
      FROM d WHERE n_chars IS NOT NULL),
te AS (SELECT lang AS _cat, avg(quality) AS lang_te FROM d GROUP BY lang),
g AS (SELECT avg(quality) AS gm FROM d)
SELECT d.doc_id,
       {S.rnd('(d.n_chars - q.med) / CASE WHEN q.q3 - q.q1 = 0 THEN 1.0 ELSE q.q3 - q.q1 END', 6)} AS n_chars_robust,
       {S.rnd('coalesce(te.lang_te, g.gm)', 6)} AS lang_te,
       CAST(d.lang = 'de' AS INTEGER) AS lang_de, CAST(d.lang = 'en' AS INTEGER) AS lang_en,
       CAST(d.lang = 'es' AS INTEGER) AS lang_es, CAST(d.lang = 'fr' AS INTEGER) AS lang_fr
FROM d CROSS JOIN q CROSS JOIN g LEFT JOIN te ON te._cat IS NOT DISTINCT FROM d.lang""")
def q_feature_encoders(spark, sf):
    """F-13/F-14/F-15: robust scaling of n_chars, target encoding of lang by labels.quality
    (unlabelled documents give null targets), one-hot of lang."""
    from ..functions.exprs import rnd
    from ..operators.features import one_hot, robust_scale, target_encode
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars") \
        .join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    out = one_hot(target_encode(robust_scale(d, ["n_chars"]), "lang", "quality", output="lang_te"), "lang")
    return out.select("doc_id", rnd(F.col("n_chars"), 6).alias("n_chars_robust"), rnd(F.col("lang_te"), 6).alias("lang_te"),
                      *[c for c in out.columns if c.startswith("lang_") and c != "lang_te"])


@register("arena_classification")
def q_arena_classification(spark, sf):
    """R-1/R-2/R-4/R-5 + M-7 ... M-12: every classification key of the registry (forest, boosting,
    deep boosting, RBF-feature SVM, logistic, tree) fitted on labelled documents for labels.quality,
    5-fold CV each, ranked by F1; failures would appear in ``failed``."""
    from ..operators.arena import arena, arena_summary, leaderboard
    from ..operators.prep import prepare
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    df = table(spark, sf, "labels").join(d, "doc_id").select("doc_id", "lang", "source", "n_chars", "toxic", "quality")
    metrics, errors = arena(prepare(df, "quality", "classification", ["doc_id"]))
    board = leaderboard(metrics, "classification")
    return board.join(arena_summary(board, errors), "run_id")


@register("cv_folds")
def q_cv_folds(spark, sf):
    """V-5 + H-4: per-fold R^2 of ridge regression for orders.o_totalprice (true folds)."""
    from ..operators.models import fit_eval
    from ..operators.prep import prepare
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus",
                                          "o_totalprice")
    return fit_eval(prepare(o, "o_totalprice", "regression", ["o_orderkey"]), "ridge")["cv"]
