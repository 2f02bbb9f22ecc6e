"""Feature suggestions (F-1 ... F-8) and transforms (F-9 ... F-16).

Suggestions are rules over the profile and EDA tables (all small: one row per
column or column pair); transforms are projections/joins on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col

# Suggestion thresholds, priorities and texts.
SKEW_HIGH, SKEW_MEDIUM = 2.0, 1.0
OUTLIER_PCT = 5
CORR_HIGH = 0.7
ONE_HOT_MAX = 10
TOP_SUGGESTIONS = 8
TXT = {
    "log1p": ("High skewness ({:.2f}) — log transform will normalize distribution",
              "Reduces outlier influence, improves linear model performance"),
    "sqrt": ("Moderate skewness ({:.2f}) — square root can help", "Reduces tail effects for parametric models"),
    "robust_scale": ("{}% outliers detected — robust scaling recommended", "IQR-based scaling resists outlier distortion"),
    "interaction": ("High correlation ({:.2f}) — interaction term may capture non-linear relationship",
                    "Captures multiplicative effects between related features"),
    "target_encode": ("High cardinality ({} categories) — target encoding preferred over one-hot",
                      "Avoids dimensionality explosion from one-hot encoding"),
    "one_hot": ("Low cardinality ({} categories) — one-hot encoding is safe",
                "Standard encoding for tree-based and linear models"),
    "datetime_extract": ("Datetime column — extract year, month, day_of_week, hour for temporal patterns",
                         "Unlocks seasonal and cyclical patterns in the data"),
}


def _row(feature, transform, reason, priority, hint, group, p1, p2, sub):
    return F.struct(feature.alias("feature"), F.lit(transform).alias("transform"), reason.alias("reason"),
                    F.lit(priority).alias("priority"), F.lit(TXT[transform][1]).alias("impact"),
                    hint.alias("code_hint"), F.lit(group).alias("_g"), p1.alias("_p1"), p2.alias("_p2"),
                    F.lit(sub).alias("_s"))


def suggest_features(profile: DataFrame, skewness: DataFrame, outliers: DataFrame,
                     correlations: DataFrame, top: int | None = TOP_SUGGESTIONS) -> DataFrame:
    """Inputs: ``profile`` (column_name, position, role, n_unique), ``skewness``
    (column_name, skewness), ``outliers`` (column_name, pct), ``correlations``
    (col_a, col_b, r). Output ranked suggestions (``rank`` 1..), top ``top``."""
    prof = profile.select("column_name", "position", "role", "n_unique")
    num = prof.where(F.col("role") == "numeric") \
        .join(skewness.select("column_name", "skewness"), "column_name", "left") \
        .join(outliers.select("column_name", "pct"), "column_name", "left")
    s = F.abs(F.coalesce(F.col("skewness"), F.lit(0.0)))
    c = F.col("column_name")
    p = F.col("position")
    none = F.lit(0)
    skew_rows = num.select(F.explode(F.array(
        F.when(s > SKEW_HIGH, _row(c, "log1p", F.format_string(TXT["log1p"][0].replace("{:.2f}", "%.2f"), s),
                                   "high", F.format_string("F.log1p(F.greatest(F.col('%s'), F.lit(0)))", c),
                                   0, p, none, 0))
        .when(s > SKEW_MEDIUM, _row(c, "sqrt", F.format_string(TXT["sqrt"][0].replace("{:.2f}", "%.2f"), s),
                                    "medium", F.format_string("F.sqrt(F.greatest(F.col('%s'), F.lit(0)))", c),
                                    0, p, none, 0)),
        F.when(F.col("pct") > OUTLIER_PCT,
               _row(c, "robust_scale", F.concat(F.col("pct").cast("string"),
                                                F.lit(TXT["robust_scale"][0].replace("{}", ""))),
                    "high", F.lit("pyspark.ml.feature.RobustScaler"), 0, p, none, 1)))).alias("r")) \
        .where(F.col("r").isNotNull())
    npos = prof.where(F.col("role") == "numeric").select("column_name", "position")
    pairs = correlations.join(npos.withColumnRenamed("column_name", "col_a").withColumnRenamed("position", "pa"), "col_a") \
        .join(npos.withColumnRenamed("column_name", "col_b").withColumnRenamed("position", "pb"), "col_b") \
        .where((F.col("pa") < F.col("pb")) & (F.abs(F.col("r")) > CORR_HIGH))
    inter_rows = pairs.select(_row(F.concat(F.col("col_a"), F.lit(" × "), F.col("col_b")), "interaction",
                                   F.format_string(TXT["interaction"][0].replace("{:.2f}", "%.2f"), F.col("r")),
                                   "medium", F.format_string("F.col('%s') * F.col('%s')", F.col("col_a"), F.col("col_b")),
                                   1, F.col("pa"), F.col("pb"), 0).alias("r"))
    cat = prof.where(F.col("role") == "categorical")
    nu = F.col("n_unique")
    cat_rows = cat.select(F.when(nu > ONE_HOT_MAX, _row(
        c, "target_encode", F.format_string(TXT["target_encode"][0].replace("{}", "%d"), nu), "high",
        F.format_string("pyspark.ml.feature.TargetEncoder(inputCols=['%s'])", c), 2, p, none, 0))
        .otherwise(_row(c, "one_hot", F.format_string(TXT["one_hot"][0].replace("{}", "%d"), nu), "low",
                        F.format_string("pyspark.ml.feature.OneHotEncoder(inputCols=['%s'])", c), 2, p, none, 0))
        .alias("r"))
    dt_rows = prof.where(F.col("role") == "datetime").select(_row(
        c, "datetime_extract", F.lit(TXT["datetime_extract"][0]), "high",
        F.format_string("F.month(F.col('%s'))", c), 3, p, none, 0).alias("r"))
    allr = skew_rows.unionByName(inter_rows).unionByName(cat_rows).unionByName(dt_rows).select("r.*")
    prio = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    w = Window.orderBy(prio, "_g", "_p1", "_p2", "_s")  # over suggestions (<= columns^2 rows), not data
    ranked = allr.withColumn("rank", F.row_number().over(w).cast("long"))
    if top:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("rank", "feature", "transform", "reason", "priority", "impact", "code_hint")


def apply_features(df: DataFrame, suggestions: DataFrame | Sequence[dict]) -> DataFrame:
    """F-9 ... F-12: add ``{c}_log``, ``{c}_sqrt``, ``{a}_x_{b}`` in one projection;
    unknown transforms or missing columns are skipped. Suggestions are a small
    table (at most columns^2 rows) and are read on the driver to build the projection."""
    rows = suggestions.select("feature", "transform").collect() if isinstance(suggestions, DataFrame) else suggestions
    cols = set(df.columns)
    new = {}
    for r in rows:
        f, t = r["feature"], r["transform"]
        if t == "log1p" and f in cols:
            new[f"{f}_log"] = F.when(col(f).isNotNull(), F.log1p(F.greatest(col(f).cast("double"), F.lit(0.0))))
        elif t == "sqrt" and f in cols:
            new[f"{f}_sqrt"] = F.when(col(f).isNotNull(), F.sqrt(F.greatest(col(f).cast("double"), F.lit(0.0))))
        elif t == "interaction" and " × " in f:
            a, _, b = f.partition(" × ")
            if a in cols and b in cols:
                new[f"{a}_x_{b}"] = col(a) * col(b)
    return df.withColumns(new) if new else df


def robust_scale(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """F-13: (x - median) / IQR with exact quantiles fitted on ``fit``; IQR 0 -> divide by 1."""
    from .order_stats import column_quantiles
    q = column_quantiles(fit if fit is not None else df, cols, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    wide = q.groupBy().pivot("column_name", list(cols)).agg(
        F.first("med").alias("med"), F.first(F.col("q3") - F.col("q1")).alias("iqr"))
    joined = df.crossJoin(F.broadcast(wide))  # one row

    def scaled(c):
        iqr = F.col(f"{c}_iqr")
        return ((col(c) - F.col(f"{c}_med")) / F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)).alias(c)
    return joined.select(*[scaled(c) if c in cols else col(c) for c in df.columns])


def target_encode(df: DataFrame, column: str, target: str, fit: DataFrame | None = None,
                  output: str | None = None) -> DataFrame:
    """F-14: mean target per category (fitted on ``fit``), joined back; unseen -> global mean."""
    fit = fit if fit is not None else df
    out = output or f"{column}_te"
    means = fit.groupBy(col(column).alias("_cat")).agg(F.avg(col(target)).alias(out))
    glob = fit.agg(F.avg(col(target)).alias("_gm"))
    # a category may hold a third of the rows; null is a category, so keys are compared as (is null, text)
    from .order_stats import keyed_join
    flat = lambda c: F.struct(c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("v"))
    tagged = df.withColumn("_k", flat(col(column))).withColumn("_spread", F.xxhash64(*[col(x) for x in df.columns]))
    joined = keyed_join(tagged, means.select(flat(F.col("_cat")).alias("_k"), out), ["_k"], "_spread", "left")
    return joined.crossJoin(F.broadcast(glob)) \
        .withColumn(out, F.coalesce(F.col(out), F.col("_gm"))).drop("_k", "_spread", "_gm")


#: Columns that ``one_hot`` adds at most.
MOST_CATEGORIES = 1000


def one_hot(df: DataFrame, column: str, values: Sequence[str] | None = None) -> DataFrame:
    """F-15: one 0/1 column per category. Categories become column names, so they are read from the
    data when not given; a column of more than ``MOST_CATEGORIES`` raises (``target_encode`` is for those)."""
    if values is None:
        found = df.select(col(column).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct().limit(MOST_CATEGORIES + 1).collect()
        if len(found) > MOST_CATEGORIES:
            raise ValueError(f"Column '{column}' has more than {MOST_CATEGORIES} values: too many for columns of their own.")
        values = sorted(r["v"] for r in found)
    return df.withColumns({f"{column}_{v}": (col(column).cast("string") == F.lit(v)).cast("int") for v in values})


def datetime_extract(df: DataFrame, column: str) -> DataFrame:
    """F-16: year, month, day_of_week (Monday = 0), hour."""
    c = col(column)
    return df.withColumns({f"{column}_year": F.year(c), f"{column}_month": F.month(c),
                           f"{column}_day_of_week": F.pmod(F.dayofweek(c) + 5, F.lit(7)),
                           f"{column}_hour": F.hour(c)})
