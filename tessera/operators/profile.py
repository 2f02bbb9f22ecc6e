"""Schema profile and column-role inference (one aggregate pass over the table).

Output: one row per input column with
``column, position, dtype, n_rows, n_unique, n_missing, missing_pct, role,
min_value, max_value, mean_value, std_value, is_potential_target, is_datetime,
has_datetime``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import (clean_value, col, is_missing, kind_of, parses_as_datetime,
                               safe4)

# Role thresholds.
CATEGORICAL_MAX_UNIQUE = 20      # numeric column: at most this many distinct values ...
CATEGORICAL_MAX_RATIO = 0.05     # ... and fewer than this share of the rows
STRING_CATEGORICAL_MAX = 50      # string column: at most this many distinct -> categorical


def clean(df: DataFrame) -> DataFrame:
    """Strip column names and drop rows where every value is missing (NaN counts)."""
    df = df.toDF(*[str(c).strip() for c in df.columns])
    all_missing = F.lit(True)
    for f in df.schema.fields:
        all_missing = all_missing & is_missing(col(f.name), f.dataType)
    return df.where(~all_missing) if df.columns else df


def role_expr(kind: F.Column, n_unique: F.Column, n_rows: F.Column, dt_ok: F.Column) -> F.Column:
    ratio = n_unique.cast("double") / F.greatest(n_rows, F.lit(1)).cast("double")
    return (F.when(kind == "numeric",
                   F.when((n_unique <= CATEGORICAL_MAX_UNIQUE) & (ratio < CATEGORICAL_MAX_RATIO),
                          "categorical").otherwise("numeric"))
            .when(kind == "datetime", "datetime")
            .when(kind == "string",
                  F.when(dt_ok, "datetime")
                  .when(n_unique <= STRING_CATEGORICAL_MAX, "categorical").otherwise("text"))
            .when(kind == "boolean", "categorical")
            .otherwise("other"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """One row with the number of distinct values ``_nu<i>`` of every column (P-2), missing ones left out.

    A row's values become (column, 128-bit hash) pairs, which are made distinct inside the tasks before one shuffle, so
    neither rows nor values are copied once a column. Exact up to collisions of the hash.
    """
    hashes, places = [], []
    for i, f in enumerate(df.schema.fields):
        v = clean_value(col(f.name), f.dataType)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            v = v + F.lit(0.0)  # -0.0 is 0.0
        hashes += [F.when(v.isNotNull(), F.xxhash64(v)).alias(f"h{i}"), F.when(v.isNotNull(), F.xxhash64(v, F.lit(i))).alias(f"g{i}")]
        places.append(f"(h{i}, g{i}) AS `{i}`")
    if not places:
        return df.sparkSession.range(1).select()
    # UNPIVOT of pairs: flat rows, without an array and its structs a row; pairs of nulls are left out
    found = df.sparkSession.sql(f"SELECT CAST(i AS INT) AS i, h, g FROM {{pairs}} UNPIVOT ((h, g) FOR i IN ({', '.join(places)}))",
                                pairs=df.select(*hashes)).distinct()
    return found.agg(*[F.count_if(F.col("i") == i).alias(f"_nu{i}") for i in range(len(places))])


def schema_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """P-1 ... P-12 in one ``agg``; the long form is a projection of that one row. Distinct values are counted by
    ``distinct_counts``, or with ``exact=False`` by HyperLogLog++ in the same aggregate."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_n")]
    distincts = []
    for i, f in enumerate(fields):
        v = clean_value(col(f.name), f.dataType)
        kind = kind_of(f.dataType)
        aggs.append(F.count(v).alias(f"_nn{i}"))
        distincts.append(F.approx_count_distinct(v).alias(f"_nu{i}"))
        if kind == "numeric":
            d = v.cast("double")
            aggs += [F.min(d).alias(f"_mn{i}"), F.max(d).alias(f"_mx{i}"),
                     F.avg(d).alias(f"_av{i}"), F.stddev_samp(d).alias(f"_sd{i}")]
        if kind == "string":
            # every non-null value must parse (bool_and skips nulls); no non-null -> not datetime
            aggs.append(F.bool_and(F.when(v.isNotNull(), parses_as_datetime(v))).alias(f"_dt{i}"))
    one = df.agg(*aggs).crossJoin(distinct_counts(df)) if exact else df.agg(*aggs, *distincts)  # one row each
    null_d = F.lit(None).cast("double")
    rows = []
    for i, f in enumerate(fields):
        kind = kind_of(f.dataType)
        num = kind == "numeric"
        rows.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(i).alias("position"),
            F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(kind).alias("kind"),
            F.col(f"_nu{i}").cast("long").alias("n_unique"),
            (F.col("_n") - F.col(f"_nn{i}")).alias("n_missing"),
            (F.col(f"_mn{i}") if num else null_d).alias("_min"),
            (F.col(f"_mx{i}") if num else null_d).alias("_max"),
            (F.col(f"_av{i}") if num else null_d).alias("_mean"),
            (F.col(f"_sd{i}") if num else null_d).alias("_std"),
            (F.coalesce(F.col(f"_dt{i}"), F.lit(False)) if kind == "string" else F.lit(False)).alias("_dt"),
        ))
    long = one.select(F.col("_n").alias("n_rows"), F.explode(F.array(*rows)).alias("r")) \
        .select("n_rows", "r.*")
    role = role_expr(F.col("kind"), F.col("n_unique"), F.col("n_rows"), F.col("_dt"))
    is_num = F.col("role") == "numeric"
    # window over the profile itself (one row per column, never the data)
    whole = Window.partitionBy()
    out = long.withColumn("role", role).select(
        "column_name", "position", "dtype", "n_rows", "n_unique", "n_missing",
        F.when(F.col("n_rows") > 0, F.round(F.col("n_missing") * 100.0 / F.col("n_rows"), 2))
         .otherwise(F.lit(0.0)).alias("missing_pct"),
        "role",
        F.when(is_num, safe4(F.col("_min"))).alias("min_value"),
        F.when(is_num, safe4(F.col("_max"))).alias("max_value"),
        F.when(is_num, safe4(F.col("_mean"))).alias("mean_value"),
        F.when(is_num, safe4(F.col("_std"))).alias("std_value"),
        (F.col("role").isin("numeric", "categorical") & (F.col("n_unique") > 1)).alias("is_potential_target"),
        (F.col("role") == "datetime").alias("is_datetime"),
    )
    return out.withColumn("has_datetime", F.max(F.col("is_datetime").cast("int")).over(whole) == 1)


def table_summary(profile: DataFrame) -> DataFrame:
    """Table-level record: n_rows, n_cols, potential targets and datetime columns (sorted by position)."""
    pos_sorted = lambda cond: F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct("position", "column_name")))),
        lambda s: s["column_name"])
    return profile.agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols"),
        pos_sorted(F.col("is_potential_target")).alias("potential_targets"),
        pos_sorted(F.col("is_datetime")).alias("datetime_cols"),
        F.max(F.col("is_datetime").cast("int")).cast("boolean").alias("has_datetime"))


def sample_values(df: DataFrame, order_col: str | None = None, k: int = 5, long_form: bool = False) -> DataFrame:
    """P-8: first ``k`` non-null values per column as strings, ordered by ``order_col``
    (or by the value itself when no order is given). Two-stage top-k, no hot task."""
    from .order_stats import top_k
    fields = [f for f in df.schema.fields if f.name != order_col]
    casted = df.select(*([col(order_col).alias("_ord")] if order_col else []),
                       *[clean_value(col(f.name), f.dataType).cast("string").alias(f.name) for f in fields])
    long = casted.unpivot(["_ord"] if order_col else [], [f.name for f in fields], "column_name", "value") \
        .where(F.col("value").isNotNull())
    order = [F.col("_ord"), F.col("value")] if order_col else [F.col("value")]
    ranked = top_k(long, ["column_name"], order, k)
    if long_form:
        return ranked.select("column_name", "rank", "value")
    return ranked.groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))),
                    lambda s: s["value"]).alias("sample_values"))
