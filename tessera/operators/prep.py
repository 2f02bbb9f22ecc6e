"""Preprocessing (X-1 ... X-11): label codes, numeric selection, median imputation,
deterministic (stratified) 80/20 splits, standardisation, vector assembly.

Every statistic is fitted on the rows the caller passes as ``fit`` (train by
default), then applied by projection or a join against a small table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col, split_hash
from ..session import materialize, small_frame
from .order_stats import column_quantiles, dense_codes, keyed_join, row_ranks

# Fixed values.
TEST_FRACTION = 0.2
SPLIT_SEED = 42
NULL_CLASS = "nan"          # missing category becomes its own class, as str(NaN)
SCALED_MODELS = ("linear_regression", "ridge", "logistic_regression", "svr", "svm_clf",
                 "rbf_reg", "rbf_svm_clf")


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """X-3: int/float columns only (booleans and datetimes are dropped)."""
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in exclude]


#: Most rows of a per-value frame that is broadcast; its rows are counted first, larger ones are joined by key and salt.
BROADCAST_ROWS = 10_000


def column_codes(fit: DataFrame, cols: Sequence[str]) -> DataFrame:
    """X-2: (column_name, _v, _code): the 0-based code of every distinct value of the columns in code-point order, null as the
    class ``'nan'``; all columns in one distributed ranking."""
    values = fit.select(*[F.coalesce(col(c).cast("string"), F.lit(NULL_CLASS)).alias(c) for c in cols])
    distinct = values.unpivot([], list(cols), "column_name", "_v").distinct()
    ranked = row_ranks(distinct, ["column_name"], ["_v"], "_r")
    return materialize(ranked.select("column_name", "_v", (F.col("_r") - 1).cast("double").alias("_code")))


def label_encode(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """X-2: replace each string column by its code in ``fit`` (or in ``codes``, made by ``column_codes``); unseen values get
    null."""
    cols = list(cols)
    if not cols:
        return df
    codes = codes if codes is not None else column_codes(fit if fit is not None else df, cols)
    sizes = {r["column_name"]: r["count"] for r in codes.groupBy("column_name").count().collect()}  # one number a column
    out = df
    for c in cols:
        mapping = codes.where(F.col("column_name") == c).select("_v", "_code")
        keyed = out.withColumn("_v", F.coalesce(col(c).cast("string"), F.lit(NULL_CLASS)))
        if sizes.get(c, 0) <= BROADCAST_ROWS:
            joined = keyed.join(F.broadcast(mapping), "_v", "left").drop("_v", c)
        else:  # a category may hold a third of the rows: spread over salts of the whole row
            spread = keyed.withColumn("_spread", F.xxhash64(*[col(x) for x in out.columns]))
            joined = keyed_join(spread, mapping, ["_v"], "_spread", "left").drop("_v", "_spread", c)
        out = joined.withColumnRenamed("_code", c)
    return out.select(*df.columns)


def medians(fit: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-row frame of exact medians (column name -> median)."""
    q = column_quantiles(fit, cols, {"median": 0.5})
    return q.groupBy().pivot("column_name", list(cols)).agg(F.first("median"))


def impute_median(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """X-4: median imputation (exact, fitted on ``fit``); all-missing column -> 0.

    Missing values are counted first (one cheap aggregate over ``df``); medians
    -- an exact quantile job -- are computed only for columns that need them."""
    cols = list(cols)
    d = {c: col(c).cast("double") for c in cols}
    miss = df.agg(*[F.count_if(d[c].isNull() | F.isnan(d[c])).alias(c) for c in cols]).first()
    need = [c for c in cols if miss[c] > 0]
    filled = {c: F.when(~F.isnan(d[c]), d[c]) for c in cols}
    if not need:
        return df.select(*[filled[c].alias(c) if c in cols else col(c) for c in df.columns])
    med = medians(fit if fit is not None else df, need).select(*[col(c).alias(f"_med_{c}") for c in need])
    joined = df.crossJoin(F.broadcast(med))  # one row
    return joined.select(*[(F.coalesce(filled[c], F.col(f"_med_{c}"), F.lit(0.0)) if c in need else filled[c]).alias(c)
                           if c in cols else col(c) for c in df.columns])


def hash_split(df: DataFrame, key_cols: Sequence[str], test_fraction: float = TEST_FRACTION,
               seed: int = SPLIT_SEED, strata: str | None = None, name: str = "is_test") -> DataFrame:
    """X-7/X-8: deterministic split. Within each stratum (whole table when none) the first ``ceil(test_fraction * n)`` rows by
    ``(md5 hash of key, key)`` are test; rows that share a key are on the same side. Null strata are one stratum.

    The cut of each stratum is found by scans of the keys alone, two histograms of the hash and a sort of what is left of
    a stratum / 2^24, three small jobs; the result is ``df`` joined with one cut a stratum, in one more scan.
    The same rule in SQL is ``row_number() OVER (PARTITION BY s ORDER BY h, key)``.
    """
    key = F.concat_ws("|", *[col(c).cast("string") for c in key_cols])
    group = F.coalesce(col(strata).cast("string"), F.lit("\0")) if strata else F.lit("")
    tagged = df.withColumns({"_skey": key, "_g": group}).withColumn("_h", split_hash(F.col("_skey"), seed))
    cuts = _hash_cuts(tagged.select("_g", "_h", "_skey"), test_fraction, strata is not None)
    if strata is None or cuts.count() <= BROADCAST_ROWS:
        joined = tagged.join(F.broadcast(cuts), "_g", "left")
    else:
        joined = keyed_join(tagged, cuts, ["_g"], "_skey", "left")
    first = (F.col("_h") < F.col("_cut_h")) | ((F.col("_h") == F.col("_cut_h")) & (F.col("_skey") <= F.col("_cut_key")))
    return joined.withColumn(name, F.coalesce(first, F.lit(False))).select(*df.columns, name)


def _hash_cuts(rows: DataFrame, fraction: float, many: bool) -> DataFrame:
    """(_g, _cut_h, _cut_key): the last test row of each group by (_h, _skey)."""
    pin = materialize if many else small_frame
    left, keys = None, ["_g"]
    for bits in (20, 8):  # the highest 12 of 32 bits, then the next 12
        part = F.shiftright("_h", bits).alias("_part")
        held = rows if left is None else rows.withColumn("_above", F.shiftright("_h", 20)).join(F.broadcast(left) if not many else left, ["_g", "_above"])
        counts = held.groupBy("_g", part, *([] if left is None else ["_need"])).agg(F.count(F.lit(1)).alias("_c"))
        whole, so_far = Window.partitionBy("_g"), Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        need = F.ceil(F.sum("_c").over(whole) * fraction) if left is None else F.col("_need")
        counts = counts.select("_g", "_part", "_c", need.alias("_need"), F.sum("_c").over(so_far).alias("_cum"))
        before = F.col("_cum") - F.col("_c")
        at = counts.where((F.col("_cum") >= F.col("_need")) & (before < F.col("_need"))).select("_g", "_part", (F.col("_need") - before).alias("_need"))
        left = pin(at).withColumnRenamed("_part", "_above" if left is None else "_part")
    own = rows.withColumn("_part", F.shiftright("_h", 8)).join(F.broadcast(left) if not many else left, ["_g", "_part"])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "_skey"))
    return pin(own.withColumn("_place", place).where(F.col("_place") == F.col("_need")).select(
        "_g", F.col("_h").alias("_cut_h"), F.col("_skey").alias("_cut_key")))


def standardize(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """X-9: (x - mean) / population std fitted on ``fit``; zero std divides by 1."""
    fit = fit if fit is not None else df
    stats = fit.agg(*[F.avg(col(c)).alias(f"_mu_{c}") for c in cols],
                    *[F.stddev_pop(col(c)).alias(f"_sd_{c}") for c in cols])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    def scaled(c):
        sd = F.col(f"_sd_{c}")
        return ((col(c) - F.col(f"_mu_{c}")) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)).alias(c)
    return joined.select(*[scaled(c) if c in cols else col(c) for c in df.columns])


def prepare(df: DataFrame, target: str | None, task: str, key_cols: Sequence[str],
            test_fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED) -> dict:
    """X-1 ... X-9 for one table. Returns ``train``/``test`` DataFrames with the
    feature columns (raw and ``scaled`` variants), ``label`` and ``_key``
    columns, plus metadata. Fitting (codes, medians, scaling) uses train only."""
    exclude = [target] if target else []
    keep_keys = list(key_cols)
    base = df.withColumn("_key", F.concat_ws("|", *[col(c).cast("string") for c in keep_keys]))
    if task == "classification":
        base = base.withColumn("_label_raw", F.coalesce(col(target).cast("string"), F.lit(NULL_CLASS)))
    elif target:
        base = base.withColumn("_label_raw", col(target).cast("double")) \
            .where(F.col("_label_raw").isNotNull() & ~F.isnan("_label_raw"))
    if target:
        base = base.drop(target)
    strata = "_label_raw" if task == "classification" else None
    split = materialize(hash_split(base, ["_key"], test_fraction, seed, strata))
    train_raw, test_raw = split.where(~F.col("is_test")), split.where(F.col("is_test"))
    str_cols = [c for c in string_columns(df, exclude + keep_keys)]
    codes = column_codes(train_raw, str_cols) if str_cols else None
    enc_train = label_encode(train_raw, str_cols, codes=codes)
    enc_test = label_encode(test_raw, str_cols, codes=codes)
    features = [c for c in numeric_columns(df, exclude) if c not in keep_keys] + str_cols
    features = [c for c in df.columns if c in features]
    imp_train = impute_median(enc_train, features, fit=enc_train)
    imp_test = impute_median(enc_test, features, fit=enc_train)
    if task == "classification":
        # codes of the whole target: a class whose rows all fall into one part still has its code in both
        classes = materialize(dense_codes(split.select("_label_raw"), "_label_raw", "label"))
        imp_train = keyed_join(imp_train, classes, ["_label_raw"], "_key", "left")
        imp_test = keyed_join(imp_test, classes, ["_label_raw"], "_key", "left")
    elif target:
        imp_train = imp_train.withColumn("label", F.col("_label_raw"))
        imp_test = imp_test.withColumn("label", F.col("_label_raw"))
    cols = ["_key"] + features + (["label"] if target else [])
    train = materialize(imp_train.select(*cols))
    test = materialize(imp_test.select(*cols))
    return {"train": train, "test": test, "features": features,
            "task": task, "target": target}


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """X-11: dense feature vector column (``VectorAssembler``)."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="keep").transform(df)


def test_size(n: int, test_fraction: float = TEST_FRACTION) -> int:
    return int(math.ceil(n * test_fraction))
