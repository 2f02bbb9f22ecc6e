"""Order statistics that scale: running totals, exact quantiles, top-k per group.

A global ``Window.orderBy(v)`` (or a per-feature window over raw rows) sends a
whole column to one task. Everything here instead

1. pre-aggregates to distinct ``(key, value)`` rows with multiplicities,
2. splits each key into value buckets whose bounds come from an approximate
   quantile sketch (bounded memory), so a key holding a third of the rows is
   spread over many tasks,
3. computes running sums inside each ``(key, bucket)`` partition, and
4. adds per-bucket offsets from a table of ``keys x buckets`` rows.

The result is exact; the sketch only decides where work is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import col


#: Key columns that hold one value per named column of a table; frames keyed by them alone are broadcast.
NAMED_KEYS = frozenset({"column_name", "feature"})
#: Copies of a per-key frame whose key values grow with the data; each key's rows spread over as many tasks.
SALTS = 16
#: Share of a column's rows on either side of a quantile in its buckets, several times the error 1 / SKETCH of the sketch.
AROUND, SKETCH = 0.001, 10000
#: Values of a key sampled (by hash) for string bucket bounds.
BOUND_SAMPLE = 256


def keyed_join(df: DataFrame, frame: DataFrame, keys: Sequence[str], spread: str, how: str = "inner") -> DataFrame:
    """Join a frame with one row per key to ``df``, never gathering a key's rows in one task.

    Frames keyed by column names (a row per named column) or by nothing (one row) are broadcast. Frames keyed by
    data values may grow with the table: they are repeated ``SALTS`` times and joined on the key
    and a salt from ``df``'s column ``spread``.
    """
    keys = list(keys)
    if not keys:
        return df.crossJoin(F.broadcast(frame))
    if set(keys) <= NAMED_KEYS:
        return df.join(F.broadcast(frame), keys, how)
    salted = frame.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")) \
        .join(salted, [*keys, "_salt"], how).drop("_salt")


def _default_buckets(df: DataFrame) -> int:
    try:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always present
        n = 200
    return max(2, n)


def to_long(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (),
            name: str = "column_name", value: str = "value", drop_missing: bool = True) -> DataFrame:
    """Unpivot numeric columns into ``(ids..., column, value double)``; NaN counts as missing."""
    casted = df.select(*[col(i) for i in ids],
                       *[col(c).cast("double").alias(c) for c in cols])
    long = casted.unpivot(list(ids), list(cols), name, value)
    if drop_missing:
        long = long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    return long


def _bounds(df: DataFrame, keys: list, lead: str, b: int) -> DataFrame:
    """Per key an ascending array ``_bounds`` that cuts ``lead``'s values into about ``b`` buckets.

    Numbers: a quantile sketch. Strings: a hash sample of at most BOUND_SAMPLE values a key, so a
    common prefix does not matter. The bounds decide where work is cut, never the result.
    """
    if not isinstance(df.schema[lead].dataType, T.StringType):
        return df.groupBy(*keys).agg(F.percentile_approx(lead, [i / b for i in range(1, b)], 10000).alias("_bounds"))
    place = F.xxhash64(lead)
    sample = top_k(df.select(*keys, lead, place.alias("_place")), keys, [F.col("_place"), F.col(lead)], BOUND_SAMPLE,
                   salt_on="_place", rank_col="_rank")
    return sample.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.collect_list(lead))).alias("_bounds"))


def _tagged(df: DataFrame, keys: list, lead: str, b: int) -> DataFrame:
    """``df`` with ``_bucket``, monotone in ``lead`` within a key."""
    return keyed_join(df, _bounds(df, keys, lead, b), keys, lead, "left") \
        .withColumn("_bucket", F.size(F.filter(F.col("_bounds"), lambda x: x < F.col(lead)))).drop("_bounds")


def running_totals(df: DataFrame, keys: Sequence[str], order, weights: Sequence[str],
                   n_buckets: int | None = None, suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``weights`` in ``order`` within each key.

    ``order`` is a column name or a list of names (lexicographic); rows must be
    unique per ``(keys, order)`` (pre-aggregate first). Buckets are cut on the
    first order column, so equal leading values share a bucket and the
    lexicographic order inside it stays exact. Adds ``<w><suffix>`` per weight.
    """
    keys = list(keys)
    orders = [order] if isinstance(order, str) else list(order)
    tagged = _tagged(df, keys, orders[0], n_buckets or _default_buckets(df))
    local_w = (Window.partitionBy(*keys, "_bucket").orderBy(*orders)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for w in weights:
        tagged = tagged.withColumn(f"_{w}_local", F.sum(w).over(local_w))
    totals = tagged.groupBy(*keys, "_bucket").agg(*[F.sum(w).alias(f"_{w}_bt") for w in weights])
    prev_w = (Window.partitionBy(*keys).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"_{w}_bt").over(prev_w), F.lit(0)).alias(f"_{w}_off") for w in weights])
    out = tagged.join(offsets, keys + ["_bucket"], "left")
    for w in weights:
        out = out.withColumn(f"{w}{suffix}", F.col(f"_{w}_local") + F.col(f"_{w}_off"))
    return out.drop("_bucket", *[f"_{w}_local" for w in weights], *[f"_{w}_off" for w in weights])


def row_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank",
              n_buckets: int | None = None) -> DataFrame:
    """1-based ``row_number`` within keys by a unique lexicographic order, without a hot task."""
    ranked = running_totals(df.withColumn("_one", F.lit(1)), keys, list(order), ["_one"], n_buckets)
    return ranked.withColumnRenamed("_one_cum", name).drop("_one")


def dense_codes(df: DataFrame, column: str, code: str, n_buckets: int | None = None) -> DataFrame:
    """0-based dense rank of each distinct value of ``column`` (code-point order), as a
    ``(column, code)`` mapping built from the distinct values -- nothing goes to the driver."""
    distinct = df.select(F.col(column)).where(F.col(column).isNotNull()).distinct()
    ranked = row_ranks(distinct, [], [column], "_r", n_buckets)
    return ranked.select(column, (F.col("_r") - 1).cast("double").alias(code))


def _bucketed(df: DataFrame, keys: list, lead_name: str, weight: str, n_buckets: int | None):
    """Tag rows with a value bucket (monotone in ``lead_name``) and return
    ``(tagged, offsets)`` where ``offsets`` holds, per (keys, bucket), the bucket's
    total weight and the total weight of all earlier buckets (keys x buckets rows)."""
    tagged = _tagged(df, keys, lead_name, n_buckets or max(_default_buckets(df), 64))
    bw = tagged.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_bw"))
    prev = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bw.withColumn("_off", F.coalesce(F.sum("_bw").over(prev), F.lit(0)))
    return tagged, offsets


def exact_quantiles(long: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float], n_buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (NumPy/pandas default, DuckDB ``quantile_cont``).

    ``long`` holds ``keys..., value`` with missing values already removed.
    Returns ``keys..., p double, q double`` (one row per key and probability).
    """
    keys = list(keys)
    counted = long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"))
    return weighted_quantiles(counted, keys, value, "_w", probs, n_buckets)


def column_quantiles(df: DataFrame, cols: Sequence[str], named_probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of numeric columns, missing values left out: ``column_name`` and a column per named probability.

    Three scans of the columns side by side: a sketch puts two bounds closely around each quantile, the values up to each
    bound are counted, and only the values of those buckets that hold a needed rank are shuffled, as distinct values with
    their counts. A poor sketch makes those buckets larger, never the result wrong.
    """
    cols, probs = list(cols), list(named_probs.values())
    casted = [col(c).cast("double") for c in cols]
    values = df.select(*[F.when(~F.isnan(c), c).alias(f"v{i}") for i, c in enumerate(casted)])
    around = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-AROUND, AROUND)})
    bounds = values.agg(*[F.percentile_approx(f"v{i}", around, SKETCH).alias(f"b{i}") for i in range(len(cols))])
    bounded = values.crossJoin(F.broadcast(bounds))  # one row
    upto = bounded.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(cols))], *[
        F.count_if(F.col(f"v{i}") <= F.get(f"b{i}", F.lit(j))).alias(f"c{i}_{j}") for i in range(len(cols)) for j in range(len(around))])
    cells = []
    for i in range(len(cols)):
        ends = [F.lit(0).cast("long"), *[F.col(f"c{i}_{j}") for j in range(len(around))], F.col(f"n{i}")]
        cells += [F.struct(F.lit(cols[i]).alias("column_name"), F.lit(j).alias("_bucket"), (y - x).alias("_bw"), x.alias("_off"))
                  for j, (x, y) in enumerate(zip(ends, ends[1:]))]
    offsets = upto.select(F.explode(F.array(*cells)).alias("r")).select("r.*").where("_bw > 0")

    def choose(need):
        one = need.agg(*[F.collect_set(F.when(F.col("column_name") == c, F.col("_bucket"))).alias(f"need{i}") for i, c in enumerate(cols)])
        found = []
        for i in range(len(cols)):
            bucket = sum(((F.get(f"b{i}", F.lit(j)) < F.col(f"v{i}")).cast("int") for j in range(len(around))), F.lit(0))
            found += [F.when(F.array_contains(f"need{i}", bucket), x).alias(f"{n}{i}") for n, x in (("k", bucket), ("v", F.col(f"v{i}")))]
        pairs = ", ".join(f"(k{i}, v{i}) AS `{i}`" for i in range(len(cols)))
        rows = df.sparkSession.sql(f"SELECT CAST(i AS INT) AS i, _bucket, value FROM {{found}} UNPIVOT ((_bucket, value) FOR i IN ({pairs}))",
                                   found=bounded.crossJoin(F.broadcast(one)).select(*found))
        counted = rows.groupBy("i", "_bucket", "value").agg(F.count(F.lit(1)).alias("_w"))
        return counted.withColumn("column_name", F.get(F.array(*[F.lit(c) for c in cols]), F.col("i"))).drop("i")
    return _named(_located_quantiles(choose, offsets, ["column_name"], "value", probs), ["column_name"], named_probs)


def weighted_quantiles(counted: DataFrame, keys: Sequence[str], value: str, weight: str,
                       probs: Sequence[float], n_buckets: int | None = None) -> DataFrame:
    """Exact quantiles of a distribution given as distinct ``value`` rows with integer
    multiplicities ``weight`` (rows with weight 0 are ignored).

    Values are bucketed by an approximate sketch, bucket totals locate the bucket holding each
    needed rank, and only those buckets (at most two per probability) are sorted.
    """
    keys = list(keys)
    counted = counted.where(F.col(weight) > 0)
    counted = counted.withColumnRenamed(weight, "_w") if weight != "_w" else counted
    tagged, offsets = _bucketed(counted, keys, value, "_w", n_buckets)

    def choose(need):
        return tagged.join(F.broadcast(need) if set(keys) <= NAMED_KEYS else need, keys + ["_bucket"], "left_semi")
    return _located_quantiles(choose, offsets, keys, value, probs)


def _located_quantiles(choose, offsets: DataFrame, keys: list, value: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles from buckets of values: ``offsets`` (keys, _bucket, weight _bw, weight before it _off), and ``choose``, which
    gives the distinct values with weights (keys, _bucket, value, _w) of the buckets that hold a needed rank."""
    sizes = offsets.groupBy(*keys).agg(F.sum("_bw").alias("_n"))
    targets = sizes.select(*keys, F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"), "_n") \
        .withColumn("_pos", F.col("p") * (F.col("_n") - 1))
    ranks = targets.select(*keys, "p", "_pos", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))).alias("_r")) \
        .distinct()
    # which bucket holds each rank: offsets is keys x buckets rows
    where = (ranks.join(offsets, keys) if keys else ranks.crossJoin(F.broadcast(offsets))).where((F.col("_r") >= F.col("_off")) & (F.col("_r") < F.col("_off") + F.col("_bw"))) \
        .select(*keys, "p", "_pos", "_r", "_bucket", "_off")
    need = where.select(*keys, "_bucket").distinct()
    chosen = choose(need)
    w = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = chosen.withColumn("_c", F.sum("_w").over(w))
    hit = local.join(where, keys + ["_bucket"]) \
        .where((F.col("_r") >= F.col("_off") + F.col("_c") - F.col("_w")) & (F.col("_r") < F.col("_off") + F.col("_c")))
    agg = hit.groupBy(*keys, "p").agg(
        F.max(F.when(F.col("_r") == F.floor("_pos"), F.col(value))).alias("_v0"),
        F.max(F.when(F.col("_r") == F.ceil("_pos"), F.col(value))).alias("_v1"),
        F.first("_pos").alias("_pos"))
    frac = F.col("_pos") - F.floor("_pos")
    return agg.select(*keys, "p", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * frac).alias("q"))


def first_k_flag(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: F.Column | str,
                 name: str, n_buckets: int | None = None, levels: int = 2) -> DataFrame:
    """Flag the first ``k`` rows per key in a unique lexicographic ``order``.

    Exact without sorting everything: bucket totals decide whole buckets; the bucket that straddles
    rank ``k`` is cut into buckets again (``levels`` times in all) and only the last straddling one,
    n / buckets^levels rows, is sorted. ``k`` is a column of ``df`` (constant within a key) or a Column."""
    keys, order = list(keys), list(order)
    kc = k if isinstance(k, F.Column) else F.col(k)
    base = df.withColumn("_k", kc).withColumn("_one", F.lit(1))
    tagged, offsets = _bucketed(base, keys, order[0], "_one", n_buckets)
    kk = base.groupBy(*keys).agg(F.max("_k").alias("_kk"))
    cls = (offsets.join(kk, keys) if keys else offsets.crossJoin(F.broadcast(kk))).select(
        *keys, "_bucket", "_off",
        F.when(F.col("_off") + F.col("_bw") <= F.col("_kk"), F.lit("in"))
         .when(F.col("_off") >= F.col("_kk"), F.lit("out")).otherwise(F.lit("split")).alias("_cls"))
    t = tagged.join(cls, keys + ["_bucket"])
    edge = t.where(F.col("_cls") == "split")
    rest = t.where(F.col("_cls") != "split").withColumn(name, F.col("_cls") == "in")
    if levels > 1:
        left = edge.withColumn("_left", F.col("_k") - F.col("_off")).drop("_k", "_one", "_bucket", "_off", "_cls")
        edge = first_k_flag(left, keys, order, "_left", name, n_buckets, levels - 1).drop("_left")
    else:
        w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
        edge = edge.withColumn(name, F.col("_off") + F.row_number().over(w) <= F.col("_k")) \
            .drop("_k", "_one", "_bucket", "_off", "_cls")
    return edge.unionByName(rest.drop("_k", "_one", "_bucket", "_off", "_cls"))


def quantile_columns(long: DataFrame, keys: Sequence[str], value: str,
                     named_probs: dict[str, float], exact: bool = True,
                     accuracy: int = 100000) -> DataFrame:
    """Wide form: one row per key with one column per named probability."""
    keys = list(keys)
    if not exact:
        arr = F.percentile_approx(F.col(value), list(named_probs.values()), accuracy)
        return long.groupBy(*keys).agg(arr.alias("_qs")).select(
            *keys, *[F.col("_qs")[i].alias(n) for i, n in enumerate(named_probs)])
    return _named(exact_quantiles(long, keys, value, list(named_probs.values())), keys, named_probs)


def _named(qs: DataFrame, keys: list, named_probs: dict[str, float]) -> DataFrame:
    return qs.groupBy(*keys).agg(*[
        F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(n)
        for n, p in named_probs.items()])


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence, k: int,
          salt_buckets: int = 64, salt_on: str | None = None, rank_col: str = "rank") -> DataFrame:
    """Exact top-k per group in two stages so a hot group never lands in one task.

    Stage 1 keeps k rows per ``(group, salt)``; stage 2 ranks the at most
    ``k * salt_buckets`` survivors per group. ``order`` is a list of Columns.
    """
    groups = list(groups)
    # deterministic salt (re-executed tasks must see the same split)
    salt_src = [F.col(salt_on)] if salt_on else [col(c) for c in df.columns]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*groups, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*groups).orderBy(*order)
    return stage1.withColumn(rank_col, F.row_number().over(w2).cast("long")).where(F.col(rank_col) <= k) \
        .drop("_salt", "_r1")
