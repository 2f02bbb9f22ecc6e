"""Streaming drift (D-13): KS, PSI and JS distance per event-time window against a
reference table, on Structured Streaming.

State is only bin counts per (window, feature, bin) -- never raw values.
Reference bins are static DataFrames joined to the stream (stream-static join):

* PSI: the reference's distinct deciles (as in batch drift);
* JS: 20 equal-width bins over the reference range (a window's own range is
  not known until it closes; values outside the range go to the edge bins);
* KS: the reference's distinct 1/128 quantiles. Counts below each edge give both distribution functions at the edges
  exactly, so the statistic is the greatest difference there: a sketch that merges by adding, never above the exact
  statistic and below it by no more than the reference's share between two edges (1/128 without ties). It is the third
  vote, as in batch drift.

``window_bin_counts`` is the streaming aggregation (watermark + tumbling window). It runs in update
mode: each micro-batch writes the counts that changed into a folder of its own (overwritten if the
batch runs again), so every window has rows from its first event on, the last one included.
``DriftStream.result`` takes each count's latest value and turns them into rows with the
function that the batch twin ``window_drift`` uses. ``DriftStream.compact`` rewrites the folders of finished batches as
one with each count's latest value. The reference's bins and counts are computed once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, ks_pvalue, rnd
from ..operators.order_stats import exact_quantiles, to_long
from ..session import ensure_checkpoint_dir, materialize

PSI_BINS = 10
JS_BINS = 20
KS_BINS = 128
KS_P = 0.05
JS_EPS = 1e-10
#: Votes of KS, PSI and JS that flag drift, as in batch.
VOTES = 2


def reference_bins(reference: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per feature: PSI edges (distinct deciles), KS edges, JS range, number of reference rows."""
    long = to_long(reference, cols, name="feature")
    deciles, fine = [i / PSI_BINS for i in range(PSI_BINS + 1)], [i / KS_BINS for i in range(1, KS_BINS)]
    qs = exact_quantiles(long, ["feature"], "value", sorted({*deciles, *fine}))

    def edges_at(probs, name):
        return F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("p").isin(probs), F.col("q"))))).alias(name)
    edges = qs.groupBy("feature").agg(edges_at(deciles, "edges"), edges_at(fine, "ks_edges"))
    rng = long.groupBy("feature").agg(F.count(F.lit(1)).alias("ref_n"), F.min("value").alias("_mn"),
                                      F.max("value").alias("_mx"))
    same = F.col("_mn") == F.col("_mx")
    rng = rng.select("feature", "ref_n", F.when(same, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
                     F.when(same, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"))
    return edges.join(rng, "feature")


def _bin_exprs():
    v = F.col("value")
    nb = F.size("edges") - 1
    in_psi = (nb >= 2) & (v >= F.col("edges")[0]) & (v <= F.element_at("edges", -1))
    psi_bin = F.when(in_psi, F.least(F.size(F.filter("edges", lambda e: e <= v)) - 1, nb - 1))
    js_bin = F.least(F.lit(JS_BINS - 1), F.greatest(F.lit(0),
                     F.floor((v - F.col("lo")) * JS_BINS / (F.col("hi") - F.col("lo"))).cast("int")))
    ks_bin = F.size(F.filter("ks_edges", lambda e: e < v))  # at most j edges lie below: the value is no more than edge j
    return psi_bin, js_bin, ks_bin


def _tag(df: DataFrame, bins: DataFrame, ts: str, cols: Sequence[str]) -> DataFrame:
    cast = df.select(col(ts).cast("timestamp").alias("event_time"), *[col(c).cast("double").alias(c) for c in cols])
    long = cast.unpivot(["event_time"], list(cols), "feature", "value") \
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    psi_bin, js_bin, ks_bin = _bin_exprs()
    tagged = long.join(F.broadcast(bins.select("feature", "edges", "ks_edges", "lo", "hi")), "feature")  # k rows: static side
    return tagged.select("event_time", "feature",
                         F.explode(F.array(F.struct(F.lit("psi").alias("kind"), psi_bin.alias("bin")),
                                           F.struct(F.lit("js").alias("kind"), js_bin.alias("bin")),
                                           F.struct(F.lit("ks").alias("kind"), ks_bin.alias("bin")))).alias("b")) \
        .select("event_time", "feature", "b.kind", "b.bin").where(F.col("bin").isNotNull())


def window_bin_counts(stream: DataFrame, bins: DataFrame, ts: str, cols: Sequence[str],
                      window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Streaming (or batch) counts per (window, feature, kind, bin) plus rows per window."""
    tagged = _tag(stream, bins, ts, cols)
    return tagged.withWatermark("event_time", delay) \
        .groupBy(F.window("event_time", window).alias("w"), "feature", "kind", "bin") \
        .agg(F.count(F.lit(1)).alias("n")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "feature", "kind", "bin", "n")


def reference_counts(reference: DataFrame, bins: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Reference rows per (feature, kind, bin)."""
    return _tag(reference.withColumn("_t", F.lit(0).cast("timestamp")), bins, "_t", cols) \
        .groupBy("feature", "kind", "bin").agg(F.count(F.lit(1)).alias("ref_c"))


def window_drift_from_counts(counts: DataFrame, bins: DataFrame, ref_counts: DataFrame) -> DataFrame:
    """KS, PSI and JS per (window, feature) from window counts."""
    keys = ["window_start", "window_end", "feature"]
    win_n = counts.where(F.col("kind") == "js").groupBy(*keys).agg(F.sum("n").alias("cur_n"))
    nb = F.size("edges") - 1
    grid = win_n.join(bins, "feature")
    psi_grid = grid.where(nb >= 2).select(*keys, "cur_n", "ref_n", nb.alias("nb"),
                                          F.explode(F.sequence(F.lit(0), nb - 1)).alias("bin"))
    psi_c = counts.where(F.col("kind") == "psi").select(*keys, "bin", "n")
    psi_ref = ref_counts.where(F.col("kind") == "psi").select("feature", "bin", "ref_c")
    pq = psi_grid.join(psi_c, keys + ["bin"], "left").join(psi_ref, ["feature", "bin"], "left").select(
        *keys, ((F.coalesce("ref_c", F.lit(0)) + 1) / (F.col("ref_n") + F.col("nb"))).alias("p"),
        ((F.coalesce("n", F.lit(0)) + 1) / (F.col("cur_n") + F.col("nb"))).alias("q"))
    psi = pq.groupBy(*keys).agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))
    js_grid = grid.select(*keys, "cur_n", "ref_n", F.explode(F.sequence(F.lit(0), F.lit(JS_BINS - 1))).alias("bin"))
    js_c = counts.where(F.col("kind") == "js").select(*keys, "bin", "n")
    js_ref = ref_counts.where(F.col("kind") == "js").select("feature", "bin", "ref_c")
    d = js_grid.join(js_c, keys + ["bin"], "left").join(js_ref, ["feature", "bin"], "left").select(
        *keys, (F.coalesce("ref_c", F.lit(0)) / F.col("ref_n") + JS_EPS).alias("p"),
        (F.coalesce("n", F.lit(0)) / F.col("cur_n") + JS_EPS).alias("q"))
    wk = Window.partitionBy(*keys)  # 20 rows per (window, feature)
    d = d.select(*keys, (F.col("p") / F.sum("p").over(wk)).alias("p"), (F.col("q") / F.sum("q").over(wk)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    js = d.groupBy(*keys).agg(F.sqrt((F.sum(F.col("p") * F.log(F.col("p") / m))
                                      + F.sum(F.col("q") * F.log(F.col("q") / m))) / 2).alias("js"))
    ks_c = counts.where(F.col("kind") == "ks").select(*keys, "bin", "n")
    ks_ref = ref_counts.where(F.col("kind") == "ks").select("feature", "bin", "ref_c")
    at_edges = grid.select(*keys, "cur_n", "ref_n", F.explode(F.sequence(F.lit(0), F.size("ks_edges") - 1)).alias("bin"))
    so_far = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # 127 rows at most
    ks = at_edges.join(ks_c, keys + ["bin"], "left").join(ks_ref, ["feature", "bin"], "left").select(
        *keys, "cur_n", "ref_n", F.sum(F.coalesce("n", F.lit(0))).over(so_far).alias("c"), F.sum(F.coalesce("ref_c", F.lit(0))).over(so_far).alias("r"))
    ks = ks.groupBy(*keys, "cur_n", "ref_n").agg(F.max(F.abs(F.col("c") / F.col("cur_n") - F.col("r") / F.col("ref_n"))).alias("ks"))
    ks = ks.select(*keys, "ks", ks_pvalue(F.col("ks"), F.col("ref_n"), F.col("cur_n")).alias("p"))
    out = win_n.join(js, keys).join(ks, keys).join(psi, keys, "left")
    return out.select(*keys, F.col("cur_n").alias("n_current"), rnd(F.col("ks")).alias("ks_statistic"), rnd(F.col("p"), 6).alias("ks_pvalue"),
                      rnd(F.coalesce("psi", F.lit(0.0))).alias("psi"), rnd(F.col("js")).alias("js_distance"),
                      ((F.col("p") < KS_P).cast("int") + (F.coalesce("psi", F.lit(0.0)) > 0.1).cast("int")
                       + (F.col("js") > 0.05).cast("int") >= VOTES).alias("drift_flag"))


def window_drift(current: DataFrame, reference: DataFrame, ts: str, cols: Sequence[str],
                 window: str = "1 day") -> DataFrame:
    """Batch twin of the streaming operator (same counting and formulas)."""
    bins = reference_bins(reference, cols)
    counts = window_bin_counts(current, bins, ts, cols, window, delay="0 seconds")
    return window_drift_from_counts(counts, bins, reference_counts(reference, bins, cols))


class DriftStream(NamedTuple):
    """A running monitor: the query, the folder of its counts, the reference's bins and counts."""
    query: object
    path: str
    bins: DataFrame
    ref_counts: DataFrame

    def latest(self) -> DataFrame:
        """Each count's latest value."""
        key = ["window_start", "window_end", "feature", "kind", "bin"]
        kinds = "window_start timestamp, window_end timestamp, feature string, kind string, bin int, n long, batch_id long"
        seen = self.bins.sparkSession.read.schema(kinds).parquet(self.path)
        return seen.groupBy(*key).agg(F.max_by("n", "batch_id").alias("n"))

    def result(self) -> DataFrame:
        """KS, PSI and JS of every (window, feature) that has events so far."""
        return window_drift_from_counts(self.latest(), self.bins, self.ref_counts)

    def compact(self) -> None:
        """Rewrite the counts of a stopped monitor as one folder, under the number of its last batch; the others are removed
        once it is there, so a monitor that is interrupted in between loses nothing."""
        spark = self.bins.sparkSession
        jvm = spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(base) if f.getPath().getName().startswith("batch_id="))
        if len(done) < 2:
            return
        merged = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_merged")  # not read: the name begins with an underscore
        self.latest().write.mode("overwrite").parquet(merged.toString())
        last = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch_id={done[-1]}")
        fs.delete(last, True)
        fs.rename(merged, last)
        for batch in done[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch_id={batch}"), True)


def drift_stream(stream: DataFrame, reference: DataFrame, ts: str, cols: Sequence[str], window: str = "1 day",
                 delay: str = "1 hour", path: str | None = None, available_now: bool = True) -> DriftStream:
    """Start the streaming drift monitor under ``path`` (a shared folder: counts and checkpoint; the same path
    resumes a stopped monitor). Default: a fresh folder in the session's checkpoint directory."""
    base = (path or ensure_checkpoint_dir(stream.sparkSession).rstrip("/") + f"/drift-stream-{uuid.uuid4().hex}").rstrip("/")
    bins = materialize(reference_bins(reference, cols))
    ref_counts = materialize(reference_counts(reference, bins, cols))
    counts = window_bin_counts(stream, bins, ts, cols, window, delay)

    def sink(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{base}/counts/batch_id={batch_id}")
    writer = counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", base + "/checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return DriftStream(writer.start(), base + "/counts", bins, ref_counts)
