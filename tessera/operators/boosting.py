"""Second-order gradient boosting (M-5, M-10): Newton steps on gradient and hessian histograms.

Features are cut at no more than ``bins`` quantiles of the training rows. A tree grows level by level: one scan a level adds up
gradients and hessians by (node, feature, bin), and the best split of each node is taken where

    GL^2 / (HL + lam) + GR^2 / (HR + lam) - G^2 / (H + lam)

is largest and above 2 * gamma, with at least ``min_child`` of hessian on both sides; ties go to the smaller feature, then the
smaller cut. A leaf adds ``eta * -G / (H + lam)``. The histogram has at most 2^depth * features * bins rows, whatever the table;
only the splits, a few numbers a node, come to the driver, where the model is kept. Margins are checkpointed once a tree.

Squared error starts at the mean, the logistic loss at the log odds. More than two classes are one model a class against the
rest, with probabilities scaled to one. Null and NaN features go left. Without training rows, or with one class, the model is
the constant start.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

ROUNDS, DEPTH, ETA, LAM, GAMMA, MIN_CHILD, BINS = 100, 6, 0.3, 1.0, 0.0, 1.0, 64


@dataclass
class Tree:
    """Splits (node -> feature, cut, value of the left child, value of the right child); the root is 1, children 2n, 2n + 1."""

    splits: dict[int, tuple[int, float, float, float]] = field(default_factory=dict)

    def value(self, x: Column) -> Column:
        """The row's leaf value as an expression over its features."""
        def at(node: int, value: float):
            if node not in self.splits:
                return F.lit(value)
            f, cut, left, right = self.splits[node]
            return F.when(_right(x[f], cut), at(2 * node + 1, right)).otherwise(at(2 * node, left))
        return at(1, 0.0)

    def node(self, x: Column, depth: int) -> Column:
        """The node of ``depth`` that the row has come to, null if its leaf is above."""
        def at(node: int, level: int):
            if level == depth:
                return F.lit(node)
            if node not in self.splits:
                return F.lit(None).cast("int")
            f, cut, _, _ = self.splits[node]
            return F.when(_right(x[f], cut), at(2 * node + 1, level + 1)).otherwise(at(2 * node, level + 1))
        return at(1, 0)

    def values(self, x: np.ndarray) -> np.ndarray:
        node, out = np.ones(len(x), np.int64), np.zeros(len(x))
        open_ = np.full(len(x), bool(self.splits))
        while open_.any():
            for n in np.unique(node[open_]).tolist():
                rows = np.flatnonzero(open_ & (node == n))
                if n not in self.splits:
                    open_[rows] = False
                    continue
                f, cut, left, right = self.splits[n]
                over = x[rows, f] > cut
                node[rows] = 2 * n + over
                out[rows] = np.where(over, right, left)
        return out


def _right(x: Column, cut: float) -> Column:
    return (x > cut) & ~F.isnan(x)


@dataclass
class Boosted:
    """Margins: the start plus the trees' values."""

    start: float
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.values(x) for t in self.trees), np.zeros(len(x)))


def _cuts(rows: DataFrame, d: int, bins: int) -> list[list[float]]:
    shares = [i / bins for i in range(1, bins)]
    one = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col("x")[j]), F.col("x")[j]), shares, 10000).alias(str(j)) for j in range(d)]).first()
    return [sorted(set(one[str(j)] or [])) for j in range(d)]


def _best(rows: DataFrame, cuts: list[list[float]], lam: float, min_child: float, gamma: float) -> list:
    """Of each node of ``rows`` (node, x, g, h): (node, f, cut number, sums of both sides) of its best split, if it has one."""
    bounds = F.array(*[F.array(*[F.lit(c) for c in own]).cast("array<double>") for own in cuts])
    bin_ = F.when(F.isnan("v") | F.col("v").isNull(), 0).otherwise(F.size(F.filter(bounds[F.col("f")], lambda c: c < F.col("v"))))
    sums = rows.select("node", "g", "h", F.posexplode("x").alias("f", "v")).select("node", "g", "h", "f", bin_.alias("bin")) \
        .groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    whole = Window.partitionBy("node", "f")
    so_far = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("node", "f", "bin", F.sum("g").over(so_far).alias("gl"), F.sum("h").over(so_far).alias("hl"), F.sum("g").over(whole).alias("g"),
                       F.sum("h").over(whole).alias("h")).withColumns({"gr": F.col("g") - F.col("gl"), "hr": F.col("h") - F.col("hl")})
    score = lambda g, h: F.col(g) * F.col(g) / (F.col(h) + lam)
    gain = score("gl", "hl") + score("gr", "hr") - score("g", "h")
    fits = (F.col("hl") >= min_child) & (F.col("hr") >= min_child) & (F.col("bin") < F.array(*[F.lit(len(c)) for c in cuts])[F.col("f")])
    best = sums.withColumn("gain", gain).where(fits & (F.col("gain") > 2 * gamma + 1e-12)).groupBy("node").agg(
        F.min(F.struct((-F.col("gain")).alias("loss"), "f", "bin", "gl", "hl", "gr", "hr")).alias("b"))
    return best.select("node", "b.f", "b.bin", "b.gl", "b.hl", "b.gr", "b.hr").collect()  # at most 2^depth rows


def fit(df: DataFrame, features: str, label: str, objective: str = "squared", rounds: int = ROUNDS, depth: int = DEPTH, eta: float = ETA,
        lam: float = LAM, gamma: float = GAMMA, min_child: float = MIN_CHILD, bins: int = BINS) -> Boosted:
    """``features``: array<double>; ``objective``: squared, or logistic for labels 0 and 1. Rows without a label are left out."""
    rows = df.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y")).where("y is not null and not isnan(y) and x is not null")
    about = rows.agg(F.avg("y").alias("mean"), F.max(F.size("x")).alias("d")).first()
    if about["mean"] is None:
        return Boosted(0.0, [])
    mean, d = about["mean"], about["d"]
    logistic = objective == "logistic"
    if logistic and not 0 < mean < 1:
        return Boosted(math.copysign(30.0, mean - 0.5), [])
    start = math.log(mean / (1 - mean)) if logistic else mean
    cuts, model = _cuts(rows, d, bins), Boosted(start, [])
    rows = materialize(rows.withColumn("m", F.lit(start)))
    p = 1 / (1 + F.exp(-F.col("m")))
    slopes = {"g": p - F.col("y"), "h": F.greatest(p * (1 - p), F.lit(1e-16))} if logistic else {"g": F.col("m") - F.col("y"), "h": F.lit(1.0)}
    for _ in range(rounds):
        tree = Tree()
        for level in range(depth):
            here = rows.withColumns({**slopes, "node": tree.node(F.col("x"), level)}).where("node is not null")
            found = _best(here, cuts, lam, min_child, gamma)
            for r in found:
                leaf = lambda g, h: -eta * g / (h + lam)
                tree.splits[r["node"]] = (r["f"], cuts[r["f"]][r["bin"]], leaf(r["gl"], r["hl"]), leaf(r["gr"], r["hr"]))
            if not found:
                break
        if not tree.splits:
            break
        model.trees.append(tree)
        rows = materialize(rows.withColumn("m", F.col("m") + tree.value(F.col("x"))))
    return model


def predict(df: DataFrame, models: Boosted | Sequence[Boosted], features: str, objective: str = "squared") -> DataFrame:
    """``df`` with ``prediction``: the margin, or the class (and ``probability``, an array) of one logistic model, or of one
    a class. A null feature array has a null prediction."""
    many = not isinstance(models, Boosted)
    shared = df.sparkSession.sparkContext.broadcast(list(models) if many else [models])  # the model: 2^depth numbers a tree
    new = {"prediction": T.DoubleType()} | ({} if objective == "squared" else {"probability": T.ArrayType(T.DoubleType())})
    keep = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*keep, *(T.StructField(k, v) for k, v in new.items()), T.StructField("_x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            xs = batch.column(batch.num_columns - 1)
            there = np.flatnonzero(np.asarray(xs.is_valid()))
            rows = [[math.nan if v is None else v for v in x] for x in xs.take(pa.array(there)).to_pylist()]
            x = np.array(rows, float).reshape(len(there), -1)
            m = np.stack([b.margins(x) for b in shared.value], axis=1) if len(there) else np.zeros((0, 1))
            columns = list(batch.columns)
            if objective == "squared":
                value = m[:, 0]
            else:
                p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
                p = p / p.sum(axis=1, keepdims=True) if many else np.hstack([1 - p, p])
                value = p.argmax(axis=1).astype(float)
                shares: list = [None] * len(xs)
                for i, own in zip(there.tolist(), p.tolist()):
                    shares[i] = own
                columns[-2] = pa.array(shares, pa.list_(pa.float64()))
            out = np.full(len(xs), np.nan)
            out[there] = value
            mask = np.ones(len(xs), bool)
            mask[there] = False
            columns[len(keep)] = pa.array(out, mask=mask)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    plain = df.select(*[f.name for f in keep], *[F.lit(None).cast(v).alias(k) for k, v in new.items()], F.col(features).cast("array<double>").alias("_x"))
    return plain.mapInArrow(run, schema).drop("_x")


def fit_classes(df: DataFrame, features: str, label: str, classes: int, **options) -> Boosted | list[Boosted]:
    """One logistic model for two classes (labels 0, 1), else one a class against the rest."""
    if classes <= 2:
        return fit(df, features, label, "logistic", **options)
    return [fit(df.withColumn("_own", (F.col(label) == k).cast("double")), features, "_own", "logistic", **options) for k in range(classes)]
