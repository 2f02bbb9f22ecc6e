"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are shares of character kinds, word lengths and
repeated words, its own and those of the lines before and after it; transition weights join neighbouring
labels. Forward-backward gives each line's marginal probability of being good; their mean, weighted
by the lines' lengths, is the document's raw quality. A one-variable logistic curve, fitted on the same
sample, turns it into the probability that the document's label is 1.

Fitting: line labels are those of their documents; the likelihood is maximised by Adam on a sample of at
most 2 * rows_per_class documents of each label, of longer ones a run of ``fit_lines`` lines that begins anywhere (documented
bounds), so a label is learnt whatever the length of its documents. Both labels weigh alike in the random field; the curve is fitted with the labels' own shares. Whole texts are
scored, however many lines they have.

Null and empty texts are one empty line. Without labelled rows every score is 0.5; with one label
only, it is that label. A document that carries both labels is not learnt from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fitting_sample, fold, slices, text_buffers, word_hashes

ROWS_PER_CLASS, FIT_LINES, STEPS, RATE, L2 = 2000, 512, 150, 0.1, 1e-3

# ---------------------------------------------------------------- features of lines

_KINDS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 space, 5 full stop or comma, 6 other ASCII sign
_KINDS[33:127] = 6
_KINDS[97:123] = 1
_KINDS[128:] = 1
_KINDS[65:91] = 2
_KINDS[48:58] = 3
_KINDS[[32, 9, 11, 12, 13]] = 4
_KINDS[[46, 44, 39]] = 5
OWN = 11
WIDTH = 1 + 3 * OWN


def line_table(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths in bytes, first line of each document and the end) of some documents' lines."""
    docs = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    # a line ends at a line feed or at its document's end
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    per_doc = np.bincount(owner, minlength=docs) + 1 if len(breaks) else np.ones(docs, np.int64)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    lines = int(first[-1])
    # documents that begin where a line feed of the one before ends: order by document keeps both
    stop = np.empty(lines, np.int64)
    stop[:-1] = start[1:]
    stop[first[1:] - 1] = offsets[1:]
    inner = np.ones(lines, bool)
    inner[first[1:] - 1] = False
    stop[inner] -= 1
    size = stop - start
    counts = np.empty((lines, 7), np.float64)
    kinds = _KINDS[raw]
    for k in range(1, 7):
        sums = np.concatenate([[0], np.cumsum(kinds == k)])
        counts[:, k] = sums[stop] - sums[start]
    words, line = word_hashes(raw, np.concatenate([start, [len(raw)]]))
    n = np.bincount(line, minlength=lines).astype(np.float64)
    again = np.bincount(line[1:][(words[1:] == words[:-1]) & (line[1:] == line[:-1])], minlength=lines)
    order = np.lexsort((words, line))
    w, o = words[order], line[order]
    known = np.bincount(o[1:][(w[1:] == w[:-1]) & (o[1:] == o[:-1])], minlength=lines)
    chars, some = np.maximum(size, 1), np.maximum(n, 1)
    share = counts[:, 1:] / chars[:, None]
    signs = np.minimum(counts[:, 6] / some, 4) / 4
    own = np.column_stack([
        share[:, 1], share[:, 2], share[:, 3], signs, np.sqrt(share[:, 5]), np.minimum(counts[:, 4] / some, 2) / 2,
        np.minimum(chars / some, 40) / 20, again / some, (known / some) * np.minimum(n, 50) / 50,
        np.log1p(size) / 8, (size == 0).astype(np.float64)])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack([np.ones((lines, 1)), own, before, after]), size, first


# ---------------------------------------------------------------- the chain

def marginals(node: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """(marginals of label 1, expected pair counts summed over each chain's pairs, log Z by chain).

    ``node``: scores of both labels by line; chains are lines first[i]..first[i+1]. All chains move one
    line at a time together, longest first, so a step works on those that still have a line.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, left = first[:-1][order], count[order]
    top = node.max(1)
    phi = np.exp(node - top[:, None])
    step = np.exp(trans)
    alpha, scale = np.empty_like(phi), np.empty(len(phi))
    longest = int(left[0]) if len(left) else 0
    active = [int(np.searchsorted(-left, -t, side="left")) for t in range(longest)]  # chains with more than t lines
    for t in range(longest):
        at = begin[:active[t]] + t
        a = phi[at] if t == 0 else (alpha[at - 1] @ step) * phi[at]
        s = a.sum(1)
        alpha[at], scale[at] = a / s[:, None], s
    beta = np.ones_like(phi)
    pairs = np.zeros((len(first) - 1, 2, 2))
    for t in range(longest - 1, 0, -1):
        at = begin[:active[t]] + t
        after = phi[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = after @ step.T
        pairs[order[:active[t]]] += alpha[at - 1][:, :, None] * step[None] * after[:, None, :]
    good = alpha * beta
    good = good[:, 1] / good.sum(1)
    logz = np.add.reduceat(np.log(scale) + top, first[:-1]) if len(first) > 1 else np.zeros(0)
    return good, pairs, logz


class Model:
    """Weights of the random field (label 1 against label 0) and of the curve."""

    def __init__(self, constant: float | None = None):
        self.constant = constant

    def fit(self, x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, share: float):
        y = np.repeat(label, np.diff(first))
        weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
        line_weight = np.repeat(weight, np.diff(first))
        self.mean, self.dev = x.mean(0), x.std(0) + 1e-6
        self.mean[0], self.dev[0] = 0, 1
        x = (x - self.mean) / self.dev
        w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
        state = [np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)]
        seen = np.zeros((2, 2))
        for v in (0, 1):
            seen[v, v] = (weight * (np.diff(first) - 1))[label == v].sum()
        lines = line_weight.sum()
        for i in range(1, STEPS + 1):
            node = np.column_stack([np.zeros(len(x)), x @ w])
            good, pairs, _ = marginals(node, trans, first)
            g = np.concatenate([x.T @ (line_weight * (y - good)), (seen - (weight[:, None, None] * pairs).sum(0)).ravel()]) / lines
            g -= L2 * np.concatenate([w, trans.ravel()])
            state[0] = 0.9 * state[0] + 0.1 * g
            state[1] = 0.999 * state[1] + 0.001 * g * g
            move = RATE * state[0] / (1 - 0.9 ** i) / (np.sqrt(state[1] / (1 - 0.999 ** i)) + 1e-8)
            w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
        self.w, self.trans = w, trans
        q = self.raw(x, size, first, scaled=True)
        # the curve: Newton steps of a logistic regression on q with the labels' own shares
        balance = np.where(label == 1, share / max(label.mean(), 1e-9), (1 - share) / max(1 - label.mean(), 1e-9))
        z, c = np.column_stack([q, np.ones(len(q))]), np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-(z @ c)))
            h = (z * (balance * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
            c = c + np.clip(np.linalg.solve(h, z.T @ (balance * (label - p)) - 1e-2 * c), -4, 4)
        self.curve = c
        return self

    def raw(self, x, size, first, scaled=False) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, by document."""
        x = x if scaled else (x - self.mean) / self.dev
        good, _, _ = marginals(np.column_stack([np.zeros(len(x)), x @ self.w]), self.trans, first)
        weight = size + 1.0
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        q = self.raw(*line_table(raw, offsets))
        return 1 / (1 + np.exp(-(q * self.curve[0] + self.curve[1])))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, fit_lines: int = FIT_LINES) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    known = (labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
             .filter("quality = other and doc_id is not null"))
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Model(0.5)
    if len(shares) == 1:
        return Model(float(next(iter(shares))))
    wanted = fitting_sample(known.select("doc_id", "quality"), "quality", "doc_id", rows_per_class)
    sample = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
              .join(F.broadcast(wanted), "doc_id")  # at most 4 * rows_per_class ids
              .dropDuplicates(["doc_id"]))

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                x, size, first = line_table(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                # of a longer document, a run of fit_lines lines that begins anywhere; its lines keep their neighbours' features
                spare = np.maximum(np.diff(first) - fit_lines, 0)
                begin = first[:-1] + (np.add.reduceat(size, first[:-1]) * 2654435761 >> 8) % (spare + 1)
                ends = begin + np.minimum(np.diff(first), fit_lines)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2),
                    pa.array([x[i:j].astype("<f4").tobytes() for i, j in zip(begin, ends)], pa.binary()),
                    pa.array([size[i:j].astype("<i8").tobytes() for i, j in zip(begin, ends)], pa.binary())],
                    ["doc_id", "quality", "x", "size"])

    schema = T.StructType([sample.schema["doc_id"], sample.schema["quality"], T.StructField("x", T.BinaryType()),
                           T.StructField("size", T.BinaryType())])
    rows = sorted(sample.select("doc_id", "text", "quality").mapInArrow(run, schema).collect(), key=lambda r: r["doc_id"])
    if len({r["quality"] for r in rows}) < 2:
        return Model(float(rows[0]["quality"]) if rows else 0.5)
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH) for r in rows]).astype(np.float64)
    size = np.concatenate([np.frombuffer(r["size"], "<i8") for r in rows])
    first = np.concatenate([[0], np.cumsum([len(r["size"]) // 8 for r in rows])])
    return Model().fit(x, size, first, np.array([r["quality"] for r in rows]), shares[1] / (shares[0] + shares[1]))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of label 1 in column ``out`` (replaced if there); no shuffle."""
    fields = [f for f in df.schema.fields if f.name != out]
    keep = [f.name for f in fields]
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches):
        model = shared.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            found = [model.scores(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in slices(offsets)]
            rest = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.concatenate(found) if found else np.zeros(0))], [*keep, out])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out and score, learnt from the labels of the other folds."""
    model = fit(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    return score(docs.withColumn("held_out", fold(F.col("doc_id"), 3) == 1), model)


def op4(spark, sf_dir: str) -> DataFrame:
    """op4: the quality of every document; the scoring is one narrow stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
