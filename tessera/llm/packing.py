"""Packing token sequences by Karmarkar-Karp multiway differencing.

Every document's tokens are cut into pieces. Runs of whole windows (``length`` tokens) of a long document
are sequences by themselves; what remains, and short documents, is cut into pieces of at most
``piece`` tokens. A batch of pieces is split into k windows by largest differencing: every piece starts as a
partial partition (its size in one window, zero in the others); the two partial partitions with
the largest imbalance are merged again and again, the fullest window of one meeting the emptiest of
the other, until one near-equal partition is left. k starts at what the batch's tokens need; whenever the
fullest window exceeds the capacity, k rises by one and the batch is split anew. No sequence spans two
batches, so a batch is all that a task holds.

The last batch of a task is differenced like the others, whatever its size. Its tokens are no multiple of the capacity, so
what exceeds whole windows, and ``SLACK`` tokens a window, is held out first, and its pieces are cut to ``FINE`` tokens,
which keeps the fullest window within a few tokens of the emptiest. The held-out tokens, fewer than one window and
the slack, go into windows whose lengths are powers of two, which need no padding. A task with less than one window of
tokens has one window of the largest power of two in them.

Sequences of one batch that stand on differencing differ by at most ``piece`` tokens (``FINE`` in the last batch), unless
k rose.

Ids come from a tokenizers JSON file. Its vocabulary ids follow the order of its merges (checked), so the
same merges run in tiktoken's engine, which is several times as fast and gives the same ids (tested over the
whole vocabulary). A JSON without that property is run by the tokenizers library itself.

Null texts are empty documents: only the end id. Duplicate doc_ids are separate documents; null ids are kept. Equal pieces
are told apart by their place. An empty table gives an empty table. Columns other than key and text are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder, pieces
from .common import slices, text_buffers

LENGTH = 2048
PIECE = 512
#: Pieces that are partitioned together.
BATCH = 512
#: Pieces of a task's last batch, and tokens held out of it for each window.
FINE, SLACK = 128, 8


# ---------------------------------------------------------------- differencing

def difference(sizes, k: int) -> list[list[int]]:
    """Indices of ``sizes`` in k near-equal groups, by largest differencing (Karmarkar-Karp)."""
    if k == 1 or len(sizes) == 0:
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = s
        heap.append((-int(s), i, sums, {k - 1: (i,)}))
    heapq.heapify(heap)
    number = len(sizes)
    # groups are nested pairs of tuples, so a merge costs a pair and not a copy; sums stay ascending
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        merged = a + b[::-1]
        order = np.argsort(merged, kind="stable")
        groups = {}
        for new, old in enumerate(order.tolist()):
            x, y = ga.get(old), gb.get(k - 1 - old)
            if x is not None and y is not None:
                groups[new] = (x, y)
            elif x is not None or y is not None:
                groups[new] = x if x is not None else y
        merged = merged[order]
        merged_low = merged - merged[0]
        heapq.heappush(heap, (-int(merged_low[-1]), number, merged, groups))
        number += 1
    out = []
    for g in range(k):
        found, stack = [], [heap[0][3][g]] if g in heap[0][3] else []
        while stack:
            for x in stack.pop():
                found.append(x) if isinstance(x, int) else stack.append(x)
        out.append(found)
    return out


def windows(sizes, length: int = LENGTH) -> list[list[int]]:
    """Groups of piece indices, each of at most ``length`` tokens: k rises while a group exceeds it."""
    sizes = np.asarray(sizes, np.int64)
    k = max(1, -(-int(sizes.sum()) // length))
    while True:
        groups = difference(sizes, k)
        if all(int(sizes[g].sum()) <= length for g in groups):
            return [g for g in groups if g]
        k += 1


# ---------------------------------------------------------------- token ids

def _bytes_of_unicode() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for (printable ones themselves)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks_of_json(text: str) -> bytes | None:
    """A rank file with the same ids as a byte-level BPE JSON, or None if ids do not follow the merges."""
    model = json.loads(text)["model"]
    special = {t["content"] for t in json.loads(text).get("added_tokens", [])}
    byte = _bytes_of_unicode()
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
        return None
    if any(c not in byte for t in vocab for c in t):
        return None
    return b"\n".join(base64.b64encode(bytes(byte[c] for c in t)) + b" %d" % i for t, i in vocab.items())


class Tokens:
    """Ids of texts as little-endian uint32 bytes."""

    def __init__(self, text: str, pattern: str):
        ranks = ranks_of_json(text)
        self.enc = encoder(ranks, pattern) if ranks else None
        if not self.enc:
            import tokenizers
            self.lib = tokenizers.Tokenizer.from_str(text)

    def _piece(self, whole: bool, part: str) -> bytes:
        if not self.enc:
            return np.array(self.lib.encode(part, add_special_tokens=False).ids, "<u4").tobytes()
        if whole:
            return np.array(self.enc._encode_single_piece(part), "<u4").tobytes()
        return self.enc.encode_to_numpy(part, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def of(self, text: str) -> bytes:
        return b"".join([self._piece(whole, part) for whole, part in pieces(text)])


_TOKENS: dict = {}


def _tokens(text: str, pattern: str) -> Tokens:
    if (text, pattern) not in _TOKENS:
        _TOKENS[text, pattern] = Tokens(text, pattern)
    return _TOKENS[text, pattern]


# ---------------------------------------------------------------- the operator

def _binary(n: int):
    """n as powers of two, largest first."""
    return [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]


def pack(df: DataFrame, json_path: str, pattern: str, end_id: int, text: str = "text", key: str = "doc_id",
         length: int = LENGTH, piece: int = PIECE, batch_pieces: int = BATCH) -> DataFrame:
    """One row per piece: the key, start, length, ids (array<int>), doc_tokens, sequence_id, offset.

    ``sequence_id`` is the task's number and a counter in it, so no global numbering is needed; the
    input's rows are read in their stored order, so a task that runs again gives the same rows.
    """
    return _packed(df, json_path, pattern, end_id, text, key, length, piece, batch_pieces, False)


def _packed(df, json_path, pattern, end_id, text, key, length, piece, batch_pieces, digest):
    with open(json_path, encoding="utf-8") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[key].dataType
    last = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    schema = T.StructType([T.StructField(key, kind), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), last, T.StructField("doc_tokens", T.LongType()),
                           T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = schema.names
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext
        tokens = _tokens(vocabulary.value, pattern)
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        waiting: list[tuple] = []  # (key, start, tokens of the document, bytes of the ids)

        def put(members, number):
            at = 0
            for k, start, total, ids in members:
                n = len(ids) // 4
                out.append((k, start, n, zlib.crc32(ids) if digest else ids, total, number, at))
                at += n

        def batch_out():
            columns = list(zip(*out))
            arrays = [pa.array(columns[0], key_type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())]
            if digest:
                arrays.append(pa.array(columns[3], pa.int64()))
            else:
                ends = np.cumsum([0, *columns[2]]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends),
                                                       pa.array(np.frombuffer(b"".join(columns[3]), "<i4"))))
            arrays += [pa.array(c, pa.int64()) for c in columns[4:]]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        def split_waiting(final):
            nonlocal sequence
            members = waiting[:batch_pieces]
            del waiting[:batch_pieces]
            members, rest = held_out(members) if final else (members, [])
            groups = [[members[i] for i in w] for w in windows([len(x[3]) // 4 for x in members], length)] + tail(rest)
            for g in groups:
                put(g, sequence)
                sequence += 1

        def held_out(members):
            """(fine pieces that fill whole windows but for the slack, the rest)."""
            total = sum(len(x[3]) // 4 for x in members)
            k = total // length
            room = k * length - SLACK * k if k else 1 << total.bit_length() - 1
            kept, rest = [], []
            for key, start, n, ids in members:
                size, at = len(ids) // 4, 0
                while at < size:
                    take = min(FINE if k else size, size - at, room or size)
                    (kept if room else rest).append((key, start + at, n, ids[4 * at:4 * (at + take)]))
                    at, room = at + take, room - take if room else 0
            return kept, rest

        def tail(members):
            """Full windows, then windows of powers of two."""
            total = sum(len(x[3]) // 4 for x in members)
            sizes = [length] * (total // length) + _binary(total % length)
            groups, room = [], 0
            for k, start, n, ids in members:
                at = 0
                while at < len(ids) // 4:
                    if room == 0:
                        room = sizes[len(groups)]
                        groups.append([])
                    take = min(room, len(ids) // 4 - at)
                    groups[-1].append((k, start + at, n, ids[4 * at:4 * (at + take)]))
                    at, room = at + take, room - take
            return groups

        def cut(k, ids):
            nonlocal sequence
            n, at = len(ids) // 4, 0
            while n - at >= length:
                put([(k, at, n, ids[4 * at:4 * (at + length)])], sequence)
                sequence += 1
                at += length
            while at < n:
                take = min(piece, n - at)
                waiting.append((k, at, n, ids[4 * at:4 * (at + take)]))
                at += take
            while len(waiting) >= batch_pieces:
                split_waiting(False)

        key_type = None
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key))
            key_type = keys.type
            texts = batch.column(batch.schema.get_field_index(text))
            _, offsets = text_buffers(texts)
            for a, b in slices(offsets):
                for k, s in zip(keys.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist()):
                    cut(k, tokens.of(s or "") + end)
                    if len(out) >= 4096:
                        yield batch_out()
        if waiting:
            split_waiting(True)
        if out:
            yield batch_out()

    return df.select(key, text).mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    """op1: every document packed into sequences of at most 2048 tokens; one narrow stage, no shuffle."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers as P
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _packed(docs, P.path("byte_bpe_50k.json"), P.PATTERN, 1, "text", "doc_id", LENGTH, PIECE, BATCH, True)
