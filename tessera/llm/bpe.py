"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` adds the token ids of a text column, ``decode`` turns ids back into raw bytes. Each match of
the split pattern is encoded by itself and special-token strings are ordinary text.

Long texts are cut before the library sees them, only where no match of the pattern can lie across the
cut: before the first white space after a non-space character, and around very long white-space
runs (whose match is known and would overflow the regex engine's stack). Whole texts are encoded;
the pieces' ids are joined.

Null texts encode as the empty text, which has no ids. Repeated rows and ids are kept as they come; an empty table gives an
empty table.
An existing column of the output's name is replaced; other columns pass through.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_buffers

#: Texts up to this many characters go to the library in one call, longer ones in pieces about as long.
PIECE_CHARS = 1 << 16
#: Bytes of text whose ids are put into one Arrow batch.
BATCH_BYTES = 4 << 20

# fixed values: the Unicode White_Space characters, which \s matches in the split pattern
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_RUN = re.compile(f"[{WHITE}]{{512,}}")
_CUT = re.compile(rf"(?<=[^\s{WHITE}])(?=[{WHITE}])")

_ENCODERS: dict = {}


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver; tasks get them by broadcast (one vocabulary, fixed size)."""
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes, pattern: str):
    """A tiktoken Encoding without special tokens; one for each worker process and vocabulary."""
    key = (hash(ranks), len(ranks), pattern)
    if key not in _ENCODERS:
        import tiktoken
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _ENCODERS[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[key]


def _runs(text: str) -> Iterator[tuple[bool, str]]:
    """(is one match, text): very long white-space runs apart from the rest.

    A run before a non-space character matches without its last character, which starts the next match.
    """
    at = 0
    for m in _RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        if m.start() > at:
            yield False, text[at:m.start()]
        yield True, text[m.start():end]
        at = end
    if at < len(text):
        yield False, text[at:]


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[tuple[bool, str]]:
    """(is one match, piece) whose ids, joined, are the ids of ``text``; ``text`` is the joined pieces."""
    if len(text) <= limit:
        parts = _runs(text) if len(text) >= 512 and _RUN.search(text) else [(False, text)]
        yield from parts
        return
    for whole, part in _runs(text):
        at = 0
        while not whole and len(part) - at > limit:
            m = _CUT.search(part, at + limit - 1)
            if not m:
                break
            yield False, part[at:m.start()]
            at = m.start()
        yield whole, part[at:]


def encode_text(enc, text: str) -> list[int]:
    out: list[int] = []
    for whole, part in pieces(text):
        out += enc._encode_single_piece(part) if whole else enc.encode_ordinary(part)
    return out


def _groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    from .common import slices
    return slices(offsets, BATCH_BYTES)


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> tuple[T.StructType, list[str]]:
    keep = [f for f in df.schema.fields if f.name != name]
    return T.StructType([*keep, T.StructField(name, kind)]), [f.name for f in keep]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of column ``text`` as array<int> in column ``out``; no shuffle."""
    schema, keep = _with_column(df, out, T.ArrayType(T.IntegerType(), False))
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        enc = encoder(ranks.value, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, offsets = text_buffers(column)
            for a, b in _groups(offsets):
                ids = [np.array(encode_text(enc, s or ""), np.int32) for s in column.slice(a, b - a).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
                lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                part = batch.slice(a, b - a)
                rest = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*rest, lists.cast(pa.list_(pa.int32()))], [*keep, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of the ids in column ``out`` (null ids: empty); no shuffle."""
    schema, keep = _with_column(df, out, T.BinaryType())
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        enc = encoder(ranks.value, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [enc.decode_bytes(x.values.to_pylist() if x.is_valid else []) for x in column]
            rest = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.binary())], [*keep, out])

    return df.mapInArrow(run, schema)


def digests(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode``'s rows (columns doc_id, ids)."""
    from hashlib import sha256
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = encoded.schema["doc_id"].dataType

    def run(batches):
        enc = encoder(ranks.value, pattern)
        names = [str(i) for i in range(enc.max_token_value + 1)]
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            rows = [x.values.to_pylist() for x in column]
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")),
                pa.array([len(x) for x in rows], pa.int64()),
                pa.array([sha256(" ".join([names[i] for i in x]).encode()).hexdigest() for x in rows]),
                pa.array([sha256(enc.decode_bytes(x)).hexdigest() for x in rows]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType([
        T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))


def op8(spark, sf_dir: str) -> DataFrame:
    """op8: every document encoded, decoded and digested; one narrow stage, no shuffle."""
    import public_tokenizers as P
    path = P.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = encode(docs, path, P.PATTERN).select("doc_id", "ids")
    return digests(encoded, path, P.PATTERN)
