"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut before encoding where the pattern can never match across: between a character
that is not white space and one that is. Every match lies within one piece, so the ids are those
of the whole text. Decoding gives raw bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.llm.common import quoted, slices, without

#: Texts longer than this many characters are cut into pieces of about this length.
PIECE_CHARS = 1 << 15

#: What the pattern's \\s means (Unicode's White_Space; unlike Python's, without U+001C to U+001F).
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(rf"[^{WHITE}](?=[{WHITE}])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 token, rank), once a process."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """The text in pieces that end at safe boundaries; a stretch without one stays whole."""
    out, begin = [], 0
    while len(text) - begin > most:
        cut = _SAFE.search(text, begin + most - 1)
        if cut is None:
            break
        out.append(text[begin : cut.end()])
        begin = cut.end()
    out.append(text[begin:])
    return out


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text):
        ids.extend(enc.encode_ordinary(piece))
    return ids


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", keep_text: bool = False) -> DataFrame:
    """df with the ids of each whole text in `ids_col` (array<int>); `text_col` itself only with keep_text.

    Null texts count as empty and get an empty array. Repeated rows stay repeated, an empty table
    stays empty, and an input column named like `ids_col` (in any case) is replaced.
    """
    base = without(df, [ids_col])
    rest = [c for c in base.columns if keep_text or c != text_col]
    work = base.select(*[quoted(c) for c in rest], F.coalesce(quoted(text_col), F.lit("")).alias("__text"))
    schema = T.StructType([*[base.schema[c] for c in rest], T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(len(rest))
            sizes = pa.compute.utf8_length(texts).to_pylist()
            for a, b in slices(sizes, 1 << 21):
                ids = [encode_text(enc, t) for t in texts.slice(a, b - a).to_pylist()]
                columns = [batch.column(i).slice(a, b - a) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))], names=[*rest, ids_col])

    return work.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """df with the raw bytes of `ids_col` in `bytes_col` (binary). Null ids give empty bytes; an unknown id is an error."""
    base = without(df, [bytes_col])
    schema = T.StructType([*base.schema.fields, T.StructField(bytes_col, T.BinaryType(), False)])
    names, at = base.columns, base.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(at)).fill_null(0).to_pylist()
            for a, b in slices(sizes, 1 << 19):
                part = batch.slice(a, b - a)
                raw = [enc.decode_bytes(x) if x else b"" for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*names, bytes_col])

    return base.mapInArrow(run, schema)
