"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Each Python worker loads the ranks once. A text longer than LONG_TEXT characters is cut before encoding where
the split pattern cuts anyway, so that no call gets more than about LONG_TEXT characters and the ids are those of
the whole text. Of the pattern FAMILY it is known where that is: between an ASCII letter, digit or punctuation mark and a
following space or newline it always ends a match, and what it matches before that place does not depend on what
follows. A stretch without such a place (say a megabyte of one letter or of spaces), and a long text under any other
pattern, is cut into its matches by the `regex` module and each is encoded as one piece. Ids decode to raw bytes, never
through str, so no id sequence fails.

Defined results: a null text is empty and has no ids; special strings are ordinary text; equal rows give equal
results; an empty table gives an empty one; columns other than the id and the text play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_TEXT = 50_000
#: Rows per Arrow batch handled at once are bounded by the session; ids of one text at a time are held.
#: Fixed value: the split pattern whose boundaries safe_parts knows.
FAMILY = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n][!-~])")


@lru_cache(4)
def load_encoding(rank_file: str, pattern: str):
    return _encoding(rank_file, pattern)


@lru_cache(4)
def _pieces_of(rank_file: str):
    """Takes what it is given as one piece."""
    return _encoding(rank_file, r"(?s:.+)")


def _encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, limit: int = LONG_TEXT) -> Iterator[str]:
    """text in parts of at least limit characters, cut only at safe boundaries; their ids concatenate to those of text."""
    start = 0
    while len(text) - start > limit:
        at = _SAFE.search(text, start + limit)
        if at is None:
            break
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


def encode_text(rank_file: str, text: str, pattern: str, limit: int = LONG_TEXT) -> list[int]:
    enc = load_encoding(rank_file, pattern)
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in safe_parts(text, limit) if pattern == FAMILY else [text]:
        if len(part) <= 4 * limit and pattern == FAMILY:
            ids += enc.encode_ordinary(part)
        else:
            ids += _encode_matches(rank_file, part, pattern)
    return ids


def _encode_matches(rank_file: str, text: str, pattern: str) -> list[int]:
    """Each match of the pattern is a piece of its own."""
    import regex

    whole, ids = _pieces_of(rank_file), []
    for m in regex.compile(pattern).finditer(text):
        ids += whole.encode_ordinary(m[0])
    return ids


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, ids array<int>, decoded binary (the decoded bytes of the ids)."""

    def run(batches):
        enc = load_encoding(rank_file, pattern)
        for batch in batches:
            ids = [encode_text(rank_file, t or "", pattern) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode_bytes(x) for x in ids], pa.binary())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents reduced inside the worker: id_col, n_tokens, ids_sha256, decoded_sha256. Ids and bytes never leave the task."""

    def run(batches):
        enc = load_encoding(rank_file, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for t in batch.column(1).to_pylist():
                ids = encode_text(rank_file, t or "", pattern)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
