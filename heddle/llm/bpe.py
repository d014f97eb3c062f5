"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where no match of the pre-splitting pattern can cross: before a single space between two characters
that are not white space. The pieces' ids, one after another, are the whole text's ids, so no text has to be held by the
encoder at once. Decoding goes through raw bytes: an id sequence that ends inside a character is no error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a piece, from which on the next safe boundary ends it.
PIECE_CHARS = 1 << 16

_ENCODINGS: dict[tuple[str, str], object] = {}
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file, once for each Python worker."""
    if (ranks_path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODINGS[ranks_path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[ranks_path, pattern]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """text in pieces of about size characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode(enc, text: str, size: int = PIECE_CHARS) -> np.ndarray:
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text, size)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4", copy=False)


def decode(enc, ids: np.ndarray, block: int = PIECE_CHARS) -> Iterator[bytes]:
    """The ids' bytes, block by block."""
    for at in range(0, len(ids), block):
        yield enc.decode_bytes(ids[at : at + block].tolist())


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, ids), or with digest (doc_id, n_tokens, ids_sha256, decoded_sha256): each text's ids and what they decode to.

    Special tokens' strings are ordinary text. A null or empty text has no ids; a null id, repeated rows and further
    columns change nothing; an empty table gives no rows. The rank file must be readable at ranks_path on every executor.
    A map over the rows without a shuffle: memory is bounded by an Arrow batch and the longest text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column(1):
                ids = encode(enc, value.as_py().decode("utf-8", "replace"))
                if digest:
                    decoded = hashlib.sha256()
                    for part in decode(enc, ids):
                        decoded.update(part)
                    out.append((len(ids), hashlib.sha256(ids.data).hexdigest(), decoded.hexdigest()))
                else:
                    out.append((ids.astype("int32"),))
            if digest:
                n, a, b = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.list_(pa.int32()))], ["doc_id", "ids"])

    columns = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"
    return rows.mapInArrow(run, f"doc_id {id_type}, {columns}")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): what the ids of encode_documents() decode to; null ids decode to no bytes."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            texts = [b"".join(decode(enc, np.asarray(ids.as_py() or [], "<u4"))) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, bytes binary")
