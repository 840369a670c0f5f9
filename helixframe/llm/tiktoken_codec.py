"""Byte-level BPE with the tiktoken library over a local rank file.

Long texts are cut before white space that follows other text: no match of the pattern spans such a place, so
the pieces encode as the whole does, whatever the cut. A long run of white space before other text is one match of the pattern
but for its last character; the library's regex would go down one level of its stack for each character, so such a
run is given to the merges as it is. Ids decode to raw bytes, which need not be valid UTF-8.

A null text encodes as an empty one; very long ones go piece by piece, whatever their words' or white space's length.
Repeated rows, ties, empty tables and other columns, whatever their names, need no care: rows are independent.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import release

PIECE_CHARS = 1 << 16
#: White space in the pattern's sense, after a character that is none in any library's sense.
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \t\n\r])")
#: A long run of white space, all but its last character, before other text. The white space of Unicode.
_RUN = re.compile(r"(?<![\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}+")
_codecs: dict[tuple[str, str], tiktoken.Encoding] = {}


def codec(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once a worker."""
    if (path, pattern) not in _codecs:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _codecs[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _codecs[path, pattern]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """`text` in pieces of about `size` characters, cut at safe places only."""
    at = 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _between_runs(enc: tiktoken.Encoding, text: str) -> list[int]:
    ids, at = [], 0
    for m in _RUN.finditer(text):
        end = m.end() - 1 if m.end() < len(text) else m.end()
        ids += enc.encode_ordinary(text[at : m.start()])
        ids += enc._encode_single_piece(text[m.start() : end].encode())
        at = end
    return ids + enc.encode_ordinary(text[at:])


def encode(enc: tiktoken.Encoding, text: str, size: int = PIECE_CHARS) -> list[int]:
    if len(text) <= 1000:
        return enc.encode_ordinary(text)
    return [i for p in pieces(text, size) for i in _between_runs(enc, p)]


def encode_ids(text: Column, path: str, pattern: str) -> Column:
    """array<int> of the text's token ids; one text's ids at a time are Python numbers."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        enc = codec(path, pattern)
        rows = [np.array(encode(enc, t.as_py() or ""), np.int32) for t in texts]
        offs = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=offs[1:])
        release()
        return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))

    return ids(text)


def decode_bytes(ids: Column, path: str, pattern: str) -> Column:
    """The raw bytes that the ids stand for; null ids give null."""

    @F.arrow_udf("binary")
    def raw(rows: pa.Array) -> pa.Array:
        enc = codec(path, pattern)
        return pa.array([enc.decode_bytes(r.values.to_pylist()) if r.is_valid else None for r in rows], pa.binary())

    return raw(ids)


def decoded_sha256(ids: Column, path: str, pattern: str) -> Column:
    """Lowercase hex of the SHA-256 of what the ids decode to; the bytes stay where they are."""

    @F.arrow_udf("string")
    def digest(rows: pa.Array) -> pa.Array:
        enc = codec(path, pattern)
        return pa.array([hashlib.sha256(enc.decode_bytes(r.values.to_pylist())).hexdigest() if r.is_valid else None for r in rows], pa.string())

    return digest(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to, without moving either."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(texts: pa.Array) -> pa.Array:
        enc, n, a, b = codec(path, pattern), [], [], []
        for t in texts:
            ids = encode(enc, t.as_py() or "")
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)
