"""Problem 8: the corpus in ids of a public byte-level BPE vocabulary.

The vocabulary (base64 token, rank) is serialised straight into a sentencepiece BPE model: each
token is one piece, its bytes mapped to printable characters, scored by its negative rank, with an
identity normaliser. A text is cut into pre-tokens by the vocabulary's public pattern, each
pre-token is byte-mapped and encoded by that model, and decoding maps the pieces' characters back.

Empty and NULL texts have the empty list of ids. Strings that look like special tokens are
ordinary text. Text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import os
import struct
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE_BOUND = 400_000


def byte_table() -> dict[int, int]:
    """Byte -> printable code point: printable Latin-1 stays, the rest moves up from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: b for b in keep} | {b: 256 + i for i, b in enumerate(rest)}


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    tokens: list[bytes | None] = [None] * len(rows)
    for token, rank in rows:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens  # type: ignore[return-value]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece ids are ranks, the unknown piece comes after the last."""
    table = byte_table()
    out = []
    for rank, token in enumerate(tokens):
        piece = token.decode("latin-1").translate(table).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank))))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + b"".join(_field(n, v) for n, v in ((40, len(tokens)), (41, -1), (42, -1), (43, -1)))
    normalizer = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class PieceEncoder(dict):
    """Pre-token -> ids, filled from the sentencepiece model and emptied at a bound."""

    def __init__(self, model: bytes, n: int, pattern: str = PATTERN):
        import sentencepiece

        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n, self.split = n, regex.compile(pattern).findall
        self.table = byte_table()
        self.back = {c: b for b, c in self.table.items()}

    def __missing__(self, token: str) -> list[int]:
        if len(self) >= _CACHE_BOUND:
            self.clear()
        ids = self.sp.encode(token.encode("utf-8", "replace").decode("latin-1").translate(self.table))
        if len(token) <= 64:
            self[token] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []

    def decode(self, ids) -> str:
        chars = "".join(self.sp.id_to_piece([int(i) for i in ids])) if len(ids) else ""
        return bytes(self.back[ord(c)] for c in chars).decode("utf-8", "replace")


_WORKER: dict[str, PieceEncoder] = {}


def _encoder(key: str, model, n: int, pattern: str) -> PieceEncoder:
    if key not in _WORKER:
        _WORKER[key] = PieceEncoder(model.value, n, pattern)
    return _WORKER[key]


def tokenizer_path(path: str | None = None) -> str:
    path = path or DEFAULT_PATH
    if not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer vocabulary at {path}; pass its path")
    return path


def encoding(df: DataFrame, text: str = "text", path: str | None = None, pattern: str = PATTERN) -> Column:
    """Column of ids of ``df[text]``; the model (about 1 MB, fixed by the vocabulary) is broadcast."""
    import hashlib

    tokens = read_ranks(tokenizer_path(path))
    data = model_bytes(tokens)
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    model, n = df.sparkSession.sparkContext.broadcast(data), len(tokens)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        enc = _encoder(key, model, n, pattern).encode
        return pd.Series([enc(t) for t in texts], dtype=object)

    return encode(df[text])


def encode_corpus(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every document."""
    return documents.select("doc_id", encoding(documents, "text", path).alias("ids"))


def decode_corpus(encoded: DataFrame, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, text``: the inverse of :func:`encode_corpus` (NULL ids give NULL)."""
    import hashlib

    tokens = read_ranks(tokenizer_path(path))
    data = model_bytes(tokens)
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    model, n = encoded.sparkSession.sparkContext.broadcast(data), len(tokens)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        enc = _encoder(key, model, n, pattern)
        return pd.Series([None if x is None else enc.decode(x) for x in ids], dtype=object)

    return encoded.select("doc_id", decode("ids").alias("text"))
