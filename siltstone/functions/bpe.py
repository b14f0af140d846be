"""Byte-level BPE: learning merges from counted pieces, encoding and decoding, a byte tokenizer."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pre-token pattern, default special tokens, ids of the byte tokenizer.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
SPECIALS = ("<|endoftext|>", "<|pad|>", "<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>")
BYTE_EOS, BYTE_PAD, BYTE_BOS, BYTE_VOCAB = 256, 257, 258, 259
_SPLIT = re.compile(PIECES)
_CACHE_BOUND = 200_000


def pieces_of(texts: DataFrame, text: str = "text", order: str = "ord") -> DataFrame:
    """``piece, n, first``: distinct pre-tokens with their count and first place ``(ord, position)``."""
    found = texts.where(F.col(text).isNotNull()).select(F.col(order).alias("o"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit("(?U)" + PIECES), 0)).alias("p", "piece"))
    return found.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "p")).alias("first"))


def pair_counts(texts: DataFrame, text: str = "text", order: str = "ord") -> DataFrame:
    """``a, b, n``: how often one byte follows another inside a pre-token."""
    p = pieces_of(texts, text, order).where(F.octet_length("piece") > 1)
    p = p.select("n", byte_ids(F.col("piece")).alias("x"))
    m = F.size("x") - 1
    pairs = F.zip_with(F.slice("x", F.lit(1), m), F.slice("x", F.lit(2), m), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return p.select("n", F.explode(pairs).alias("ab")).groupBy("ab.a", "ab.b").agg(F.sum("n").alias("n"))


def learn_merges(pieces: list[tuple[bytes, int, tuple]], n_merges: int) -> list[tuple[int, int]]:
    """Merges of the most frequent pair; ties go to the pair that occurs first in the corpus.

    Equal pieces change alike, so distinct pieces with counts and first places give the merges of the
    whole corpus. Pair counts and places are kept up as pieces change, in a heap of candidates.
    """
    order = sorted(range(len(pieces)), key=lambda i: pieces[i][2])
    words = [list(pieces[i][0]) for i in order]
    count = [pieces[i][1] for i in order]
    total: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for w, ids in enumerate(words):
        for pair in zip(ids, ids[1:], strict=False):
            total[pair] += count[w]
            where[pair].add(w)
    heap = [(-n, pair) for pair, n in total.items()]
    heapq.heapify(heap)

    def first_place(pair):
        w = min(where[pair])
        ids = words[w]
        return w, next(i for i in range(len(ids) - 1) if (ids[i], ids[i + 1]) == pair)

    merges: list[tuple[int, int]] = []
    while len(merges) < n_merges:
        top: list[tuple[int, int]] = []
        best = 0
        while heap:
            n, pair = heap[0]
            if total.get(pair, 0) != -n:
                heapq.heappop(heap)
                if total.get(pair, 0) > 0:
                    heapq.heappush(heap, (-total[pair], pair))
                continue
            if top and -n < best:
                break
            heapq.heappop(heap)
            if pair not in top:
                best = -n
                top.append(pair)
        if not top or best < 2:
            break
        pair = min(top, key=first_place) if len(top) > 1 else top[0]
        for p in top:
            if p != pair:
                heapq.heappush(heap, (-total[p], p))
        new = 256 + len(merges)
        merges.append(pair)
        for w in list(where[pair]):
            old = words[w]
            out, i = [], 0
            while i < len(old):
                if i + 1 < len(old) and (old[i], old[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(old[i])
                    i += 1
            touched = set()
            for q in zip(old, old[1:], strict=False):
                total[q] -= count[w]
                touched.add(q)
            for q in zip(out, out[1:], strict=False):
                total[q] += count[w]
                touched.add(q)
            words[w] = out
            now = set(zip(out, out[1:], strict=False))
            for q in touched:
                (where[q].add if q in now else where[q].discard)(w)
                if total[q] > 0:
                    heapq.heappush(heap, (-total[q], q))
    return merges


class Bpe:
    """Merges, vocabulary and special tokens."""

    def __init__(self, merges: list[tuple[int, int]] | None = None, specials: dict[str, int] | None = None):
        self.merges = {tuple(p): 256 + i for i, p in enumerate(merges or [])}
        self.vocab = {i: bytes([i]) for i in range(256)}
        for (a, b), i in self.merges.items():
            self.vocab[i] = self.vocab[a] + self.vocab[b]
        self.specials: dict[str, int] = dict(specials or {})
        self._cache: dict[str, list[int]] = {}
        self._split_specials()

    def _split_specials(self) -> None:
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    @property
    def vocab_size(self) -> int:
        return len(self.vocab) + len(self.specials)

    def add_specials(self, names) -> None:
        for s in names:
            if s not in self.specials:
                self.specials[s] = max([len(self.vocab) - 1, *self.specials.values()]) + 1
        self._split_specials()

    def _piece(self, piece: str) -> list[int]:
        ids = list(piece.encode("utf-8", "surrogatepass"))
        while len(ids) > 1:
            pair = min(zip(ids, ids[1:], strict=False), key=lambda p: self.merges.get(p, 1 << 60))
            new = self.merges.get(pair)
            if new is None:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        if len(piece) <= 64:
            if len(self._cache) >= _CACHE_BOUND:
                self._cache.clear()
            self._cache[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.specials:
                out.append(self.specials[part])
                continue
            for piece in _SPLIT.findall(part):
                got = self._cache.get(piece)
                out += self._piece(piece) if got is None else got
        return out

    def decode(self, ids) -> str:
        back = {i: s.encode() for s, i in self.specials.items()}
        try:
            return b"".join(self.vocab[i] if i in self.vocab else back[i] for i in map(int, ids)).decode("utf-8", "replace")
        except KeyError as e:
            raise ValueError(f"unknown id {e.args[0]}") from None

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"type": "byte_bpe", "merges": [[a, b, i] for (a, b), i in self.merges.items()], "special_tokens": self.specials}, f)

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return cls([(a, b) for a, b, _ in sorted(d["merges"], key=lambda m: m[2])], d.get("special_tokens", {}))

    def fingerprint(self, version: int = 1) -> str:
        h = hashlib.sha256(f"{version}{self.vocab_size}".encode())
        for (a, b), i in sorted(self.merges.items(), key=lambda kv: kv[1]):
            h.update(f"{a},{b},{i};".encode())
        for k, v in sorted(self.specials.items()):
            h.update(f"{k}={v};".encode())
        return h.hexdigest()


#: Most distinct pieces that are sent to the driver; beyond it the rarest are cut by a count of 1.
PIECE_BOUND = 5_000_000


def train(texts: DataFrame, vocab_size: int, text: str = "text", order: str = "ord", specials=()) -> Bpe:
    """Merges of the corpus. Spark counts the distinct pieces, the driver learns from these counts.

    Distinct pieces grow far slower than the text; if there are more than ``PIECE_BOUND`` of them the
    training stops with an error instead of filling the driver.
    """
    if vocab_size < 256:
        raise ValueError("the vocabulary holds at least the 256 bytes")
    from siltstone.session import materialize

    pieces = materialize(pieces_of(texts, text, order), "pieces")
    n = pieces.count()
    if n > PIECE_BOUND:
        raise ValueError(f"{n} distinct pieces exceed {PIECE_BOUND}; train on a bounded sample")
    rows = [(r["piece"].encode("utf-8", "surrogatepass"), r["n"], (r["first"]["o"], r["first"]["p"])) for r in pieces.toLocalIterator()]
    out = Bpe(learn_merges(rows, vocab_size - 256))
    out.add_specials(specials)
    return out


def encode_column(tokenizer: Bpe, df: DataFrame, text: str = "text", bos: int | None = None, eos: int | None = None) -> Column:
    """Ids of ``df[text]``, with the opening and closing id around them where given; NULL stays NULL."""
    shared = df.sparkSession.sparkContext.broadcast((list(tokenizer.merges), tokenizer.specials))
    key = tokenizer.fingerprint()

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        if key not in _MADE:
            _MADE[key] = Bpe(*shared.value)
        t = _MADE[key]
        return pd.Series([None if x is None else t.encode(x) for x in texts], dtype=object)

    out = encode(df[text])
    if bos is not None:
        out = F.concat(F.array(F.lit(bos)), out)
    return F.concat(out, F.array(F.lit(eos))) if eos is not None else out


_MADE: dict[str, Bpe] = {}


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes as ids, all in the JVM; empty text gives an empty list."""
    n = F.octet_length(text)
    # The hex digits are the lambda's input; captured inside it they would be made anew for every byte.
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), 1)
    return F.when(n > 0, F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))).when(n == 0, F.array().cast("array<int>"))
