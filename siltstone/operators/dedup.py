"""Exact and near duplicates of files, repositories and chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.components import connected_components
from siltstone.session import materialize

P = (1 << 61) - 1
SHINGLE = 5


def mark_first_wins(df: DataFrame, key: str, order: str = "ord", flag: str = "duplicate", ignore_empty: bool = True) -> DataFrame:
    """``flag`` is true where an earlier row has the same non-empty key.

    A minimum by key is combined before the shuffle, so one key may hold any share of the rows; it
    is joined back instead of ranking the rows of a key in one task.
    """
    keyed = df.where(F.col(key).isNotNull() & ((F.col(key) != "") if ignore_empty else F.lit(True)))
    first = keyed.groupBy(key).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    out = df.join(first, key, "left")
    return out.withColumn(flag, F.coalesce(F.col("_first") < F.col(order), F.lit(False))).drop("_first")


def repository_signatures(files: DataFrame) -> DataFrame:
    """``repository, signature``: hash of the repository's sorted distinct file hashes, one a line.

    Hashes are sorted in buckets of their first three digits, whose order is that of the whole; the
    buckets of a repository then stream through one hash in their order, so that a task holds a
    batch of buckets and never a repository, whatever its size.
    """
    distinct = files.where("hash <> ''").select("repository", "hash").distinct()
    parts = distinct.groupBy("repository", F.substring("hash", 1, 3).alias("b")).agg(F.array_join(F.sort_array(F.collect_list("hash")), "\n").alias("h"))

    def stream(batches):
        name, state = None, None
        for pdf in batches:
            done = []
            for repository, h in zip(pdf["repository"], pdf["h"], strict=True):
                if state is None or repository != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = repository, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(h.encode())
            yield pd.DataFrame(done, columns=["repository", "signature"])
        if state is not None:
            yield pd.DataFrame([(name, state.hexdigest())], columns=["repository", "signature"])

    return parts.repartition("repository").sortWithinPartitions("repository", "b").select("repository", "h").mapInPandas(stream, "repository string, signature string")


def duplicate_repositories(files: DataFrame) -> DataFrame:
    """``repository, signature, keep``: of repositories with equal content the smallest name stays."""
    sig = repository_signatures(files)
    first = sig.groupBy("signature").agg(F.min("repository").alias("_least"))
    return sig.join(first, "signature").select("repository", "signature", (F.col("repository") == F.col("_least")).alias("keep"))


class _Grams(dict):
    """Shingle -> 64-bit hash, kept per worker and emptied at a bound."""

    def __init__(self, digest: str):
        super().__init__()
        self.blake = digest == "blake2b"

    def __missing__(self, gram: str) -> int:
        raw = gram.encode("utf-8", "surrogatepass")
        h = self[gram] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest() if self.blake else hashlib.sha256(raw).digest()[:8], "big")
        return h


_GRAMS: dict[str, _Grams] = {}
_GRAM_BOUND = 500_000


def _base_hashes(text: str | None, digest: str) -> np.ndarray:
    """64-bit hashes of the distinct 5-character shingles; blank text has none."""
    s = " ".join(text.split()) if text else ""
    if not s:
        return np.empty(0, dtype=np.uint64)
    known = _GRAMS.setdefault(digest, _Grams(digest))
    if len(known) > _GRAM_BOUND:
        known.clear()
    grams = {s[i : i + SHINGLE] for i in range(max(1, len(s) - SHINGLE + 1))}
    return np.fromiter(map(known.__getitem__, grams), dtype=np.uint64, count=len(grams))


def _times_mod(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``a * h mod 2^61 - 1`` for a < 2^8 and h < 2^61, in 64-bit words."""
    x = a * (h >> np.uint64(31))
    y = ((x & np.uint64((1 << 30) - 1)) << np.uint64(31)) + (x >> np.uint64(30)) + a * (h & np.uint64((1 << 31) - 1))
    y = (y & np.uint64(P)) + (y >> np.uint64(61))
    return np.where(y >= np.uint64(P), y - np.uint64(P), y)


#: Shingles taken at once, which bounds the table of permuted hashes of a very long text.
_STRIDE = 20_000


def minhash(text: str | None, perms: int = 64, digest: str = "blake2b") -> list[int]:
    """Least value of ``(2 i + 1) h + i^2 + 7 mod 2^61 - 1`` over the shingles, for each i; blank: zeros."""
    h = _base_hashes(text, digest) % np.uint64(P)
    if not len(h):
        return [0] * perms
    i = np.arange(perms, dtype=np.uint64)[:, None]
    least = np.full(perms, P, dtype=np.uint64)
    for at in range(0, len(h), _STRIDE):
        v = _times_mod(2 * i + np.uint64(1), h[None, at : at + _STRIDE]) + i * i + np.uint64(7)
        least = np.minimum(least, np.where(v >= np.uint64(P), v - np.uint64(P), v).min(axis=1))
    return [int(x) for x in least]


def minhash_column(text: Column, perms: int = 64, digest: str = "blake2b") -> Column:
    @F.pandas_udf("array<long>")
    def sign(texts: pd.Series) -> pd.Series:
        return pd.Series([minhash(t, perms, digest) for t in texts], dtype=object)

    return sign(text)


def signature_similarity(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), same / F.greatest(F.size(a), F.lit(1))).otherwise(F.lit(0.0))


def near_duplicate_groups(files: DataFrame, *, perms: int = 64, bands: int = 16, threshold: float = 0.85, order: str = "ord", text: str = "content") -> DataFrame:
    """``ord, group``: each text with the smallest member of its near-duplicate group.

    Banded signatures; in each bucket the members are held against the first one only (a star), and
    linked where the signatures agree in at least ``threshold`` places; groups are the components.
    Equal texts are one node from the start, so a bucket of copies is one row, not all its pairs.
    """
    rows = perms // bands
    keyed = files.select(F.col(order).alias("ord"), F.col(text).alias("t"), F.sha2(F.coalesce(F.regexp_replace(text, r"(?U)\s+", " "), F.lit("")), 256).alias("k"))
    reps = keyed.groupBy("k").agg(F.min("ord").alias("rep"))
    member = materialize(keyed.select("ord", "k").join(reps, "k").select("ord", "rep"), "near-members")
    sig = materialize(keyed.join(member.where("ord = rep").select("ord"), "ord", "left_semi").select("ord", minhash_column(F.col("t"), perms).alias("sig")), "signatures")
    bucket = sig.select("ord", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, rows)))).alias("band", "key"))
    heads = bucket.groupBy("band", "key").agg(F.min("ord").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key", "head")
    cand = bucket.join(heads, ["band", "key"]).where("ord <> head").select("ord", "head").distinct()
    a, b = sig.select("ord", F.col("sig").alias("sa")), sig.select(F.col("ord").alias("head"), F.col("sig").alias("sb"))
    linked = cand.join(a, "ord").join(b, "head").where(signature_similarity(F.col("sa"), F.col("sb")) >= threshold)
    comp = connected_components(linked, "ord", "head")
    return member.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("ord", F.coalesce("component", "rep").alias("group"))


def near_duplicates(files: DataFrame, **options) -> DataFrame:
    """``ord, group`` of the redundant files: all but the smallest of each group."""
    return near_duplicate_groups(files, **options).where("ord > `group`")


def mark_duplicate_chunks(chunks: DataFrame, ids: str = "token_ids", order: str = "chunk_id") -> DataFrame:
    """``duplicate`` where an earlier chunk has the same ids; compared by a 256-bit hash of them."""
    keyed = chunks.withColumn("_k", F.sha2(F.array_join(ids, ","), 256))
    return mark_first_wins(keyed, "_k", order).drop("_k")
