"""Hash splits, ratio balancing and seeded orders."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import LANGUAGE_RATIOS, SPLIT_RATIOS, normalize
from siltstone.operators.ordering import rank_by_hash


def fraction(key: Column, seed: int) -> Column:
    """The first 64 bits of ``sha256("seed:key")`` as a share of one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def pick(n: Column, key: Column) -> Column:
    """A number under ``n`` from the first 64 bits of ``sha256(key)``; 0 where n is not positive."""
    word = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(n > 0, F.pmod(word, F.greatest(n, F.lit(1)).cast("decimal(20,0)")).cast("int")).otherwise(F.lit(0))


def assign_split(key: Column, ratios: dict[str, float] | None = None, seed: int = 20241) -> Column:
    r = normalize(ratios or SPLIT_RATIOS)
    x, cut, out = fraction(key, seed), 0.0, None
    names = [s for s in ("train", "validation", "test") if s in r] + [s for s in r if s not in ("train", "validation", "test")]
    for s in names:
        cut += r[s]
        out = F.when(x < cut, F.lit(s)) if out is None else out.when(x < cut, F.lit(s))
    return out.otherwise(F.lit(names[-1]))


def leaking(files: DataFrame, key: str = "repository") -> DataFrame:
    """Keys with rows in more than one split; empty where nothing leaks."""
    return files.groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select(key)


def largest_total(available: dict[str, int], ratios: dict[str, float], bound: int) -> int:
    """The largest N with ``int(r N)`` of every kind available: a closed form, set right at the rounding edge."""
    n = bound
    for k, r in ratios.items():
        if r > 0:
            n = min(n, math.ceil((available.get(k, 0) + 1) / r) - 1)
    fits = lambda m: all(int(r * m) <= available.get(k, 0) for k, r in ratios.items())
    while n > 0 and not fits(n):
        n -= 1
    while n < bound and fits(n + 1):
        n += 1
    return n


def take_by_hash(df: DataFrame, kind: str, takes: dict[str, int], key: Column) -> DataFrame:
    """The first ``takes[kind]`` rows of each kind in the order of ``key``."""
    if not any(takes.values()):
        return df.where("false")
    n = None
    for k, v in takes.items():
        n = F.when(F.col(kind) == k, F.lit(v)) if n is None else n.when(F.col(kind) == k, F.lit(v))
    wanted = df.withColumn("_k", key).withColumn("_take", F.coalesce(n, F.lit(0))).where("_take > 0")
    return rank_by_hash(wanted, kind, "_k").where("_rank < _take").drop("_rank", "_k", "_take")


def balance_languages(files: DataFrame, ratios: dict[str, float] | None = None, drop_others: bool = True) -> DataFrame:
    """Files kept so that the languages stand in the given ratios; the order within one is by hash."""
    r = normalize(ratios or LANGUAGE_RATIOS)
    have = {x[0]: x[1] for x in files.where(F.col("language").isin(*r)).groupBy("language").count().collect()}
    if not have:
        return files
    n = largest_total(have, r, 2 * sum(have.values()) + 1)
    key = F.coalesce(F.nullif("hash", F.lit("")), F.sha2(F.concat_ws("/", "repository", "path"), 256))
    kept = take_by_hash(files, "language", {k: int(v * n) for k, v in r.items()}, key)
    return kept if drop_others else kept.unionByName(files.where(~F.coalesce(F.col("language"), F.lit("")).isin(*r)))


def seeded_order(df: DataFrame, seed: int, key: str = "idx") -> DataFrame:
    """A shuffle that any number of tasks computes alike: the order of a seeded hash."""
    return df.withColumn("_o", F.xxhash64(F.lit(seed), F.col(key))).orderBy("_o", key).drop("_o")


def shuffled_indices(n: int, seed: int) -> list[int]:
    """The order that Python's generator gives for ``range(n)`` (index lists that fit the driver)."""
    out = list(range(n))
    random.Random(seed).shuffle(out)
    return out


def holdout(df: DataFrame, share: float = 0.02, seed: int = 1337, key: str = "idx") -> DataFrame:
    """``is_val`` for the first ``max(1, int(n share))`` rows in seeded order."""
    n = df.count()
    take = max(1, int(n * share)) if n else 0
    ranked = rank_by_hash(df.withColumn("_all", F.lit(0)).withColumn("_k", F.xxhash64(F.lit(seed), F.col(key))), "_all", "_k", tie=key)
    return ranked.withColumn("is_val", F.col("_rank") < take).drop("_rank", "_k", "_all")


def worker_slice(pos: Column, workers: int, worker: int) -> Column:
    return F.pmod(pos, F.lit(workers)) == worker
