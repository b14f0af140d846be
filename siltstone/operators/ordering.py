"""Ranks, positions and running sums over whole tables without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import materialize

RANK_BUCKETS = 64


def global_positions(df: DataFrame, order: list[Column], weight: str | None = None, narrow: bool = False) -> DataFrame:
    """``pos`` (from 0) in the order, and with ``weight`` its running sum before the row as ``start``.

    With ``narrow`` the rows are written once as they are and only their keys and weights take part
    in the ordering; the positions are joined back by a row number. Use it where rows are wide.

    Rows are range-partitioned by the order and written once; each partition is ranked on its own
    and shifted by the sums of the partitions before it, whose number is the only thing that grows.
    """
    if narrow:
        rows = materialize(df.select("*", *(c.alias(f"_k{i}") for i, c in enumerate(order)), F.monotonically_increasing_id().alias("_rid")), "rows")
        keys = rows.select("_rid", *(f"_k{i}" for i in range(len(order))), *([F.col(weight).alias("_weight")] if weight else []))
        placed = global_positions(keys, [F.col(f"_k{i}") for i in range(len(order))], "_weight" if weight else None)
        placed = placed.select("_rid", "pos", *(["start"] if weight else []))
        return rows.join(placed, "_rid").drop("_rid", *(f"_k{i}" for i in range(len(order))))
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.select("*", *(c.alias(f"_o{i}") for i, c in enumerate(order)))
    names = [f"_o{i}" for i in range(len(order))]
    parts = materialize(keyed.repartitionByRange(n, *names).withColumn("_pid", F.spark_partition_id()), "ordered")
    w = F.col(weight).cast("long") if weight else F.lit(0).cast("long")
    sums = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0"))
    inside = Window.partitionBy("_pid").orderBy(*names)
    out = parts.withColumn("_r", F.row_number().over(inside) - 1).withColumn("_s", F.coalesce(F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(shift, "_pid").withColumn("pos", F.col("_r") + F.col("_n0"))
    if weight:
        out = out.withColumn("start", F.col("_s") + F.col("_w0"))
    return out.drop("_pid", "_r", "_s", "_n0", "_w0", *names)


def rank_by_hash(df: DataFrame, group: str, key: str, tie: str | None = None) -> DataFrame:
    """``_rank`` (from 0) of each row in its group by ``key``, a hash or any evenly spread value.

    A group of any size is cut into ordered buckets of the key's hash prefix; ranks inside a bucket
    are shifted by the counts of the buckets before it.
    """
    col = F.col(key)
    kind = dict(df.dtypes)[key]
    bucket = F.conv(F.substring(col, 1, 3), 16, 10).cast("int") if kind == "string" else (F.shiftright(col.cast("long"), 54))
    df = df.withColumn("_b", F.coalesce(bucket, F.lit(-1)))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    shift = counts.select(F.col(group).alias("_g"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    order = [key] + ([tie] if tie else [c for c in ("ord", "path") if c in df.columns])
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_b").orderBy(*order)) - 1)
    joined = ranked.join(shift, (ranked[group].eqNullSafe(shift["_g"])) & (ranked["_b"] == shift["_b2"]))
    return joined.withColumn("_rank", F.col("_r") + F.col("_n0")).drop("_r", "_b", "_b2", "_n0", "_g")


def count_by(df: DataFrame, key: str) -> DataFrame:
    """``key, n``: the most frequent first, ties by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def top_rankings(repos: DataFrame, n: int = 100) -> DataFrame:
    return repos.orderBy(F.desc("quality_score"), "repository").limit(n)
