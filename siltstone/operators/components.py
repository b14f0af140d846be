"""Connected components by alternating large-star and small-star rounds.

Each round is one shuffle per star; the number of rounds grows with the logarithm of the longest
path. Edges live in checkpointed tables in the cluster's shared folder, nothing is collected, and a
node with very many neighbours is handled by hash aggregation (a minimum), never by a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import checkpoint


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    own = low.select("u", F.col("m").alias("v"))
    return moved.unionAll(own).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Component label (smallest member) of every node that occurs in ``edges``.

    Returns ``(node, component)``. Rows with a NULL end are ignored, self-links give a component
    of one, repeated links do no harm, and no links give an empty frame.
    """
    raw = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    raw = checkpoint(raw.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = raw.select(F.col("u").alias("node")).unionAll(raw.select(F.col("v").alias("node"))).distinct()
    cur, before = raw.where("u <> v"), None
    for _ in range(max_rounds):
        cur = checkpoint(_small_star(_large_star(cur)))
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
