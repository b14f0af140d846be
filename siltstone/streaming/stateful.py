"""Streams: first-wins deduplication, running and windowed counts, packing, shard rotation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """A time without zone can't carry a watermark; it is read as UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def dedup_stream(df: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key. With a time column state is let go once the watermark passes."""
    if time is None:
        return df.dropDuplicates(keys)
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def reason_counts(df: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """Running counts by reason (complete or update mode)."""
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(df: DataFrame, time: str, key: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts by key and tumbling window; rows later than the watermark are left out, windows are final."""
    g = df.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), key, "n")


def pack_stream(df: DataFrame, lane: str, seq_len: int) -> DataFrame:
    """``lane, chunk_no, token_ids``: every full chunk of each lane as soon as its ids are there.

    A lane (a source, a repository, a hash bucket) keeps fewer than ``seq_len`` ids as state between
    the batches; rows of a lane are taken in the order of ``ord`` within a batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, rest = state.get if state.exists else (0, [])
        rest = list(rest)
        out: list[tuple[int, list[int]]] = []
        rows = [r for b in batches for r in zip(b["ord"], b["token_ids"], strict=True)]
        for _, ids in sorted(rows, key=lambda r: r[0]):
            rest += [int(x) for x in ids] if ids is not None else []
            while len(rest) >= seq_len:
                out.append((number, rest[:seq_len]))
                rest = rest[seq_len:]
                number += 1
        state.update((number, rest))
        if out:
            yield pd.DataFrame({"lane": [key[0]] * len(out), "chunk_no": [n for n, _ in out], "token_ids": [x for _, x in out]})

    kind = dict(df.dtypes)[lane]
    return (
        df.select(F.col(lane).alias("lane"), "ord", "token_ids")
        .groupBy("lane")
        .applyInPandasWithState(step, f"lane {kind}, chunk_no long, token_ids array<int>", "number long, rest array<int>", "append", GroupStateTimeout.NoTimeout)
    )


def write_batches(df: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """Every micro-batch becomes Parquet under its batch id, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class EarlyStopping:
    """Tells when a metric has not become better for ``patience`` checks."""

    def __init__(self, patience: int = 3, min_delta: float = 0.0):
        self.patience, self.min_delta = patience, min_delta
        self.best, self.waited = float("inf"), 0

    def update(self, value: float) -> bool:
        if value < self.best - self.min_delta:
            self.best, self.waited = value, 0
        else:
            self.waited += 1
        return self.waited >= self.patience
