"""Token streams cut into chunks of one length, shards, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ordering import global_positions
from siltstone.operators.quality import difficulty_rank


def curriculum_order(records: DataFrame) -> DataFrame:
    """``pos``: easy before hard, better before worse, then repository and path, then ``ord``."""
    return global_positions(records, _curriculum_keys())


def _curriculum_keys() -> list[Column]:
    return [difficulty_rank(F.col("difficulty")), -F.col("quality"), F.col("repo"), F.col("path"), F.col("ord")]


def pack_stream(records: DataFrame, order: list[Column] | None = None, *, seq_len: int = 4096, overlap: int = 0, pad: int = 0, lengths_only: bool = False, total: int | None = None) -> DataFrame:
    """``chunk_id, token_ids, n_pad, first``: the ids of all records in order, cut every ``seq_len``.

    Every record finds the chunks that it meets from the running sum of lengths before it, and
    brings each the slice that lies inside it; a chunk gathers at most ``seq_len`` ids. ``first`` is
    the record at the chunk's start. The rest at the end is padded. NULL and empty lists add nothing.
    """
    if not 0 <= overlap < seq_len:
        raise ValueError("the overlap must be smaller than the sequence")
    step = seq_len - overlap
    docs = records.where(F.size("token_ids") > 0).withColumn("_len", F.size("token_ids"))
    docs = global_positions(docs, order or _curriculum_keys(), "_len", narrow=not lengths_only)
    if total is None:
        total = docs.agg(F.coalesce(F.sum("_len"), F.lit(0))).first()[0]
    full = (total - seq_len) // step + 1 if total >= seq_len else 0
    n_chunks = full + (1 if total - full * step > 0 else 0)
    start, end = F.col("start"), F.col("start") + F.col("_len")
    lowest = F.greatest(F.lit(0), F.floor((start - seq_len) / step) + 1).cast("long")
    highest = F.least(F.floor((end - 1) / step), F.lit(n_chunks - 1)).cast("long")
    # A record's slices are cut before it is exploded, so no exploded row carries the whole record.
    docs = docs.select("ord", "start", "_len", F.col("token_ids") if not lengths_only else F.lit(None).alias("token_ids"), lowest.alias("_lo"), highest.alias("_hi")).where("_lo <= _hi")

    def piece(c: Column) -> Column:
        a, b = F.greatest(start, c * step), F.least(end, c * step + seq_len)
        part = [a.alias("at"), (b - a).alias("n"), F.col("ord").alias("ord")]
        if not lengths_only:
            part.append(F.slice("token_ids", (a - start + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).alias("x"))
        return F.struct(c.alias("chunk_id"), F.struct(*part).alias("p"))

    met = docs.select(F.explode(F.transform(F.sequence("_lo", "_hi"), piece)).alias("e")).where("e.p.n > 0")
    g = met.select("e.chunk_id", "e.p").groupBy("chunk_id")
    if lengths_only:
        out = g.agg(F.sum("p.n").alias("n"), F.min_by("p.ord", "p.at").alias("first"))
        return out.select("chunk_id", (F.lit(seq_len) - F.col("n")).cast("int").alias("n_pad"), "first")
    out = g.agg(F.array_sort(F.collect_list("p")).alias("ps"))
    ids = F.flatten(F.transform("ps", lambda p: p["x"]))
    n_pad = F.lit(seq_len) - F.size(ids)
    return out.select("chunk_id", F.concat(ids, F.array_repeat(F.lit(pad), n_pad)).alias("token_ids"), n_pad.alias("n_pad"), F.element_at("ps", 1)["ord"].alias("first"))


def shard_of(rank: Column, *, seq_len: int, itemsize: int, shard_max_bytes: int) -> Column:
    """A shard is left once it holds ``shard_max_bytes``; chunks have one length, so a division tells."""
    per = max(1, -(-shard_max_bytes // (seq_len * itemsize)))
    return F.floor(rank / per).cast("int")


def packing_stats(chunks: DataFrame, seq_len: int, raw_bytes: Column | None = None, itemsize: int = 2) -> DataFrame:
    """Capacity, real and padded ids, efficiency and use of the context."""
    a = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_pad"), F.lit(0)).alias("pad_tokens"))
    cap = F.col("n") * seq_len
    real = cap - F.col("pad_tokens")
    safe = lambda c: F.when(F.col("n") > 0, c).otherwise(F.lit(0.0))
    return a.select(
        F.col("n").alias("total_chunks"),
        cap.alias("capacity_tokens"),
        real.alias("real_tokens"),
        "pad_tokens",
        safe(F.round(100 * F.col("pad_tokens") / cap, 3)).alias("padding_pct"),
        safe(F.round(100 * real / cap, 2)).alias("packing_efficiency_pct"),
        safe(F.round(real / F.col("n"), 1)).alias("avg_context_usage"),
    )


def dataset_stats(records: DataFrame) -> DataFrame:
    """One row: files, fim files, tokens, longest, averages and raw bytes of the kept records."""
    mean = lambda c: F.coalesce(F.round(F.sum(c) / F.count(F.lit(1)), 2), F.lit(0.0))
    return records.agg(
        F.count(F.lit(1)).alias("files_kept"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.max("n_tokens"), F.lit(0)).alias("longest_sequence"),
        mean(F.coalesce("n_tokens", F.lit(0))).alias("avg_tokens_per_file"),
        mean(F.coalesce("quality", F.lit(0))).alias("avg_quality"),
        mean(F.coalesce("functions", F.lit(0))).alias("avg_functions"),
        mean(F.coalesce("n_imports", F.lit(0))).alias("avg_imports"),
        mean(F.coalesce("comment_lines", F.lit(0))).alias("avg_comments"),
        F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw_bytes"),
    )


def compression_ratio(raw_bytes: Column, real_tokens: Column, itemsize: int) -> Column:
    return F.when(real_tokens > 0, F.round(raw_bytes / (real_tokens * itemsize), 3)).otherwise(F.lit(0.0))


def shifted(ids: Column) -> tuple[Column, Column]:
    """Model input and target: all ids but the last, all but the first."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, 1, n), F.slice(ids, 2, n)


def train_metrics(log: DataFrame, every: int = 10) -> DataFrame:
    """``block, avg_loss, perplexity, tokens_per_second`` over blocks of ``every`` steps."""
    g = log.groupBy(F.floor((F.col("step") - 1) / every).alias("block")).agg(F.avg("loss").alias("avg_loss"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))
    return g.select("block", "avg_loss", F.exp(F.least(F.lit(20.0), F.col("avg_loss"))).alias("perplexity"), F.when(F.col("seconds") > 0, F.col("tokens") / F.col("seconds")).alias("tokens_per_second"))


def learning_rate(step: Column, warmup: int, total: int, peak: float, floor: float = 0.0) -> Column:
    """Linear warm-up, then a cosine down to ``floor``."""
    share = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, F.lit(peak) * (step + 1) / max(1, warmup)).otherwise(F.lit(floor) + (peak - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * share)))
