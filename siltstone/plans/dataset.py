"""The dataset pipeline: clean, validate, score, encode, middle-filling, order, pack, shard."""

from __future__ import annotations

import os
import platform
import sys
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.config import DatasetConfig
from siltstone.functions import bpe, languages
from siltstone.operators import chunking, cleaning, dedup, licensing, quality, tasks
from siltstone.session import materialize


class EmptyDatasetError(ValueError):
    """Nothing is left to write."""


@dataclass
class DatasetResult:
    records: DataFrame
    chunks: DataFrame
    drops: DataFrame
    packing: DataFrame
    stats: DataFrame


def _ids(df: DataFrame, tokenizer: bpe.Bpe | None, cfg: DatasetConfig) -> Column:
    if tokenizer is None:
        ids, bos, eos = bpe.byte_ids(F.col("text")), bpe.BYTE_BOS, bpe.BYTE_EOS
    else:
        end = tokenizer.specials.get("<|endoftext|>")
        return bpe.encode_column(tokenizer, df, bos=end if cfg.add_bos else None, eos=end if cfg.add_eos else None)
    if cfg.add_bos:
        ids = F.concat(F.array(F.lit(bos)), ids)
    return F.concat(ids, F.array(F.lit(eos))) if cfg.add_eos else ids


def build(raw: DataFrame, config: DatasetConfig | None = None, tokenizer: bpe.Bpe | None = None) -> DatasetResult:
    """From ``raw(ord, repo, path, content BINARY)`` to packed chunks. Byte ids without a tokenizer."""
    cfg = config or DatasetConfig()
    vocab = tokenizer.vocab_size if tokenizer else bpe.BYTE_VOCAB
    if vocab > 65536 and cfg.itemsize == 2:
        raise ValueError("the tokenizer's ids do not fit the configured width")
    named = raw.withColumnRenamed("repo", "repository")
    cleaned = cleaning.dataset_clean(raw, cfg.dedup_files)
    texts = cleaned.withColumn("text", F.when(F.col("reason") == "", F.col("content").cast("string"))).drop("content")
    texts = texts.withColumn("language", languages.detect_dataset(F.col("path"), F.col("text"))).withColumnRenamed("reason", "_r")
    valid = cleaning.validate(texts, min_bytes=cfg.min_file_bytes, max_bytes=cfg.max_file_bytes)
    valid = valid.withColumn("reason", F.when(F.col("_r") != "", F.col("_r")).otherwise(F.col("reason"))).drop("_r")
    info = licensing.repository_info(named).select(F.col("repository").alias("repo"), "has_readme", "has_license", "license")
    state = materialize(valid.join(info, "repo", "left"), "dataset-valid")
    scored = quality.file_quality(state.where("reason = ''"))
    scored = materialize(scored, "dataset-scored")
    good = scored.where(F.col("quality") >= cfg.min_quality)
    code = good.withColumn("token_ids", _ids(good, tokenizer, cfg)).withColumn("sub_ord", F.lit(0)).withColumn("kind", F.lit("code"))
    code = code.withColumn("n_tokens", F.size("token_ids")).withColumn("difficulty", quality.difficulty(quality.complexity(F.col("n_tokens"))))
    keep = ["ord", "sub_ord", "repo", "path", "language", "text", "kind", "quality", "difficulty", "token_ids", "n_tokens", "functions", "n_imports", "comment_lines"]
    code = code.withColumn("functions", F.col("s.functions")).withColumn("n_imports", F.size("imports")).select(*keep)
    records = code
    if cfg.fim_enabled:
        f = tasks.fim_records(good, rate=cfg.fim_rate, min_chars=cfg.fim_min_chars, seed=cfg.seed)
        f = f.withColumn("token_ids", _ids(f, tokenizer, cfg)).withColumn("n_tokens", F.size("token_ids")).withColumn("difficulty", F.lit("medium"))
        f = f.join(good.select("ord", "quality"), "ord").withColumn("functions", F.lit(0)).withColumn("n_imports", F.lit(0)).withColumn("comment_lines", F.lit(0))
        records = code.unionByName(f.select(*keep))
    records = materialize(records, "dataset-records")
    if records.isEmpty():
        raise EmptyDatasetError("no file passed the filters")
    order = [quality.difficulty_rank(F.col("difficulty")), -F.col("quality"), F.col("repo"), F.col("path"), F.col("ord"), F.col("sub_ord")]
    pad = tokenizer.specials.get("<|pad|>", 0) if tokenizer else bpe.BYTE_PAD
    chunks = materialize(chunking.pack_stream(records, order, seq_len=cfg.seq_len, overlap=cfg.overlap, pad=pad), "dataset-chunks")
    if cfg.dedup_chunks:
        chunks = dedup.mark_duplicate_chunks(chunks).where("NOT duplicate").drop("duplicate")
    low = scored.where(F.col("quality") < cfg.min_quality).select(F.lit("low_quality").alias("reason"))
    drops = state.where("reason <> ''").select("reason").unionByName(low).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    stats = chunking.dataset_stats(records.withColumn("raw_bytes", F.octet_length("text").cast("long")))
    return DatasetResult(records, chunks, drops, chunking.packing_stats(chunks, cfg.seq_len), stats)


def write(result: DatasetResult, folder: str, config: DatasetConfig, tokenizer: bpe.Bpe | None = None, now: str | None = None, source_root: str = ".") -> dict:
    """Shards, manifest with lock, and the validation report; returns the manifest."""
    from siltstone.plans.report import validation_report, write_report
    from siltstone.sources import shards

    os.makedirs(folder, exist_ok=True)
    vocab = tokenizer.vocab_size if tokenizer else bpe.BYTE_VOCAB
    rows = shards.write_shards(result.chunks, folder, seq_len=config.seq_len, vocab_size=vocab, shard_max_bytes=config.shard_max_bytes)
    rows = materialize(rows, "shards")
    stats = result.stats.first().asDict() | {"packing": result.packing.first().asDict() | {"seq_len": config.seq_len}}
    stats["compression_ratio"] = round(stats["raw_bytes"] / (stats["packing"]["real_tokens"] * config.itemsize), 3) if stats["packing"]["real_tokens"] else 0.0
    stats["drops"] = {r["reason"]: r["n"] for r in result.drops.collect()}
    for key in ("language", "difficulty"):
        stats[f"{key}_split"] = {r[0]: r[1] for r in result.records.groupBy(key).count().collect()}
    m = shards.manifest(rows, folder, seq_len=config.seq_len, vocab_size=vocab, stats=stats, lock=build_lock(config, tokenizer, source_root=source_root, now=now))
    if not m["shards"]:
        raise EmptyDatasetError("no chunk was written")
    write_report(validation_report(m), folder)
    return m


def tokenizer_hash(tokenizer: bpe.Bpe | None) -> str:
    return tokenizer.fingerprint() if tokenizer else bpe.Bpe().fingerprint(0)


def build_lock(config: DatasetConfig, tokenizer: bpe.Bpe | None, *, source_root: str = ".", model_version: str = "", now: str | None = None) -> dict:
    return {
        "dataset_version": config.dataset_version, "rds_version": config.rds_version, "tokenizer_version": config.tokenizer_version, "tokenizer_hash": tokenizer_hash(tokenizer), "model_version": model_version,
        "creation_time": now or datetime.now(UTC).isoformat(), "python_version": sys.version.split()[0], "platform": platform.platform(), "seed": config.seed, "source_root": os.path.abspath(source_root), "config": config.to_dict(),
    }


def verify_lock(lock: dict, config: DatasetConfig, tokenizer: bpe.Bpe | None) -> list[str]:
    """What differs between a lock and the configuration and tokenizer at hand."""
    bad = [k for k, v in (("tokenizer_hash", tokenizer_hash(tokenizer)), ("seed", config.seed), ("rds_version", config.rds_version)) if lock.get(k) != v]
    snap = lock.get("config", {})
    return bad + [f"config.{k}" for k in ("seq_len", "vocab_size", "overlap", "add_bos", "add_eos") if snap.get(k) != getattr(config, k)]


def export_by_split(files: DataFrame, folder: str, config: DatasetConfig, tokenizer: bpe.Bpe | None = None, splits=("train", "validation", "test")) -> dict[str, dict]:
    """Shards of each split of kept corpus files, without a raw tree in between; empty splits are left out."""
    out = {}
    kept = files.where((F.coalesce("drop_reason", F.lit("")) == "") & F.col("content").isNotNull())
    for split in splits:
        raw = kept.where(F.col("split") == split).select("ord", F.col("repository").alias("repo"), "path", F.col("content").cast("binary").alias("content"))
        try:
            out[split] = write(build(raw, config, tokenizer), os.path.join(folder, split), config, tokenizer)
        except EmptyDatasetError:
            continue
    return out


def experiment_metadata(run_name: str, manifest: dict, *, seed: int, model_version: str = "") -> dict:
    """What a training run has to note to find its data again."""
    lock = manifest.get("lock", {})
    return {"run_name": run_name, "model_version": model_version, "seed": seed, **{k: lock.get(k) for k in ("tokenizer_hash", "dataset_version", "rds_version")}}
