"""The corpus pipeline: language, licence, duplicates, quality, splits, balance, as drop reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.config import CorpusConfig
from siltstone.functions import languages
from siltstone.operators import cleaning, dedup, licensing, quality, splitting
from siltstone.session import materialize


@dataclass
class CorpusResult:
    files: DataFrame
    repos: DataFrame
    drops: DataFrame
    all_files: DataFrame


def ingest(raw: DataFrame, config: CorpusConfig | None = None, created_at: str = "") -> DataFrame:
    """``raw(repository, source, path, content BINARY, ord, license_hint)`` cleaned into corpus files."""
    cfg = config or CorpusConfig()
    lic = licensing.repository_license(raw)
    c = cleaning.clean(
        raw, max_bytes=cfg.max_file_bytes, min_bytes=cfg.min_file_bytes, max_line=cfg.max_line_length, strip_secrets=cfg.strip_secrets, drop_secret_files=cfg.drop_secret_files
    )
    hint = F.nullif(F.col("license_hint"), F.lit("")) if "license_hint" in raw.columns else F.lit(None).cast("string")
    return c.join(lic, "repository", "left").select(
        "repository",
        "path",
        "source",
        F.coalesce(F.nullif("license", F.lit("UNKNOWN")), hint, F.lit("UNKNOWN")).alias("license"),
        F.lit("unknown").alias("language"),
        F.sha2("content", 256).alias("hash"),
        F.octet_length("content").cast("long").alias("size"),
        F.lit(0.0).alias("quality_score"),
        F.lit(0.0).alias("file_quality"),
        F.lit("train").alias("split"),
        F.lit(created_at).alias("created_at"),
        F.col("reason").alias("drop_reason"),
        F.col("text").alias("content"),
        "ord",
    )


def process(files: DataFrame, config: CorpusConfig | None = None) -> CorpusResult:
    """Mark the files of ``files`` stage by stage; a file keeps the first reason it gets.

    Between the stages only ``ord`` and what a stage decides on is moved; texts are read where a
    stage needs them and joined to the decisions once, at the end.
    """
    cfg = config or CorpusConfig()
    have = lambda c, d: F.coalesce(F.col(c), d) if c in files.columns else d
    base = files.withColumn("drop_reason", have("drop_reason", F.lit(""))).withColumn("language", languages.annotate(F.col("language"), F.col("path"), F.col("content"))).withColumn("created_at", have("created_at", F.lit("")))
    policy = licensing.is_allowed(F.col("license"), cfg.allowed_licenses, cfg.allow_unknown_license, cfg.allow_copyleft)
    base = base.withColumn("drop_reason", F.when((F.col("drop_reason") == "") & ~policy, F.lit("license")).otherwise(F.col("drop_reason")))
    base = materialize(base, "corpus-base")
    state = base.select("ord", "repository", "hash", "drop_reason")

    def live(s: DataFrame) -> DataFrame:
        return s.where("drop_reason = ''")

    def mark(s: DataFrame, bad: DataFrame, reason: str, key: str = "ord") -> DataFrame:
        flagged = bad.select(key).distinct().withColumn("_bad", F.lit(True))
        out = s.join(flagged, key, "left").withColumn("drop_reason", F.when((F.col("drop_reason") == "") & F.coalesce("_bad", F.lit(False)), F.lit(reason)).otherwise(F.col("drop_reason")))
        return out.drop("_bad")

    if cfg.dedup_files:
        state = mark(state, dedup.mark_first_wins(live(state).select("ord", "hash"), "hash").where("duplicate"), "duplicate_file")
    if cfg.dedup_near:
        state = materialize(state, "corpus-exact")
        texts = base.join(live(state).select("ord"), "ord", "left_semi").select("ord", "content").where("content IS NOT NULL")
        state = mark(state, dedup.near_duplicates(texts, perms=cfg.minhash_perms, bands=cfg.minhash_bands, threshold=cfg.near_dup_threshold), "near_duplicate")
    if cfg.dedup_repos:
        state = mark(state, dedup.duplicate_repositories(live(state)).where("NOT keep"), "duplicate_repo", "repository")
    state = materialize(state, "corpus-distinct")

    rest = base.join(live(state).select("ord"), "ord", "left_semi")
    scored = quality.repository_signals(rest).withColumn("quality_score", quality.quality_score())
    scored = materialize(scored, "corpus-scores")
    state = materialize(mark(state, scored.where(F.col("quality_score") < cfg.min_quality), "low_quality", "repository"), "corpus-quality")
    if cfg.enforce_language_ratios:
        rest = base.join(live(state).select("ord"), "ord", "left_semi").select("ord", "repository", "path", "language", "hash")
        kept = splitting.balance_languages(rest, cfg.language_ratios).select("ord")
        state = mark(state, live(state).join(kept, "ord", "left_anti"), "language_ratio")

    score = scored.select("repository", F.col("quality_score").alias("_q"))
    out = base.drop("drop_reason").join(state.select("ord", "drop_reason"), "ord").join(score, "repository", "left")
    q = F.when(F.col("drop_reason") == "", F.col("_q")).otherwise(F.lit(0.0))
    out = out.withColumn("quality_score", q).withColumn("file_quality", q).withColumn("split", splitting.assign_split(F.col("repository"), cfg.split_ratios, cfg.seed)).drop("_q")
    out = materialize(out, "corpus")
    final = out.where("drop_reason = ''")
    return CorpusResult(final, repositories(final, scored), out.where("drop_reason <> ''").groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n")), out)


def repositories(final: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per repository that still has files, with roll-up, score and signals."""
    by = final.groupBy("repository", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.min(F.struct("ord", "source", "license", "split", "created_at")).alias("first"))
    g = by.groupBy("repository").agg(F.sum("n").alias("n_files"), F.sum("b").alias("n_bytes"), F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("languages"), F.min("first").alias("f"))
    names = [c for c in scored.columns if c not in ("repository", "quality_score")]
    s = scored.select("repository", "quality_score", F.struct(*names).alias("signals"))
    return g.join(s, "repository").select("repository", "f.source", "f.license", "quality_score", "n_files", "n_bytes", "languages", "f.split", "signals", "f.created_at")
