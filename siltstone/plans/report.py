"""Reports of the two pipelines as JSON and HTML."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ordering import count_by


def corpus_report(files: DataFrame, repos: DataFrame, drops: DataFrame | None = None, examples: DataFrame | None = None, name: str = "corpus", version: str = "1.0.0") -> dict:
    """Sizes, distributions, duplicates, quality histogram and the hundred best repositories."""
    size = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    pairs = lambda df: {r[0]: r[1] for r in df.collect()}
    reasons = pairs(drops) if drops is not None else {}
    bins = pairs(repos.groupBy(F.least(F.lit(9), F.floor(F.col("quality_score") / 10)).cast("int")).count())
    best = repos.orderBy(F.desc("quality_score"), "repository").limit(100).select("repository", "quality_score", "n_files", "license", "split")
    return {
        "name": name, "version": version, "dataset_size": {"files": size["n"], "repositories": repos.count(), "bytes": size["b"], "megabytes": round(size["b"] / 1e6, 3)},
        **{f"{k}_distribution": pairs(count_by(files, k)) for k in ("language", "license", "split")},
        "duplicate_statistics": {k: reasons.get(k, 0) for k in ("duplicate_file", "near_duplicate", "duplicate_repo")}, "drop_reasons": reasons,
        "quality_histogram": [bins.get(i, 0) for i in range(10)], "repository_rankings": [r.asDict() for r in best.collect()],
        "task_distribution": pairs(count_by(examples, "task")) if examples is not None else {},
    }


def validation_report(manifest: dict) -> dict:
    s, p = manifest["stats"], manifest["stats"]["packing"]
    d = s.get("drops", {})
    keep = ("files_kept", "avg_quality", "avg_functions", "avg_imports", "avg_comments", "longest_sequence", "total_tokens", "compression_ratio")
    return {
        "dataset_version": manifest["lock"].get("dataset_version"), "created": manifest["lock"].get("creation_time"), "files_processed": s["files_kept"] + sum(d.values()),
        **{k: s[k] for k in keep}, **{f"{k}_removed": d.get(k, 0) for k in ("duplicate", "generated", "vendor", "binary", "empty")}, "encoding_failures": d.get("non_utf8", 0),
        "languages": s.get("language_split", {}), "difficulty_split": s.get("difficulty_split", {}), **{k: p[k] for k in ("packing_efficiency_pct", "padding_pct", "avg_context_usage", "seq_len", "total_chunks")},
        "chunk_duplicate_pct": s.get("chunk_duplicate_pct", 0.0), "n_shards": manifest["n_shards"],
    }


def health_flags(r: dict) -> list[tuple[str, str]]:
    eff = r["packing_efficiency_pct"]
    out = [("ok" if eff >= 95 else "warn" if eff >= 80 else "bad", f"packing efficiency {eff} %")]
    if not r["files_kept"]:
        out.append(("bad", "no file was kept"))
    if r["chunk_duplicate_pct"] > 30:
        out.append(("warn", f"{r['chunk_duplicate_pct']} % of the chunks are duplicates"))
    if r["avg_quality"] < 40:
        out.append(("warn", f"average quality {r['avg_quality']}"))
    return out


def to_html(report: dict, title: str, flags=()) -> str:
    cell = lambda v: html.escape(json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v))
    rows = "".join(f"<tr><th>{html.escape(k)}</th><td>{cell(v)}</td></tr>\n" for k, v in report.items())
    marks = "".join(f'<li class="{level}">{html.escape(text)}</li>\n' for level, text in flags)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>{marks}</ul><table>\n{rows}</table>\n"


def write_report(report: dict, folder: str, stem: str = "report", title: str = "Report") -> tuple[str, str]:
    os.makedirs(folder, exist_ok=True)
    j, h = os.path.join(folder, stem + ".json"), os.path.join(folder, stem + ".html")
    with open(j, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=1, ensure_ascii=False, default=str)
    with open(h, "w", encoding="utf-8") as f:
        f.write(to_html(report, title, health_flags(report) if "packing_efficiency_pct" in report else ()))
    return j, h
