"""Queries of the operators in this folder; each runs over its whole tables."""

from __future__ import annotations

import secrets as secrets_of_python
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import encode, leakage, license, overlap, packing, personal, secrets, splits, sql, syntax, vendored
from siltstone.session import ship, table


def _on(*names: str):
    """Turn an operator over tables into a query of (spark, sf_dir)."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(*(table(spark, sf_dir, n) for n in names))

        return query

    return wrap


def _secret(df: DataFrame) -> str:
    """The key of the surrogates, from the session; a query run without one gets a key of its own that nobody keeps."""
    return df.sparkSession.conf.get("spark.siltstone.surrogateKey", None) or secrets_of_python.token_hex(32)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _on("files", "repos", "staged_repos")(splits.leaking_repositories),
        "p1_splits": _on("files", "repos", "staged_repos")(splits.assign_splits),
        "p1_report": _on("files", "repos", "staged_repos")(splits.split_report),
        "p2_found": _on("records", "files")(overlap.pairs_found),
        "p2_report": _on("records", "files")(overlap.overlap_report),
        "p3_found": _on("records")(lambda r: syntax.syntax_failures(r).select("ord")),
        "p3_rates": _on("records")(syntax.syntax_rates),
        "p4_found": _on("records")(lambda r: vendored.not_handwritten(r).select("ord").distinct()),
        "p4_marked": _on("records")(vendored.marked_files),
        "p4_copies": _on("records")(vendored.copied_files),
        "p4_report": _on("records")(vendored.handwritten_report),
        "p5_found": _on("records")(secrets.secret_lines),
        "p5_redacted": _on("records")(secrets.redact_records),
        "p6_found": _on("records", "repos", "staged_repos")(license.licenses_found),
        "p6_repositories": _on("records", "repos", "staged_repos")(license.repository_report),
        "p7_chunks": _on("records")(packing.pack),
        "p7_report": _on("records")(lambda r: packing.pack_report(packing.pack(r))),
        "p8_ids": _on("documents")(encode.encode_corpus),
        "p9_found": _on("documents", "eval_items")(lambda d, e: leakage.find_leaks(d, e).select("doc_id", "item_id").distinct()),
        "p9_removed": _on("documents", "eval_items")(lambda d, e: leakage.remove_leaks(d, leakage.find_leaks(d, e))),
        "p10_found": _on("documents")(personal.personal_lines),
        "p10_replaced": _on("documents")(lambda d: personal.replace_personal(d, _secret(d))),
        "p10_surrogates": _on("documents")(lambda d: personal.surrogate_report(d, _secret(d))),
    }


def oracle_sql() -> dict[str, str]:
    """For what SQL can express; the rest is held against plain models in tests/llm."""
    return {k: v.strip() for k, v in sql.ORACLES.items()}
