"""Record stores and exports: JSON lines, Parquet, raw trees."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.schemas import FILES, REPOS


def kept(files: DataFrame) -> DataFrame:
    return files.where(F.coalesce("drop_reason", F.lit("")) == "")


def _sorted(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def write_records(files: DataFrame, path: str, *, content: bool = True, mode: str = "overwrite") -> None:
    df = kept(files)
    _sorted(df if content else df.drop("content")).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Strict: malformed lines raise; a missing store is empty."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], FILES)
    return spark.read.schema(FILES).option("mode", "FAILFAST").json(path)


def write_by_split(files: DataFrame, folder: str) -> DataFrame:
    """One folder of JSON lines per split; returns the counts."""
    df = kept(files)
    df.write.mode("overwrite").partitionBy("split").json(folder)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def write_repos(repos: DataFrame, path: str) -> None:
    _sorted(repos).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPOS).option("mode", "FAILFAST").json(path)


def write_tasks(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").json(path)


def write_parquet(files: DataFrame, path: str) -> None:
    """Kept rows with the columns sorted by name; an empty table keeps its types."""
    _sorted(kept(files)).write.mode("overwrite").parquet(path)


def safe_path(path: str) -> str:
    return "/".join(p for p in path.replace("\\", "/").split("/") if p not in ("", ".", ".."))


def write_raw(files: DataFrame, folder: str, by_split: bool = True) -> int:
    """``<split>/<repository>/<path>`` below a folder that all executors share; returns the number written."""

    def write(batches):
        import pandas as pd

        n = 0
        for pdf in batches:
            for r in pdf.itertuples():
                parts = [folder, *([r.split or "none"] if by_split else []), safe_path(r.repository), safe_path(r.path)]
                target = os.path.join(*parts)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "w", encoding="utf-8", newline="") as f:
                    f.write(r.content)
                n += 1
        yield pd.DataFrame({"n": [n]})

    df = kept(files).where("content IS NOT NULL").select("split", "repository", "path", "content")
    return df.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def append_log(path: str, step: int, metrics: dict, kind: str = "train") -> None:
    """One JSON line of a training run: the step, its kind, and the metrics."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps({"step": step, "kind": kind, **metrics}) + "\n")


TRAIN_LOG = "step long, kind string, loss double, val_loss double, lr double, tokens_per_second double"


def read_train_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the ``eval`` kind, and all others."""
    log = spark.read.schema(TRAIN_LOG).json(path)
    is_eval = F.coalesce("kind", F.lit("")) == "eval"
    return log.where(is_eval), log.where(~is_eval)


def best_perplexity(evals: DataFrame) -> DataFrame:
    return evals.agg(F.exp(F.least(F.min("val_loss"), F.lit(20.0))).alias("best_perplexity"))
