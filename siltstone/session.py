"""Session helpers: table access, shared scratch tables, package shipping."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(shared)
        return shared
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
        own = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike an RDD checkpoint the table is columnar and compressed, later readers prune its columns,
    and it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


_TABLES: list[str] = []


def clean_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this process wrote; results that still read them become unusable."""
    jvm, n = spark._jvm, len(_TABLES)
    while _TABLES:
        path = jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def checkpoint(df: DataFrame) -> DataFrame:
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, as they need not share the driver's import path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="siltstone-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "siltstone.zip")
    with zipfile.ZipFile(target, "w") as z:
        for base, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.join("siltstone", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)


def spread(df: DataFrame, weight: int = 1) -> DataFrame:
    """Repartition a scan to the session's parallelism when its files give fewer partitions.

    A Python-heavy stage over one small file would otherwise run in a single task; at cluster
    scale the scan already has more partitions than cores and the frame is returned unchanged.
    """
    spark = df.sparkSession
    want = max(1, spark.sparkContext.defaultParallelism) * weight
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def log2_ceil(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n))))
