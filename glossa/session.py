"""Session helpers: a tuned local session for tests, and the shared scratch folder.

Scratch output (round trips, streaming sinks, lineage cuts) always goes below the
folder the cluster names in ``spark.checkpoint.dir``.  Only when that setting is
unset (local tests) do we create one under the system temp dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SCRATCH_ROOT: str | None = None


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "glossa") -> SparkSession:
    """A local session configured like the cluster profile (AQE on, UI off)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Text stages are CPU-heavy behind small shuffles (narrow keys): keep
        # enough partitions to use every core instead of 1MB minimum pieces.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GLOSSA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; set a local one only if unset."""
    global _SCRATCH_ROOT
    conf = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return spark.sparkContext.getCheckpointDir() or conf
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _SCRATCH_ROOT is None:
        # Unset only in tests / local runs: a fresh folder per process.
        _SCRATCH_ROOT = tempfile.mkdtemp(prefix="glossa-ckpt-")
    spark.sparkContext.setCheckpointDir(_SCRATCH_ROOT)
    return spark.sparkContext.getCheckpointDir() or _SCRATCH_ROOT


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/glossa-scratch/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared checkpoint folder and read it back: lineage is cut, and nothing is
    computed again by later jobs or for a lost executor."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_glossa_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="glossa-"), "glossa_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._glossa_shipped = True
