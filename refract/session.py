"""Session helpers.

The library never creates machine-local scratch space on its own: anything
written between stages goes under ``spark.checkpoint.dir`` (a shared folder
on a cluster).  Only when that setting is absent and the master is local
(tests, a laptop) a local folder is taken and kept in the context.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "refract") -> SparkSession:
    """Session for tests and the local bench (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        # one BLAS thread per Python worker: tasks already use every core
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir`` or, where only that was set, from the
    context.  The setting itself is never changed.  With neither, a local
    folder is taken when the master is local; on a cluster that would be a
    machine-local path, so it is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="refract-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/refract/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: the lineage is cut, the result survives executor loss, and
    (unlike an RDD checkpoint) the plan is computed only once.  Large rows are
    written a few to a file (``rows_per_file``; 0: no bound)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.parquet(path)
