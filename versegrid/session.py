"""Session settings and the shared staging folder.

Jobs that must cut lineage (iterative clustering and learning) or fix a partition
order write a Parquet table below ``spark.checkpoint.dir``. On a cluster that
setting names storage every executor can reach, so a lost executor costs a task
retry and never a lost intermediate result.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set by spark-submit and by those who pass its arguments on.
SUBMITTED = ("PYSPARK_GATEWAY_PORT", "PYSPARK_SUBMIT_ARGS", "SPARK_CONF_DIR")
_local_roots: dict[str, str] = {}


def build_session(app_name: str = "versegrid", cores: int | None = None) -> SparkSession:
    """A session for local runs; a submitted job keeps all that it was submitted with."""
    builder = SparkSession.builder.appName(app_name)
    if any(name in os.environ for name in SUBMITTED) or SparkSession.getActiveSession():
        return builder.getOrCreate()
    cores = cores or os.cpu_count() or 8
    return (
        builder.master(f"local[{cores}]")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _local_roots:
        root = _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="versegrid-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return _local_roots[context.applicationId]


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the staging folder."""
    return f"{staging_root(spark)}/versegrid/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the staging folder and continue from the stored table."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`stage` once nothing reads it."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    marker = "/versegrid/"
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles() if marker in f}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)
