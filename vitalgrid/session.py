"""Session settings shared by tests, bench and the driver entry."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when the split costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows of texts and vectors are large; a batch is held on both sides of the pipe to Python
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # the driver keeps a description of every plan and of its every adaptive change; jobs of many joins have long ones
    "spark.sql.maxPlanStringLength": "4096",
    "spark.sql.ui.explainMode": "simple",
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "vitalgrid") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VITALGRID_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# scratch folder per local application, where the session names none; removed when Python ends
_OWN_SCRATCH: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; leaves cluster sizing alone."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's folder.

    Only a local[*] master, where all tasks run in one process, may do without; it gets a temporary
    folder of its own. Any other master without a shared folder is an error, since executors would
    write to disks that the others cannot read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"master {master} needs spark.checkpoint.dir, a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_SCRATCH:
        _OWN_SCRATCH[app] = tempfile.mkdtemp(prefix="vitalgrid-")
        atexit.register(shutil.rmtree, _OWN_SCRATCH[app], ignore_errors=True)
    return _OWN_SCRATCH[app]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared base."""
    return f"{shared_base(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executor loss.

    Zstandard: smaller than the default codec, and its buffers are on the heap, where the executor counts them.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
