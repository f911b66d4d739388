"""Session helpers shared by every module: building a session, shipping the package, staging."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = str(Path(__file__).resolve().parent.parent)


def get_session(app_name: str = "gleanworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC time; cluster settings stay as submitted."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Put the package's folder on the Python workers' path (a no-op where it is installed)."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if PACKAGE_ROOT not in known:
        env["PYTHONPATH"] = ":".join([PACKAGE_ROOT, *known])


#: Bytes of the batches that Spark sends to workers, where the session leaves that at Spark's own default: both sides hold whole ones.
BATCH_BYTES, DEFAULT_BYTES = "8m", "67108864b"


def lean_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, for rows that hold whole texts or blocks."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, DEFAULT_BYTES) == DEFAULT_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def staging_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local master may go without it (tests); it then gets a temporary folder.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(root)
    return root


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared staging folder as Parquet and read it back.

    This cuts lineage: later jobs read files that survive the loss of any executor. The
    folder is deleted when the application ends.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{staging_root(spark)}/staged-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def staged_count(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``staged``, and the number of rows, counted while they are written."""
    seen = Observation()
    written = staged(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return written, seen.get["n"]


def small(df: DataFrame, limit: int, name: str = "small") -> DataFrame:
    """``df`` written once, and marked for broadcast where it has no more than ``limit`` rows."""
    written, n = staged_count(df, name)
    return F.broadcast(written) if n <= limit else written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` where a table has fewer parts than the session has cores.

    A small table lies in one file and would be one task; a large one is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
