"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "tessera", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested with (UTC, AQE, ANSI as Spark's default)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; only where that is unset and the session
    is local (as in tests) a folder of this machine, which is then set for the session. On a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through the file system it lies on."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(spark: SparkSession, df, name: str):
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def spread(df):
    """``df`` over all cores where a scan of few splits would leave most of them idle before costly Python work.

    Only a plain scan is spread, and only one with fewer splits than cores: that bounds what is moved by the size of a
    split times the number of cores, however large the corpora are that need no spreading.
    """
    plan = df._jdf.queryExecution().sparkPlan().toString()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in plan or "Join" in plan or "Aggregate" in plan or df.isStreaming:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
