"""Where jobs put written tables and stream checkpoints."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}  # of each application, the folder that holds all others


def local_session(cpus: int | str = 8, app: str = "ledgerloom") -> SparkSession:
    """The session used by tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("LEDGERLOOM_WORK", os.path.abspath("spark-warehouse/work")))
        .getOrCreate()
    )


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder named by ``spark.checkpoint.dir``, removed as the session ends.

    Where the setting is absent, the folder lies in the warehouse, which executors share too.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/work"
        top = f"{shared.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        qualified = files.makeQualified(path).toString()  # a path without a scheme may lie in the cluster's file system
        _folders[app] = top if qualified.startswith("file:") else qualified
    return f"{_folders[app]}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into a fresh folder and read back: computed once, with no lineage before it."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
