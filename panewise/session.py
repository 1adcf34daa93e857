"""Session helpers for tests, benches and local runs; a cluster brings its own session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "panewise") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. A session on one machine gets a folder of its own if
    none is named; on a cluster that would lose data, so there it is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if spark.sparkContext.getCheckpointDir() is None:
        if not on_one_machine(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panewise-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def on_one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediate tables, below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/panewise-{name}-{uuid.uuid4().hex}"


def written(table: DataFrame, path: str, **options) -> DataFrame:
    """Write a table and read it back: its lineage ends there, and a lost executor costs a
    re-read instead of a re-computation."""
    table.write.mode("overwrite").options(**options).parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
