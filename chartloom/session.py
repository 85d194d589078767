"""Session helpers: a local session for tests and the bench, and the scratch folder of a job."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", name: str = "chartloom") -> SparkSession:
    """A ``local[cores]`` session; a cluster job brings its own session instead."""
    partitions = str(os.cpu_count() if cores == "*" else int(cores))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder for stage tables, stream checkpoints and stream outputs.

    It lies under ``spark.checkpoint.dir``, the shared folder a cluster names. Only a local session
    may go without that setting; it then gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="chartloom-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def table_folder(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_folder(sf_dir, name))
