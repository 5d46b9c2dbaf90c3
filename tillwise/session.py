"""Session helpers: where shared files go and how a local session is started."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, name: str = "tillwise", **conf: str) -> SparkSession:
    """Session for tests and the bench. On a cluster the submitted settings are used as they are."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can read and write, as named by ``spark.checkpoint.dir``.

    Only where the setting is absent (a local run) is a folder of our own made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder shared by all executors.")
    own = tempfile.mkdtemp(prefix="tillwise-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own
