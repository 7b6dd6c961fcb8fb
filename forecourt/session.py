"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession

# HTML pages are large values, so fewer of them go to Python in one Arrow batch.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build_session(name: str = "forecourt", master: str | None = None, **settings) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def usable_by_all(master: str, path: str) -> bool:
    """Executors are threads of this machine, or the path is on no machine's own disk."""
    own_disk = path.startswith("file:") or "://" not in path
    return re.fullmatch(r"local(\[.*\])?", master) is not None or not own_disk


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, else one below the warehouse.

    A warehouse on the driver's own disk will do in local mode only.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not usable_by_all(context.master, warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{warehouse}/scratch"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
