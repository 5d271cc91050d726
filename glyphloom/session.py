"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "glyphloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; a cluster passes no ``master``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder: on a
    cluster a machine-local path would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="glyphloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(frame: DataFrame, **options: str) -> DataFrame:
    """Write a frame once to the shared folder, with the writer's ``options``, and read it back.

    For results that several passes read: it cuts the lineage, survives the
    loss of executors, and later passes read only the columns they need.
    """
    spark = frame.sparkSession
    path = f"{staging_folder(spark).rstrip('/')}/glyphloom/{uuid.uuid4().hex}"
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
