"""The Spark session that the library's arrays live in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def init(app: str = "quoin", master: str | None = None, **settings) -> SparkSession:
    """The active session or a new one; ANSI mode stays on, times are UTC."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def spark() -> SparkSession:
    return SparkSession.getActiveSession() or init()


def shared_folder(name: str) -> str:
    """A new path below the folder that driver and executors share: the checkpoint folder, or the warehouse."""
    import uuid

    s = spark()
    top = s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir")
    return f"{top}/quoin-arrays/{name}-{uuid.uuid4().hex}"
