"""Session settings the engine relies on, and the folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_dirs: dict[str, str] = {}

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Adds the recommended settings to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local session without one gets its own."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors can reach")
    # Kept here because the setting cannot be changed on a running session.
    application = spark.sparkContext.applicationId
    if application not in _own_dirs:
        _own_dirs[application] = tempfile.mkdtemp(prefix="gaugework-")
    return _own_dirs[application]


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Writes a small result as a table in the shared folder and reads it back.

    The plan behind it then runs once, and survives lost executors, however many results follow.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gaugework/{uuid.uuid4().hex}/{name}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def sql_over(query: str, **frames: DataFrame) -> DataFrame:
    """Runs SQL in which ``$name`` stands for a given frame.

    Names are replaced as plain text, so that regular expressions may hold braces. The plan is
    resolved at once; the views exist only until then.
    """
    spark = next(iter(frames.values())).sparkSession
    views = {name: f"gaugework_{name}_{uuid.uuid4().hex}" for name in frames}
    try:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(views[name])
            query = query.replace(f"${name}", views[name])
        return spark.sql(query)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
