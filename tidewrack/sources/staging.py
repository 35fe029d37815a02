"""Tables that jobs write between rounds, in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode one under the warehouse where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written there and read back: its lineage is cut and it survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mapped_dir(spark: SparkSession, name: str) -> str | None:
    """A new folder's path in the shared folder, for files that workers map; none where that is in no file system of the machines."""
    found = shared_dir(spark)
    if "://" in found and not found.startswith("file://"):
        return None
    path = found.removeprefix("file://").removeprefix("file:")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}" if path.startswith("/") else None
