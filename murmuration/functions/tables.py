"""Intermediate tables in the folder that driver and executors share.

Writing a table cuts lineage: a lost executor costs the tasks it ran, never the files of a finished step,
and the size of the written table is known to the planner when it chooses a join.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder named by the session. In local mode, as in tests, one is set where none is named; elsewhere that is an error."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SETTING, base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a frame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables there are so far."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables made after ``mark()`` gave ``since``, but for the last ``keep``: for when no frame reads them any more."""
    for path in _made[since : len(_made) - keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _made[since : len(_made) - keep]
