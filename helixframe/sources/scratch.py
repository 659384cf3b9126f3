"""Tables written once into the shared folder of the session, so that iterations carry no lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where a local session leaves it unset, a fresh temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


BROADCAST_ROWS = 500_000  #: a table of more rows is shuffled


def narrow(t: DataFrame) -> DataFrame:
    return F.broadcast(t) if t.count() <= BROADCAST_ROWS else t


PART = 500_000  #: rows that a task takes of a table dealt by `spread`


def spread(df: DataFrame, rows: int, *keys: str, part: int = PART) -> DataFrame:
    """`df`, dealt by keys to tasks of about `part` of the `rows` that come of it.

    The number grows with the input, so a task's share doesn't, and as it is stated, adaptive execution puts no tasks together
    whose few rows will become many.
    """
    return df.repartition(1 + int(rows) // part, *keys)


def keep(df: DataFrame, name: str) -> DataFrame:
    """`df`, written and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
