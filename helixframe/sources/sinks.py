"""Sinks: ranked tables as text, ledgers that only grow, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_cells(df: DataFrame) -> DataFrame:
    """All columns as strings: lists joined by `;`, doubles by %.4g, nulls empty."""
    cells = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        text = F.array_join(c.cast("array<string>"), ";") if kind.startswith("array") else F.format_string("%.4g", c) if kind in ("double", "float") else F.to_json(c) if kind.startswith(("struct", "map")) else c.cast("string")
        cells.append(F.coalesce(F.when(c.isNotNull(), text), F.lit("")).alias(name))
    return df.select(*cells)


def write_ranked(df: DataFrame, path: str) -> None:
    as_cells(df).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def append_ledger(rows: DataFrame, path: str, order: list[str]) -> None:
    """Appends `rows` with ids after the highest ever issued; one writer at a time."""
    spark = rows.sparkSession
    try:
        highest = spark.read.parquet(path).agg(F.max(F.substring("eid", 2, 18).cast("long"))).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        highest = 0
    n = F.row_number().over(W.orderBy(*order))
    rows.withColumn("eid", F.concat(F.lit("E"), (n + highest).cast("string"))).write.mode("append").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)
