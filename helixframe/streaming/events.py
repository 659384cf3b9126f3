"""Extensions over the event stream: windowed counts as a Structured Streaming job, and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans import projections as P


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; works on a stream (with its watermark) and on a table."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    by = e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_once(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Reads what is new under `path` and appends closed windows to `out`; a restart goes on from the checkpoint."""
    schema = spark.read.parquet(path).schema
    stream = windowed(spark.readStream.schema(schema).parquet(path))
    stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def query_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed(P.table(spark, sf_dir, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 1).alias("total"))


def query_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with gaps of two hours or more between them."""
    e = P.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


SQL = {
    "ext_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(round(sum(value), 2), 1) AS total FROM events GROUP BY 1, 2",
    "ext_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1""",
}
QUERIES = {"ext_tumbling": query_tumbling, "ext_sessions": query_sessions}
