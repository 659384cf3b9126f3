"""Closed genomic intervals: binned overlap joins, relations, coding frame, offsets along a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.plans import projections as P

BIN = 4096
PAD = 50  #: positions a region is widened by in triage


def overlap_join(a: DataFrame, b: DataFrame, by: str, a_ends: tuple[str, str], b_ends: tuple[str, str], width: int = BIN) -> DataFrame:
    """All pairs of overlapping closed intervals of one `by`.

    Both sides are copied to the bins they touch, so the join is an equi-join that shuffles and
    splits under skew; a pair is kept in the first bin that it shares.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    x = a.withColumn("_bin", bins(*a_ends))
    y = b.withColumnRenamed(by, "_by").withColumn("_bin2", bins(*b_ends))
    touch = (F.col(a_ends[0]) <= F.col(b_ends[1])) & (F.col(b_ends[0]) <= F.col(a_ends[1]))
    first = F.col("_bin") == F.floor(F.greatest(a_ends[0], b_ends[0]) / width)
    return x.join(y, (F.col(by) == F.col("_by")) & (F.col("_bin") == F.col("_bin2"))).where(touch & first).drop("_bin", "_bin2", "_by")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, chrom, rs, re): one region a customer."""
    c = P.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("rid"), (F.col("c_custkey") % 22).alias("chrom"), (F.col("c_custkey") * 150).alias("rs"), (F.col("c_custkey") * 150 + 900 + F.col("c_nationkey") * 10).alias("re"))


def query_variant_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as single positions in padded regions; all hits are kept."""
    li = P.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 22).alias("chrom"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("pos")).distinct()
    padded = regions(spark, sf_dir).select("rid", "chrom", (F.col("rs") - PAD).alias("rs"), (F.col("re") + PAD).alias("re"))
    hits = overlap_join(li, padded, "chrom", ("pos", "pos"), ("rs", "re"))
    return hits.groupBy("rid").agg(F.count("*").alias("n_hits"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def relation(s1: str, e1: str, s2: str, e2: str) -> F.Column:
    a, b, c, d = map(F.col, (s1, e1, s2, e2))
    return F.when((a == c) & (b == d), "identical").when((a <= c) & (b >= d), "cnv_contains_it").when((a >= c) & (b <= d), "cnv_within_it").otherwise("partial")


def query_overlap_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals and regions that overlap: relation, shared positions and fractions of either."""
    pairs = overlap_join(P.intervals(spark, sf_dir), regions(spark, sf_dir), "chrom", ("start", "end"), ("rs", "re"))
    bp = F.greatest(F.lit(0), F.least("end", "re") - F.greatest("start", "rs") + 1)
    share = lambda s, e: F.round(F.col("bp") / (F.col(e) - F.col(s) + 1), 4)
    return pairs.withColumn("bp", bp).select("iid", "rid", relation("start", "end", "rs", "re").alias("relation"), "bp", share("start", "end").alias("of_interval"), share("rs", "re").alias("of_region"))


def query_exon_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transcripts, lines as exons: running coding offset, frame after deleting the exon, and flank that restores it."""
    li = P.table(spark, sf_dir, "lineitem")
    exons = li.groupBy(F.col("l_orderkey").alias("tx"), F.col("l_linenumber").alias("exon")).agg(F.sum(F.col("l_quantity").cast("long")).alias("bases"))
    order = W.partitionBy("tx").orderBy("exon")
    running = F.sum("bases").over(order.rowsBetween(W.unboundedPreceding, 0))
    flank = lambda c: (F.col("bases") + c) % 3 == 0
    e = exons.withColumns({"cds_end": running, "before": F.lag("bases").over(order), "after": F.lead("bases").over(order)})
    frame = F.when(F.col("bases") % 3 == 0, "in frame").otherwise("frameshift")
    restore = F.when(F.col("bases") % 3 == 0, "none needed").when(flank(F.col("after")), "after").when(flank(F.col("before")), "before").otherwise("none")
    return e.select("tx", "exon", (F.col("cds_end") - F.col("bases") + 1).alias("cds_start"), "cds_end", frame.alias("frame"), restore.alias("restoring_flank"), F.col("before").isNull().alias("has_start"), F.col("after").isNull().alias("has_stop"))


def query_repeat_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' sizes as repeat counts, put into bands (range join with a fixed table of bands)."""
    bands = spark.createDataFrame([("normal", 1, 10), ("intermediate", 11, 26), ("reduced", 27, 35), ("full", 36, 1000)], "band string, low int, high int")
    p = P.table(spark, sf_dir, "part")
    return p.join(F.broadcast(bands), F.col("p_size").between(F.col("low"), F.col("high"))).groupBy("p_brand", "band").agg(F.count("*").alias("n"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


_REGION = "region_ AS (SELECT c_custkey AS rid, c_custkey % 22 AS chrom, c_custkey * 150 AS rs, c_custkey * 150 + 900 + c_nationkey * 10 AS re FROM customer)"
SQL = {
    "jn03_variant_regions": f"""WITH {_REGION}, v AS (SELECT DISTINCT l_partkey % 22 AS chrom, l_orderkey * 16 + l_linenumber AS pos FROM lineitem)
SELECT rid, count(*) AS n_hits, min(pos) AS first_pos, max(pos) AS last_pos FROM v JOIN region_ r ON v.chrom = r.chrom AND pos BETWEEN rs - {PAD} AND re + {PAD} GROUP BY 1""",
    "jn04_overlap_relation": P.with_("interval") + f""",\n{_REGION},
p AS (SELECT iid, rid, s, e, rs, re, greatest(0, least(e, re) - greatest(s, rs) + 1) AS bp FROM interval_ i JOIN region_ r ON i.chrom = r.chrom AND s <= re AND rs <= e)
SELECT iid, rid, CASE WHEN s = rs AND e = re THEN 'identical' WHEN s <= rs AND e >= re THEN 'cnv_contains_it' WHEN s >= rs AND e <= re THEN 'cnv_within_it' ELSE 'partial' END AS relation, bp,
  round(CAST(bp AS DOUBLE) / (e - s + 1), 4) AS of_interval, round(CAST(bp AS DOUBLE) / (re - rs + 1), 4) AS of_region FROM p""",
    "prj25_exon_frame": """WITH x AS (SELECT l_orderkey AS tx, l_linenumber AS exon, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bases FROM lineitem GROUP BY 1, 2),
e AS (SELECT *, CAST(sum(bases) OVER o AS BIGINT) AS cds_end, lag(bases) OVER o AS b, lead(bases) OVER o AS a FROM x WINDOW o AS (PARTITION BY tx ORDER BY exon))
SELECT tx, exon, cds_end - bases + 1 AS cds_start, cds_end, CASE WHEN bases % 3 = 0 THEN 'in frame' ELSE 'frameshift' END AS frame,
  CASE WHEN bases % 3 = 0 THEN 'none needed' WHEN (bases + a) % 3 = 0 THEN 'after' WHEN (bases + b) % 3 = 0 THEN 'before' ELSE 'none' END AS restoring_flank, b IS NULL AS has_start, a IS NULL AS has_stop FROM e""",
    "prj23_repeat_bands": """WITH b(band, low, high) AS (VALUES ('normal', 1, 10), ('intermediate', 11, 26), ('reduced', 27, 35), ('full', 36, 1000))
SELECT p_brand, band, count(*) AS n, min(p_size) AS least, max(p_size) AS most FROM part JOIN b ON p_size BETWEEN low AND high GROUP BY 1, 2""",
}
QUERIES = {"jn03_variant_regions": query_variant_regions, "jn04_overlap_relation": query_overlap_relation, "prj25_exon_frame": query_exon_frame, "prj23_repeat_bands": query_repeat_bands}
