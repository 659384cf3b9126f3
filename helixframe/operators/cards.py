"""Smaller relational operators of the summary cards: sets gained and lost, medians, anti joins, samples, boards, ordered resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.plans import projections as P

SAMPLE = 50  #: evenly spaced sites that a reference check looks at


def query_new_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the parts bought in the later half of the orders and not before, and the other way round."""
    o, li = P.table(spark, sf_dir, "orders"), P.table(spark, sf_dir, "lineitem")
    bought = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey", (F.year("o_orderdate") >= 1998).alias("later"))
    sets = bought.groupBy("o_custkey").agg(F.collect_set(F.when(~F.col("later"), F.col("l_partkey"))).alias("before"), F.collect_set(F.when(F.col("later"), F.col("l_partkey"))).alias("now"))
    new, gone = F.array_except("now", "before"), F.array_except("before", "now")
    return sets.select("o_custkey", F.size(new).cast("long").alias("n_new"), F.size(gone).cast("long").alias("n_gone"), F.array_min(new).alias("first_new"), F.array_min(gone).alias("first_gone"))


def query_top_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part type the three brands of the highest median quantity, with a band."""
    j = P.table(spark, sf_dir, "lineitem").join(P.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = j.groupBy("p_type", "p_brand").agg(F.percentile("l_quantity", 0.5).alias("median"), F.count("*").alias("n"))
    order = W.partitionBy("p_type").orderBy(F.desc("median"), "p_brand")
    band = F.when(F.col("median") >= 27, "high").when(F.col("median") >= 25, "medium").otherwise("low")
    return m.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3").select("p_type", "p_brand", "median", "n", "rank", band.alias("band"))


def query_not_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of which no word is sold by name in the cheapest tenth: an anti join on words, not on names."""
    p = P.table(spark, sf_dir, "part")
    words = F.explode(F.split(F.lower("p_name"), " ")).alias("w")
    listed = p.where("p_size = 1").select(words).distinct()
    found = p.select("p_partkey", words).join(listed, "w", "left_semi").select("p_partkey").distinct()
    return p.join(found, "p_partkey", "left_anti").groupBy("p_name").agg(F.count("*").alias("n"))


def query_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most SAMPLE evenly spaced sites a chromosome, the sampling that a reference check asks for."""
    g = P.genotypes(spark, sf_dir).select("chrom", "pos")
    w = W.partitionBy("chrom")
    step = F.ceil(F.count("*").over(w) / SAMPLE)
    return g.select("chrom", "pos", (F.row_number().over(w.orderBy("pos")) - 1).alias("i"), step.alias("step")).where("i % step = 0").select("chrom", "pos")


def query_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status and priority as a board: one row a priority, one column a status."""
    o = P.table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0).toDF("o_orderpriority", "n_f", "n_o", "n_p")


def query_sibling_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each trio child, a sibling's calls at its het sites: shared, not shared, not called (by read depth)."""
    g = P.genotypes(spark, sf_dir).where("c = 1").select("chrom", "pos")
    sib = P.genotypes(spark, sf_dir).select(F.col("chrom"), "pos", F.when(F.col("dp") >= 10, F.col("f")).alias("call"))
    j = g.join(sib, ["chrom", "pos"], "left")
    verdict = F.when(F.col("call").isNull(), "not called").when(F.col("call") > 0, "shared").otherwise("not shared")
    return j.groupBy("chrom", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def query_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a name is, by ordered exact tests: nation, region, part name, else unresolved; near misses stay unresolved."""
    n, r, p = (P.table(spark, sf_dir, x) for x in ("nation", "region", "part"))
    asked = n.select(F.col("n_name").alias("q")).union(r.select("r_name")).union(p.select("p_name")).union(p.select(F.concat("p_name", F.lit("s")))).union(n.select(F.lower("n_name"))).distinct()
    known = n.select(F.col("n_name").alias("q"), F.lit(1).alias("o"), F.lit("nation").alias("kind")).union(r.select("r_name", F.lit(2), F.lit("region"))).union(p.select("p_name", F.lit(3), F.lit("part")).distinct())
    first = known.groupBy("q").agg(F.min(F.struct("o", "kind")).alias("k"))
    return asked.join(first, "q", "left").select("q", F.coalesce("k.kind", F.lit("unresolved")).alias("kind"))


SQL = {
    "set03_new_gone": """WITH b AS (SELECT DISTINCT o_custkey, l_partkey, year(o_orderdate) >= 1998 AS later FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
k AS (SELECT o_custkey, l_partkey, bool_or(later) AS l, bool_or(NOT later) AS e FROM b GROUP BY 1, 2)
SELECT o_custkey, count(*) FILTER (l AND NOT e) AS n_new, count(*) FILTER (e AND NOT l) AS n_gone, min(CASE WHEN l AND NOT e THEN l_partkey END) AS first_new, min(CASE WHEN e AND NOT l THEN l_partkey END) AS first_gone FROM k GROUP BY 1""",
    "top05_top_medians": """WITH m AS (SELECT p_type, p_brand, median(l_quantity) AS median, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY median DESC, p_brand) AS rank FROM m) SELECT *, CASE WHEN median >= 27 THEN 'high' WHEN median >= 25 THEN 'medium' ELSE 'low' END AS band FROM r WHERE rank <= 3""",
    "jn19_not_listed": """WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part WHERE p_size = 1)
SELECT p_name, count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM w WHERE list_contains(string_split(lower(p_name), ' '), w.w)) GROUP BY 1""",
    "win10_even_sample": P.with_("genotype") + f""",
n AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i, CAST(ceil(count(*) OVER (PARTITION BY chrom) / {SAMPLE}e0) AS BIGINT) AS step FROM genotype) SELECT chrom, pos FROM n WHERE i % step = 0""",
    "agg33_board": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "jn08_sibling_calls": P.with_("genotype") + """
SELECT chrom, CASE WHEN dp < 10 THEN 'not called' WHEN f > 0 THEN 'shared' ELSE 'not shared' END AS verdict, count(*) AS n FROM genotype WHERE c = 1 GROUP BY 1, 2""",
    "res02_classification": """WITH a AS (SELECT n_name AS q FROM nation UNION SELECT r_name FROM region UNION SELECT p_name FROM part UNION SELECT p_name || 's' FROM part UNION SELECT lower(n_name) FROM nation)
SELECT q, CASE WHEN q IN (SELECT n_name FROM nation) THEN 'nation' WHEN q IN (SELECT r_name FROM region) THEN 'region' WHEN q IN (SELECT p_name FROM part) THEN 'part' ELSE 'unresolved' END AS kind FROM a""",
}
QUERIES = {
    "set03_new_gone": query_new_gone, "top05_top_medians": query_top_medians, "jn19_not_listed": query_not_listed, "win10_even_sample": query_even_sample,
    "agg33_board": query_board, "jn08_sibling_calls": query_sibling_calls, "res02_classification": query_classification,
}
