"""Projections of the star-schema tables into the domain model, in DataFrames and as SQL text.

They use whole tables and integer arithmetic only, so both dialects agree. They exercise the
operators; the domain itself is tested on small planted inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.sources.scratch import spread

#: query terms of a case; the last one is an excluded term
TERMS_PER_CASE = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def term(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def ontology_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): suppliers under nations (every fifth under two), nations under regions, regions under ROOT."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return (
        s.select(term("S", "s_suppkey").alias("child"), term("N", "s_nationkey").alias("parent"))
        .union(s.where("s_suppkey % 5 = 0").select(term("S", "s_suppkey"), term("N", (F.col("s_nationkey") + 7) % 25)))
        .union(n.select(term("N", "n_nationkey"), term("R", "n_regionkey")))
        .union(r.select(term("R", "r_regionkey"), F.lit("ROOT")))
        .distinct()
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(disease, term, num, den): how many of `den` observations show the term; rows of a disease lie together."""
    li = table(spark, sf_dir, "lineitem")
    seen = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("disease"), "l_suppkey", (F.col("l_linestatus") == "F").alias("shown"))
    by = spread(seen, li.count(), "disease").groupBy("disease", "l_suppkey").agg(F.count_if("shown").alias("num"), F.count("*").alias("den"))
    return by.select("disease", term("S", "l_suppkey").alias("term"), "num", "den")


def case_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, term, status): a case is a nation and market segment, its terms the suppliers it buys most from."""
    li, o, c = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer"))
    by_order = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("case_id"))
    bought = (  # orders first: line items, which are more, go to their orders only
        li.select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
        .join(by_order, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("case_id", "l_suppkey")
        .agg(F.sum("q").alias("q"))
    )
    n = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("q"), "l_suppkey"))
    return bought.withColumn("n", n).where(F.col("n") <= TERMS_PER_CASE).select(
        "case_id", term("S", "l_suppkey").alias("term"), F.when(F.col("n") == TERMS_PER_CASE, "excluded").otherwise("present").alias("status")
    )


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, pos, c, m, f, dp): one trio, with planted blocks of homozygosity, one uniparental chromosome and errors."""
    li = table(spark, sf_dir, "lineitem")
    ok, ln, q = F.col("l_orderkey"), F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")
    sites = li.groupBy((1 + F.col("l_partkey") % 22).cast("int").alias("chrom"), (ok * 20000 + ln * 10).alias("pos")).agg(
        F.min(ok).alias("ok"), F.min(ln).alias("ln"), F.min("l_suppkey").alias("sk"), F.min(q).alias("q")
    )
    block = F.expr("(ok div 1000) % 3 = 0")
    sites = sites.withColumn("m", F.when(block, 2).otherwise(F.col("sk") % 3)).withColumn("f", F.when(block, 2).otherwise(F.col("q") % 3))
    am = F.expr("CASE m WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE ln % 2 END")
    af = F.expr("CASE f WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE (ok + ln) % 2 END")
    c = F.when(F.col("chrom") == 15, 2 * am).when(F.col("ok") % 97 == 0, 2 - F.col("m")).otherwise(am + af)
    return sites.select("chrom", "pos", c.cast("int").alias("c"), F.col("m").cast("int").alias("m"), F.col("f").cast("int").alias("f"), F.col("q").cast("int").alias("dp"))


def pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fam, iid, father, mother): fathers have even and mothers odd numbers."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    father, mother = F.expr("(c_custkey div 4) * 2"), F.expr("(c_custkey div 6) * 2 + 1")
    both = (father > 0) & (father < k) & (mother < k)
    return c.select(F.col("c_nationkey").alias("fam"), k.alias("iid"), F.when(both, father).alias("father"), F.when(both, mother).alias("mother"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(iid, chrom, start, end): closed intervals."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("iid"), (F.col("o_custkey") % 22).alias("chrom"), (F.col("o_orderkey") * 16).alias("start"), (F.col("o_orderkey") * 16 + F.col("o_custkey") % 400).alias("end"))


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, time, event): days between order and shipment; event if returned."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    days = F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("grp"), days.cast("long").alias("time"), (F.col("l_returnflag") == "R").cast("int").alias("event"))


#: The same views in DuckDB SQL, to be put after WITH [RECURSIVE].
SQL = {
    "edge": """edge AS (
  SELECT 'S' || s_suppkey AS child, 'N' || s_nationkey AS parent FROM supplier
  UNION SELECT 'S' || s_suppkey, 'N' || ((s_nationkey + 7) % 25) FROM supplier WHERE s_suppkey % 5 = 0
  UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION SELECT 'R' || r_regionkey, 'ROOT' FROM region)""",
    "closure": """node AS (SELECT child AS t FROM edge UNION SELECT parent FROM edge),
closure AS (SELECT t AS term, t AS ancestor FROM node UNION SELECT c.term, e.parent FROM closure c JOIN edge e ON e.child = c.ancestor)""",
    "annotation": """annotation AS (
  SELECT l_partkey AS disease, 'S' || l_suppkey AS term, count(*) FILTER (l_linestatus = 'F') AS num, count(*) AS den
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)""",
    "case_term": f"""bought AS (
  SELECT c_nationkey || '/' || c_mktsegment AS case_id, l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY q DESC, l_suppkey) AS n FROM bought),
case_term AS (SELECT case_id, 'S' || l_suppkey AS term, CASE WHEN n = {TERMS_PER_CASE} THEN 'excluded' ELSE 'present' END AS status FROM numbered WHERE n <= {TERMS_PER_CASE})""",
    "genotype": """site AS (
  SELECT CAST(1 + l_partkey % 22 AS INTEGER) AS chrom, l_orderkey * 20000 + l_linenumber * 10 AS pos, min(l_orderkey) AS ok,
         min(CAST(l_linenumber AS BIGINT)) AS ln, min(l_suppkey) AS sk, min(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2),
parent AS (SELECT *, CASE WHEN (ok // 1000) % 3 = 0 THEN 2 ELSE sk % 3 END AS m, CASE WHEN (ok // 1000) % 3 = 0 THEN 2 ELSE q % 3 END AS f FROM site),
gamete AS (SELECT *, CASE m WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE ln % 2 END AS am, CASE f WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE (ok + ln) % 2 END AS af FROM parent),
genotype AS (SELECT chrom, pos, CAST(CASE WHEN chrom = 15 THEN 2 * am WHEN ok % 97 = 0 THEN 2 - m ELSE am + af END AS INTEGER) AS c,
                    CAST(m AS INTEGER) AS m, CAST(f AS INTEGER) AS f, CAST(q AS INTEGER) AS dp FROM gamete)""",
    "pedigree": """pair AS (SELECT c_nationkey AS fam, c_custkey AS iid, (c_custkey // 4) * 2 AS fa, (c_custkey // 6) * 2 + 1 AS mo FROM customer),
pedigree AS (SELECT fam, iid, CASE WHEN fa > 0 AND fa < iid AND mo < iid THEN fa END AS father, CASE WHEN fa > 0 AND fa < iid AND mo < iid THEN mo END AS mother FROM pair)""",
    "interval": """interval_ AS (SELECT o_orderkey AS iid, o_custkey % 22 AS chrom, o_orderkey * 16 AS s, o_orderkey * 16 + o_custkey % 400 AS e FROM orders)""",
    "survival": """survival AS (SELECT o_orderpriority AS grp, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS time,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS event FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}


def with_(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
