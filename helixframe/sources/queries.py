"""Readers on lines made from the tables: what is written as text must be read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans import projections as P
from helixframe.sources import readers, sinks


def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as VCF records; some of them spoiled."""
    li = P.table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    pos = F.when(F.col("l_linenumber") == 7, "x").when(F.col("l_suppkey") == 0, "0").otherwise(s("l_orderkey"))
    ref = F.when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "A"), "<DEL>").otherwise("a")
    alts = F.when(F.col("l_returnflag") == "R", "C,T").otherwise("G")
    info = F.concat(F.lit("DP="), s("l_linenumber"), F.when(F.col("l_linestatus") == "F", ";DB").otherwise(""), F.lit(";AF="), s("l_discount"))
    gt = F.concat(F.lit("0"), F.when(F.col("l_linestatus") == "F", "|").otherwise("/"), F.when(F.col("l_returnflag") == "R", "2").when(F.col("l_returnflag") == "A", ".").otherwise("1"))
    call = F.concat_ws(":", gt, F.col("l_quantity").cast("int").cast("string"))
    chrom = F.when(F.col("l_partkey") % 25 == 23, "chrx").when(F.col("l_partkey") % 25 == 24, "chrM").otherwise(F.concat(F.lit("chr"), (F.col("l_partkey") % 25).cast("string")))
    return li.select(F.concat_ws("\t", chrom, pos, F.lit("."), ref, alts, F.lit("50"), F.lit("PASS"), info, F.lit("GT:DP"), call).alias("value"))


def query_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readers.parse_vcf(vcf_lines(spark, sf_dir))
    info = readers.info_map(F.col("info"))
    return r.groupBy("chrom", F.coalesce("why", F.lit("ok")).alias("why")).agg(F.count("*").alias("n"), F.count_if(F.array_contains(F.map_keys(info), "DB")).alias("flagged"), F.sum(info["DP"].cast("long")).alias("dp"), F.sum(F.size("alts")).alias("alleles"))


def query_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readers.parse_vcf(vcf_lines(spark, sf_dir)).where("why is null")
    c = readers.calls(r)
    carriers = F.size(F.filter("gt", lambda a: a == F.col("k")))
    return c.groupBy("k", "alt", "phased").agg(F.count("*").alias("n"), F.sum(carriers).alias("copies"), F.count_if(F.exists("gt", lambda a: a.isNull())).alias("missing"), F.sum("dp").alias("dp"))


def query_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations written as hpoa rows (a count a status, some of them without, some curated absent), pooled."""
    li = P.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    rows = li.groupBy(F.col("l_partkey").cast("string").alias("database_id"), F.col("l_suppkey").cast("string").alias("hpo_id"), "l_linestatus").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("ln"))
    f = F.when(F.col("ln") == 1, "").when(F.col("ln") == 2, "HP:0040282").when(F.col("ln") == 3, "40%").when(F.col("ln") == 4, "0/2").when(F.col("ln") == 5, "HP:0040285").otherwise(F.concat(F.col("n").cast("string"), F.lit("/"), (F.col("n") + F.col("ln")).cast("string")))
    rows = rows.select("database_id", "hpo_id", F.when((F.col("ln") == 7) & (F.col("l_linestatus") == "O"), "NOT").alias("qualifier"), f.alias("frequency"), F.lit("P").alias("aspect"))
    positive, absent = readers.pool_annotations(rows)
    out = positive.select("disease", "term", F.round("weight", 6).alias("weight"), F.when(F.col("unstated"), "unstated").otherwise("stated").alias("kind"))
    return out.union(absent.select("disease", "term", F.lit(None).cast("double"), F.lit("absent")))


def query_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.table(spark, sf_dir, "supplier")
    return sinks.as_cells(s.select(F.col("s_suppkey").alias("k"), F.array("s_nationkey", F.col("s_suppkey").cast("int")).alias("list"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name")))


def query_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as SSSOM rows; exact matches counted by subject."""
    c = P.table(spark, sf_dir, "customer")
    rows = c.select(
        F.concat(F.lit("MONDO:"), F.col("c_nationkey").cast("string")).alias("subject_id"), F.when(F.col("c_custkey") % 3 == 0, "skos:exactMatch").otherwise("skos:broadMatch").alias("predicate_id"),
        F.concat(F.lit("OMIM:"), (F.col("c_custkey") % 90).cast("string")).alias("object_id"),
    )
    return readers.mappings(rows).groupBy("subject").agg(F.count("*").alias("n"), F.min("object").alias("first"))


def query_survival_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of text in the coding 1/2, read back as 0/1."""
    li = P.table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_quantity").cast("string").alias("time"), F.when(F.col("l_returnflag") == "R", "2").otherwise("1").alias("event"), F.col("l_linestatus").alias("arm"))
    return readers.survival(rows, group="arm").groupBy("grp", "time").agg(F.count("*").alias("n"), F.sum("event").cast("long").alias("events"))


def query_blast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tabular hits, with comments and short lines; the best hit a query."""
    li = P.table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    fields = [s("l_orderkey"), s("l_partkey"), s("l_quantity"), *[s("l_linenumber")] * 7, F.lit("1e-5"), s("l_suppkey")]
    hit = F.concat_ws("\t", *fields)
    line = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("# "), hit)).when(F.col("l_linenumber") == 6, F.concat_ws("\t", *fields[:5])).otherwise(hit)
    hits = readers.read_blast(li.select(line.alias("value")))
    best = F.max(F.struct("bits", "identity", "subject")).alias("b")
    return hits.groupBy("query").agg(F.count("*").alias("n"), best).select("query", "n", F.col("b.bits").alias("bits"), F.col("b.identity").alias("identity"), F.col("b.subject").alias("subject"))


def query_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier terms with alternative and replaced ids brought to the ones in use."""
    s = P.table(spark, sf_dir, "supplier")
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    k = F.col("s_suppkey")
    used = {"alt": s.where("s_suppkey % 4 = 1").select(name(k).alias("alt"), name(k + 3).alias("term")), "replaced": s.where("s_suppkey % 6 = 1").select(name(k).alias("alt"), name(k + 5).alias("by"))}
    ids = P.table(spark, sf_dir, "lineitem").select(name(F.col("l_suppkey")).alias("term"))
    return readers.resolve(ids, "term", used).groupBy("term").agg(F.count("*").alias("n"))


_V = """v AS (SELECT CASE l_partkey % 25 WHEN 23 THEN 'X' WHEN 24 THEN 'MT' ELSE CAST(l_partkey % 25 AS VARCHAR) END AS chrom, l_linestatus = 'F' AS f, l_returnflag AS r, l_linenumber AS ln, CAST(l_quantity AS BIGINT) AS q,
  CASE WHEN l_linenumber = 7 THEN 'POS not an integer' WHEN l_suppkey = 0 OR l_orderkey < 1 THEN 'POS not 1-based' WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN 'REF not DNA' ELSE 'ok' END AS why FROM lineitem)"""
SQL = {
    "src03_vcf": f"WITH {_V} SELECT chrom, why, count(*) AS n, count(*) FILTER (f) AS flagged, CAST(sum(ln) AS BIGINT) AS dp, CAST(sum(CASE WHEN r = 'R' THEN 2 ELSE 1 END) AS BIGINT) AS alleles FROM v GROUP BY 1, 2",
    "src05_calls": f"""WITH {_V}, e AS (SELECT *, unnest(CASE WHEN r = 'R' THEN [1, 2] ELSE [1] END) AS k FROM v WHERE why = 'ok')
SELECT k, CASE WHEN r = 'R' THEN CASE k WHEN 1 THEN 'C' ELSE 'T' END ELSE 'G' END AS alt, f AS phased, count(*) AS n, CAST(sum(CASE WHEN (r = 'R' AND k = 2) OR (r = 'N' AND k = 1) THEN 1 ELSE 0 END) AS BIGINT) AS copies, count(*) FILTER (r = 'A') AS missing, CAST(sum(q) AS BIGINT) AS dp FROM e GROUP BY ALL""",
    "agg03_pooling": """WITH g AS (SELECT CAST(l_partkey AS VARCHAR) AS disease, CAST(l_suppkey AS VARCHAR) AS term, l_linestatus AS st, count(*) AS n, max(l_linenumber) AS ln FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3),
a AS (SELECT *, ln = 5 OR (ln = 7 AND st = 'O') AS absent FROM g),
p AS (SELECT disease, term, sum(CASE WHEN ln = 4 THEN 0 WHEN ln > 5 THEN n END) AS c, sum(CASE WHEN ln = 4 THEN 2 WHEN ln > 5 THEN n + ln END) AS m, max(CASE ln WHEN 2 THEN 0.55e0 WHEN 3 THEN 0.4e0 END) AS s, max(CASE WHEN ln = 1 THEN 1 ELSE 0 END) AS u FROM a WHERE NOT absent GROUP BY 1, 2),
k AS (SELECT *, greatest(coalesce(CAST(c AS DOUBLE) / CAST(m AS DOUBLE), 0), coalesce(s, 0)) AS known FROM p)
SELECT disease, term, round(CASE WHEN known > 0 THEN known ELSE 1 END, 6) AS weight, CASE WHEN known > 0 THEN 'stated' ELSE 'unstated' END AS kind FROM k WHERE known > 0 OR u = 1
UNION ALL SELECT DISTINCT disease, term, NULL, 'absent' FROM a WHERE absent""",
    "src18_mappings": "SELECT 'MONDO:' || c_nationkey AS subject, count(DISTINCT c_custkey % 90) AS n, min('OMIM:' || (c_custkey % 90)) AS first FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1",
    "src16_survival": "SELECT l_linestatus AS grp, l_quantity AS time, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS events FROM lineitem GROUP BY 1, 2",
    "src21_blast": """WITH h AS (SELECT CAST(l_orderkey AS VARCHAR) AS query, count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(l_suppkey AS DOUBLE) AS bits, l_quantity AS identity, CAST(l_partkey AS VARCHAR) AS subject FROM lineitem WHERE l_linenumber < 6)
SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query ORDER BY bits DESC, identity DESC, subject DESC) = 1""",
    "jn12_resolved": """WITH k AS (SELECT s_suppkey AS a, s_suppkey + 3 AS t FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT s_suppkey, s_suppkey + 5 FROM supplier WHERE s_suppkey % 6 = 1),
m AS (SELECT 'S' || a AS a, min('S' || t) AS t FROM k GROUP BY 1)
SELECT coalesce(t, 'S' || l_suppkey) AS term, count(*) AS n FROM lineitem LEFT JOIN m ON a = 'S' || l_suppkey GROUP BY 1""",
    "snk01_cells": "SELECT CAST(s_suppkey AS VARCHAR) AS k, s_nationkey || ';' || s_suppkey AS list, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS name FROM supplier",
}
QUERIES = {
    "src03_vcf": query_vcf, "src05_calls": query_calls, "agg03_pooling": query_pooling, "snk01_cells": query_cells,
    "src16_survival": query_survival_rows, "src18_mappings": query_mappings, "src21_blast": query_blast, "jn12_resolved": query_resolved,
}
