"""Variant triage: frequency summaries, predictors, compound heterozygotes, two thresholds, score and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.plans import projections as P
from helixframe.sources.scratch import keep, narrow

RECESSIVE_AF, DOMINANT_AF = 0.06, 0.02
PRIORS = {"de_novo": 1.0, "comphet": 0.9, "hom_alt": 0.8, "comphet_unphased": 0.6, "inherited_het": 0.3}
ORDER = tuple(PRIORS)
TRUSTED = 500_000  #: bases that a phase set made of reads can span (fixed value)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a (gene, pos): gene is a supplier, alleles are line items; the first of equal alleles by class priority stays.

    The parent of origin is known for the first three lines of an order; others have a phase set and haplotype, or neither.
    """
    li = P.table(spark, sf_dir, "lineitem")
    v = li.select(
        F.col("l_suppkey").alias("gene"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "de_novo").when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 2), "hom_alt").otherwise("inherited_het").alias("cls"),
        F.when(F.col("l_linenumber") < 4, F.when(F.col("l_linestatus") == "F", "mat").otherwise("pat")).alias("origin"),
        F.when(F.col("l_linenumber") != 6, F.expr("l_orderkey div 40")).alias("phase_set"), (F.col("l_partkey") % 2).alias("hap"), F.col("l_discount").alias("af"), F.col("l_tax").alias("faf"),
        F.col("l_quantity").cast("int").alias("q"), (F.col("l_partkey") % 100).alias("rank_score"), F.col("l_extendedprice").alias("price"),
    )
    first = W.partitionBy("gene", "pos").orderBy(_class_order(F.col("cls")), F.col("origin").asc_nulls_first(), "af", "faf", "q", "rank_score", "price", "hap")
    return v.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "price")


def _class_order(cls: Column) -> Column:
    return F.coalesce(*(F.when(cls == c, F.lit(i)) for i, c in enumerate(ORDER)), F.lit(len(ORDER)))


def predictor_support(revel: Column, splice: Column, cadd: Column, am_pathogenic: Column) -> Column:
    """Banded support of four predictors; two kinds or more add 0.05, up to 0.9."""
    a = F.when(revel >= 0.932, 0.85).when(revel >= 0.773, 0.75).when(revel >= 0.644, 0.65).otherwise(0.0)
    b = F.when(splice >= 0.5, 0.85).when(splice >= 0.2, 0.65).otherwise(0.0)
    c = F.when(cadd >= 28.1, 0.65).when(cadd >= 25.3, 0.6).otherwise(0.0)
    d = F.when(am_pathogenic, 0.7).otherwise(0.0)
    kinds = sum((x > 0).cast("int") for x in (a, b, c, d))
    best = F.greatest(a, b, c, d)
    return F.when(kinds >= 2, F.least(F.lit(0.9), best + 0.05)).otherwise(best)


def query_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = P.table(spark, sf_dir, "lineitem")
    s = predictor_support(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity"), F.expr("l_partkey % 5 = 0"))
    return li.groupBy(F.round(s, 4).alias("support")).agg(F.count("*").alias("n"))


def af_summary(groups: Column) -> Column:
    """Highest frequency of the groups that have calls; null where none has."""
    known = F.map_filter(groups, lambda k, v: v.isNotNull())
    return F.array_max(F.map_values(known))


def query_af_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part the frequency in five groups (ship months), small groups left out, and the group that has the highest."""
    li = P.table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_partkey", (F.month("l_shipdate") % 5).alias("grp")).agg(F.count_if(F.col("l_returnflag") == "A").alias("ac"), F.count("*").alias("an"))
    g = g.where("an > 2").withColumn("af", F.col("ac").cast("double") / F.col("an"))
    best = g.groupBy("l_partkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("grp").cast("string"), "af")))).alias("m"), F.max(F.struct("af", F.col("grp").cast("string").alias("grp"))).alias("b"))
    return best.select("l_partkey", F.round(af_summary(F.col("m")), 6).alias("filter_af"), F.col("b.grp").alias("grpmax"), F.size("m").cast("long").alias("n_groups"))


def partnered(v: DataFrame) -> DataFrame:
    """`v` with n_trans, first_trans, last_trans and n_unknown of its rare hets, null for other rows.

    Two hets are in trans if they come from different parents, or, where a parent isn't known, if they lie on different
    haplotypes (0 and 1) of one phase set; they are in cis if the same; otherwise their phase is unknown. A phase set that spans more than
    TRUSTED bases in a gene settles nothing. No pair is formed: what a het can meet is counted once for each gene, by parent,
    and once for each phase set, by haplotype, and looked up in these two tables, so a gene of any size costs one row a het.
    """
    rare = F.coalesce((F.col("cls") == "inherited_het") & (F.col("af") <= RECESSIVE_AF), F.lit(False))
    het = v.where(rare).select("gene", "pos", "origin", "phase_set", "hap")
    three = lambda name, on: (F.count_if(on).alias(f"{name}_n"), F.min(F.when(on, F.col("pos"))).alias(f"{name}_min"), F.max(F.when(on, F.col("pos"))).alias(f"{name}_max"))
    none = F.col("origin").isNull()
    genes = het.where("gene IS NOT NULL").groupBy("gene").agg(F.count("*").alias("all_n"), F.count_if(none).alias("none_n"), *three("mat", F.col("origin") == "mat"), *three("pat", F.col("origin") == "pat"))
    by_hap = [c for h in (0, 1) for c in (*three(f"any{h}", F.col("hap") == h), *three(f"alone{h}", none & (F.col("hap") == h)))]
    sets = het.where("phase_set IS NOT NULL").groupBy("gene", "phase_set").agg((F.max("pos") - F.min("pos")).alias("span"), F.count("*").alias("set_n"), F.count_if(none).alias("set_none_n"), *by_hap)
    j = v.join(sets.where(F.col("span") <= TRUSTED), ["gene", "phase_set"], "left").join(narrow(genes), "gene", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    parent = lambda end: F.when(F.col("origin") == "mat", F.col(f"pat_{end}")).when(F.col("origin") == "pat", F.col(f"mat_{end}"))
    across = lambda kind, end: F.when(F.col("hap") == 0, F.col(f"{kind}1_{end}")).when(F.col("hap") == 1, F.col(f"{kind}0_{end}"))
    known, on = F.col("origin").isNotNull(), rare & F.col("all_n").isNotNull()
    return j.select(
        *v.columns, F.when(on, F.when(known, zero(parent("n")) + zero(across("alone", "n"))).otherwise(zero(across("any", "n")))).alias("n_trans"),
        F.when(on, F.when(known, F.least(parent("min"), across("alone", "min"))).otherwise(across("any", "min"))).alias("first_trans"),
        F.when(on, F.when(known, F.greatest(parent("max"), across("alone", "max"))).otherwise(across("any", "max"))).alias("last_trans"),
        F.when(on, F.when(known, F.col("none_n") - zero(F.col("set_none_n"))).otherwise(F.col("all_n") - F.coalesce("set_n", F.lit(1)))).alias("n_unknown"),
    )


def partners(v: DataFrame) -> DataFrame:
    """(gene, pos, n_trans, first_trans, last_trans, n_unknown) of the rare hets of each gene."""
    return partnered(v).where("n_trans IS NOT NULL").select("gene", "pos", "n_trans", "first_trans", "last_trans", "n_unknown")


def query_compound_het(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partners(keep(variants(spark, sf_dir).where(F.col("af") <= RECESSIVE_AF), "rare")).where("n_trans > 0 OR n_unknown > 0")


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = partnered(keep(variants(spark, sf_dir).where(F.col("af") <= RECESSIVE_AF), "rare"))  # read by each count
    v = v.withColumn("paired", F.when(F.col("n_trans") > 0, "comphet").when(F.col("n_unknown") > 0, "comphet_unphased")).drop("n_trans", "first_trans", "last_trans", "n_unknown")
    v = v.withColumn("cls", F.coalesce("paired", "cls")).where(F.col("paired").isNotNull() | (F.col("cls") == "hom_alt") | (F.col("faf") <= DOMINANT_AF))
    severity = F.when(F.col("q") % 4 == 0, 1.0).when(F.col("q") % 4 == 1, 0.6).when(F.col("q") % 4 == 2, 0.25)
    prior = F.coalesce(*(F.when(F.col("cls") == c, F.lit(p)) for c, p in PRIORS.items()))
    fit = F.when(F.col("gene") % 3 == 0, 1.0).when(F.col("gene") % 3 == 1, 0.8).otherwise(0.5)
    score = 0.40 * F.col("rank_score") / 100 + 0.35 * severity + 0.25 * prior * fit
    return v.withColumn("score", F.round(score, 6))


def query_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty candidates of each class: by score (unscored last), position and gene."""
    order = W.partitionBy("cls").orderBy(F.col("score").desc_nulls_last(), "pos", "gene")
    return triaged(spark, sf_dir).withColumn("n", F.row_number().over(order).cast("long")).where("n <= 30").select("cls", "n", "gene", "pos", "score")


def query_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each stage of the filters in one pass."""
    v = variants(spark, sf_dir)
    rare, dominant = F.col("af") <= RECESSIVE_AF, F.col("faf") <= DOMINANT_AF
    return v.groupBy("cls").agg(F.count("*").alias("read"), F.count_if(F.col("q") >= 10).alias("depth_ok"), F.count_if((F.col("q") >= 10) & rare).alias("rare"), F.count_if((F.col("q") >= 10) & rare & dominant).alias("dominant"))


_V = f"""v0 AS (SELECT l_suppkey AS gene, l_orderkey * 10 + l_linenumber AS pos,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'de_novo' WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN 'hom_alt' ELSE 'inherited_het' END AS cls,
  CASE WHEN l_linenumber < 4 THEN CASE WHEN l_linestatus = 'F' THEN 'mat' ELSE 'pat' END END AS origin, CASE WHEN l_linenumber <> 6 THEN l_orderkey // 40 END AS ps, l_partkey % 2 AS hap, l_discount AS af, l_tax AS faf, CAST(l_quantity AS INTEGER) AS q, l_partkey % 100 AS rank_score, l_extendedprice AS price FROM lineitem),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene, pos ORDER BY CASE cls {' '.join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(ORDER))} END, origin NULLS FIRST, af, faf, q, rank_score, price, hap) AS rn FROM v0) WHERE rn = 1),
het AS (SELECT *, max(pos) OVER (PARTITION BY gene, ps) - min(pos) OVER (PARTITION BY gene, ps) <= {TRUSTED} AS ok FROM v WHERE cls = 'inherited_het' AND af <= {RECESSIVE_AF}),
rel AS (SELECT a.gene, a.pos, b.pos AS partner, CASE WHEN a.origin <> b.origin THEN 'trans' WHEN a.origin = b.origin THEN 'cis' WHEN a.ps = b.ps AND a.ok THEN CASE WHEN a.hap = b.hap THEN 'cis' ELSE 'trans' END ELSE 'unknown' END AS rel
  FROM het a JOIN het b ON a.gene = b.gene AND a.pos <> b.pos),
pr AS (SELECT gene, pos, count(*) FILTER (rel = 'trans') AS n_trans, min(partner) FILTER (rel = 'trans') AS first_trans, max(partner) FILTER (rel = 'trans') AS last_trans, count(*) FILTER (rel = 'unknown') AS n_unknown FROM rel GROUP BY 1, 2)"""
SQL = {
    "prj16_predictors": """WITH s AS (SELECT CASE WHEN l_discount * 10 >= 0.932 THEN 0.85 WHEN l_discount * 10 >= 0.773 THEN 0.75 WHEN l_discount * 10 >= 0.644 THEN 0.65 ELSE 0 END AS a,
  CASE WHEN l_tax * 10 >= 0.5 THEN 0.85 WHEN l_tax * 10 >= 0.2 THEN 0.65 ELSE 0 END AS b, CASE WHEN l_quantity >= 28.1 THEN 0.65 WHEN l_quantity >= 25.3 THEN 0.6 ELSE 0 END AS c, CASE WHEN l_partkey % 5 = 0 THEN 0.7 ELSE 0 END AS d FROM lineitem),
t AS (SELECT CASE WHEN CAST(a > 0 AS INT) + CAST(b > 0 AS INT) + CAST(c > 0 AS INT) + CAST(d > 0 AS INT) >= 2 THEN least(0.9, greatest(a, b, c, d) + 0.05) ELSE greatest(a, b, c, d) END AS s FROM s)
SELECT round(CAST(s AS DOUBLE), 4) AS support, count(*) AS n FROM t GROUP BY 1""",
    "prj14_af_summary": """WITH g AS (SELECT l_partkey, CAST(month(l_shipdate) % 5 AS VARCHAR) AS grp, count(*) FILTER (l_returnflag = 'A') AS ac, count(*) AS an FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, CAST(ac AS DOUBLE) / an AS af, row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(ac AS DOUBLE) / an DESC, grp DESC) AS rn FROM g WHERE an > 2)
SELECT l_partkey, round(max(af), 6) AS filter_af, max(CASE WHEN rn = 1 THEN grp END) AS grpmax, count(*) AS n_groups FROM f GROUP BY 1""",
    "jn07_compound_het": f"""WITH {_V} SELECT * FROM pr WHERE n_trans > 0 OR n_unknown > 0""",
    "cmd01_triage": f"""WITH {_V}, pd AS (SELECT gene, pos, CASE WHEN n_trans > 0 THEN 'comphet' WHEN n_unknown > 0 THEN 'comphet_unphased' END AS paired FROM pr),
t AS (SELECT v.gene, v.pos, v.q, v.rank_score, v.faf, coalesce(paired, cls) AS cls, paired IS NOT NULL AS paired FROM v LEFT JOIN pd ON pd.gene = v.gene AND pd.pos = v.pos WHERE af <= {RECESSIVE_AF}),
s AS (SELECT cls, gene, pos, round(0.40e0 * rank_score / 100 + 0.35e0 * CASE q % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0.25e0 END
  + 0.25e0 * CASE cls {' '.join(f"WHEN '{c}' THEN {p}e0" for c, p in PRIORS.items())} END * CASE gene % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.8e0 ELSE 0.5e0 END, 6) AS score FROM t WHERE paired OR cls = 'hom_alt' OR faf <= {DOMINANT_AF})
SELECT * FROM (SELECT cls, row_number() OVER (PARTITION BY cls ORDER BY score DESC NULLS LAST, pos, gene) AS n, gene, pos, score FROM s) WHERE n <= 30""",
    "prj10_funnel": f"""WITH {_V} SELECT cls, count(*) AS read, count(*) FILTER (q >= 10) AS depth_ok, count(*) FILTER (q >= 10 AND af <= {RECESSIVE_AF}) AS rare, count(*) FILTER (q >= 10 AND af <= {RECESSIVE_AF} AND faf <= {DOMINANT_AF}) AS dominant FROM v GROUP BY 1""",
}
QUERIES = {"prj16_predictors": query_predictors, "prj14_af_summary": query_af_summary, "jn07_compound_het": query_compound_het, "cmd01_triage": query_triage, "prj10_funnel": query_funnel}
