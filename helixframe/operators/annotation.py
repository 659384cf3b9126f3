"""Joins of candidates with landed annotations and ClinVar records, and the order in which candidates are sent on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.plans import projections as P

MAX_AF = 0.03  #: alleles above it are dropped
EXEMPT_AF = 0.05  #: pathogenic records keep an allele up to it
DOMINANT_AF = 0.01  #: heterozygotes above it need a partner in their gene
CAP = 200  #: candidates of a class that are sent on (the budget is the feature)
IMPACTS = ("HIGH", "MODERATE", "LOW", "MODIFIER")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, pos, gene, class, own_impact, batch): line items as candidates, looked up in batches of orders."""
    li = P.table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "de_novo").when(F.col("l_returnflag") == "A", "inherited_het").otherwise("unknown_het")
    return li.select(
        (1 + F.col("l_partkey") % 22).alias("chrom"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("gene"), kind.alias("class"),
        F.when(F.col("l_linenumber") % 3 == 0, "HIGH").alias("own_impact"), (F.col("l_orderkey") % 40).alias("batch"),
    )


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, pos, impact, af, pathogenic): what the annotation source holds, one row an allele."""
    li = P.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    at = ((1 + F.col("l_partkey") % 22).alias("chrom"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    tier = F.min(F.col("l_suppkey") % 4).cast("int")
    return li.groupBy(*at).agg(F.element_at(F.array(*map(F.lit, IMPACTS)), tier + 1).alias("impact"), F.max("l_discount").alias("af"), (F.max("l_tax") >= 0.07).alias("pathogenic"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch): batches that came back; every seventh was lost."""
    return P.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).alias("batch")).where("batch % 7 <> 3").distinct()


def annotate(cands: DataFrame, source: DataFrame, batches: DataFrame) -> DataFrame:
    """Candidates with `status` found, not held or not answered; none is lost, and the file's own impact stands in.

    A batch that wasn't answered leaves its candidates unlooked-up even where the source holds the allele.
    """
    got = cands.join(batches.select("batch", F.lit(True).alias("_back")), "batch", "left").join(source.withColumn("_held", F.lit(True)), ["chrom", "pos"], "left")
    back = F.col("_back").isNotNull()
    found = back & F.col("_held").isNotNull()
    status = F.when(found, "found").when(back, "not held").otherwise("not answered")
    return got.select(*cands.columns, status.alias("status"), F.coalesce(F.when(found, F.col("impact")), "own_impact").alias("impact"), F.when(found, F.col("af")).alias("af"), F.coalesce(found & F.col("pathogenic"), F.lit(False)).alias("pathogenic"))


def query_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotate(candidates(spark, sf_dir), held(spark, sf_dir), answered(spark, sf_dir))
    return a.groupBy("chrom", "status", "impact").agg(F.count("*").alias("n"), F.max("af").alias("max_af"), F.count_if("pathogenic").alias("n_pathogenic"))


def _tier() -> Column:
    """0 pathogenic or high, 1 moderate or not held, 2 low, 3 modifier or unknown, 4 not looked up."""
    return (
        F.when(F.col("status") == "not answered", 4).when(F.col("pathogenic") | (F.col("impact") == "HIGH"), 0)
        .when((F.col("impact") == "MODERATE") | (F.col("status") == "not held"), 1).when(F.col("impact") == "LOW", 2).otherwise(3)
    )


def budget(annotated: DataFrame) -> DataFrame:
    """Candidates that aren't common, with `tier`, `late` and their place `grp` (0 first) in the queue.

    A heterozygote is late if it is above the dominant threshold and its gene has no second heterozygote to pair with.
    """
    common = (F.col("af") > MAX_AF) & ~(F.col("pathogenic") & (F.col("af") <= EXEMPT_AF))
    rest = annotated.where(~F.coalesce(common, F.lit(False))).withColumn("tier", _tier())
    strong = F.col("class") == "de_novo"
    hets = rest.where(~strong).groupBy("gene").agg(F.count("*").alias("_hets"))
    late = F.coalesce(~strong & (F.col("af") > DOMINANT_AF) & (F.coalesce("_hets", F.lit(0)) < 2), F.lit(False))
    grp = F.when(F.col("tier") == 0, 0).when(F.col("tier") == 4, F.when(strong, 5).otherwise(6)).when(strong, 1).when(F.col("late"), 4).when(F.col("tier") == 1, 2).otherwise(3)
    return rest.join(hets, "gene", "left").withColumn("late", late).withColumn("grp", grp).drop("_hets")


def query_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first CAP candidates of each class; partial ranks before the shuffle bound what a class sends to its task."""
    b = budget(annotate(candidates(spark, sf_dir), held(spark, sf_dir), answered(spark, sf_dir)))
    n = F.row_number().over(W.partitionBy("class").orderBy("grp", "tier", "chrom", "pos", "gene")).cast("long")
    return b.withColumn("place", n).where(F.col("place") <= CAP).select("class", "place", "grp", "tier", "chrom", "pos", "gene")


def query_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the queue a class: how many candidates, how many of them late."""
    b = budget(annotate(candidates(spark, sf_dir), held(spark, sf_dir), answered(spark, sf_dir)))
    return b.groupBy("class", "grp").agg(F.count("*").alias("n"), F.count_if("late").alias("n_late"))


def query_clinvar_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each queried allele: records of exactly this allele and others at its locus; compound records are neither.

    Records are counted by locus and allele first, so a locus with very many joins as at most four rows.
    """
    q = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("locus"), (F.col("p_size") % 4).cast("long").alias("alt"))
    r = P.table(spark, sf_dir, "lineitem").where("l_tax > 0").groupBy(F.col("l_partkey").alias("locus"), (F.col("l_suppkey") % 4).alias("_alt")).agg(F.count("*").alias("_n"), F.max(F.col("l_linenumber") % 5).alias("_stars"))
    same = F.col("_alt") == F.col("alt")
    return q.join(r, "locus", "left").groupBy("locus", "alt").agg(F.coalesce(F.sum(F.when(same, F.col("_n"))), F.lit(0)).alias("n_exact"), F.coalesce(F.sum(F.when(~same, F.col("_n"))), F.lit(0)).alias("n_others"), F.max(F.when(same, F.col("_stars"))).alias("stars"))


def query_codon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each variant: records at its codon of the same change (PS1), of another (PM5), and not pathogenic.

    A record of the same nucleotide change is the variant's own and counts for nothing, stop gains (change 0) neither. Counts
    by nucleotide change are rolled up and subtracted, so nothing is paired within a codon.
    """
    li = P.table(spark, sf_dir, "lineitem")
    rec = li.select((F.col("l_partkey") % 500).alias("gene"), (F.col("l_suppkey") % 40).alias("residue"), (F.col("l_linenumber") % 5).alias("change"), (F.col("l_orderkey") % 3).alias("base"), (F.col("l_returnflag") == "R").alias("bad"))
    by = rec.where("change <> 0").groupBy("gene", "residue", "change", "base").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("o"))
    change = by.groupBy("gene", "residue", "change").agg(F.sum("p").alias("p_change"))
    codon = by.groupBy("gene", "residue").agg(F.sum("p").alias("p_codon"), F.sum("o").alias("o_codon"))
    j = by.join(change, ["gene", "residue", "change"]).join(codon, ["gene", "residue"])
    return j.select("gene", "residue", "change", "base", (F.col("p_change") - F.col("p")).alias("ps1"), (F.col("p_codon") - F.col("p_change")).alias("pm5"), (F.col("o_codon") - F.col("o")).alias("other"))


_JOINED = f"""cand AS (SELECT 1 + l_partkey % 22 AS chrom, l_orderkey * 8 + l_linenumber AS pos, l_partkey AS gene, CASE l_returnflag WHEN 'R' THEN 'de_novo' WHEN 'A' THEN 'inherited_het' ELSE 'unknown_het' END AS class,
  CASE WHEN l_linenumber % 3 = 0 THEN 'HIGH' END AS own_impact, l_orderkey % 40 AS batch FROM lineitem),
held AS (SELECT 1 + l_partkey % 22 AS chrom, l_orderkey * 8 + l_linenumber AS pos, {list(IMPACTS)}[min(l_suppkey % 4) + 1] AS impact, max(l_discount) AS af, max(l_tax) >= 0.07e0 AS bad FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
back AS (SELECT DISTINCT o_orderkey % 40 AS batch FROM orders WHERE o_orderkey % 40 % 7 <> 3),
seen AS (SELECT c.*, b.batch IS NOT NULL AS is_back, b.batch IS NOT NULL AND h.pos IS NOT NULL AS found, h.impact, h.af, h.bad FROM cand c LEFT JOIN back b ON b.batch = c.batch LEFT JOIN held h ON h.chrom = c.chrom AND h.pos = c.pos),
ann AS (SELECT chrom, pos, gene, class, CASE WHEN found THEN 'found' WHEN is_back THEN 'not held' ELSE 'not answered' END AS status, coalesce(CASE WHEN found THEN impact END, own_impact) AS impact, CASE WHEN found THEN af END AS af, found AND bad AS pathogenic FROM seen)"""
_QUEUE = f"""rest AS (SELECT *, CASE WHEN status = 'not answered' THEN 4 WHEN pathogenic OR coalesce(impact = 'HIGH', false) THEN 0 WHEN impact = 'MODERATE' OR status = 'not held' THEN 1 WHEN impact = 'LOW' THEN 2 ELSE 3 END AS tier
  FROM ann WHERE af IS NULL OR af <= {MAX_AF}e0 OR (pathogenic AND af <= {EXEMPT_AF}e0)),
h2 AS (SELECT *, coalesce(class <> 'de_novo' AND af > {DOMINANT_AF}e0 AND count(*) FILTER (class <> 'de_novo') OVER (PARTITION BY gene) < 2, false) AS late FROM rest),
queue AS (SELECT *, CASE WHEN tier = 0 THEN 0 WHEN tier = 4 THEN CASE WHEN class = 'de_novo' THEN 5 ELSE 6 END WHEN class = 'de_novo' THEN 1 WHEN late THEN 4 WHEN tier = 1 THEN 2 ELSE 3 END AS grp FROM h2)"""
SQL = {
    "jn02_annotation": f"WITH {_JOINED}\nSELECT chrom, status, impact, count(*) AS n, max(af) AS max_af, count(*) FILTER (pathogenic) AS n_pathogenic FROM ann GROUP BY ALL",
    "win06_budget": f"""WITH {_JOINED},\n{_QUEUE}
SELECT class, place, grp, tier, chrom, pos, gene FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY grp, tier, chrom, pos, gene) AS place FROM queue) WHERE place <= {CAP}""",
    "win07_late": f"WITH {_JOINED},\n{_QUEUE}\nSELECT class, grp, count(*) AS n, count(*) FILTER (late) AS n_late FROM queue GROUP BY ALL",
    "jn15_clinvar_locus": """SELECT p_partkey AS locus, CAST(p_size % 4 AS BIGINT) AS alt, count(l_suppkey) FILTER (l_suppkey % 4 = p_size % 4) AS n_exact, count(l_suppkey) FILTER (l_suppkey % 4 <> p_size % 4) AS n_others,
  max(CASE WHEN l_suppkey % 4 = p_size % 4 THEN l_linenumber % 5 END) AS stars FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_tax > 0 GROUP BY 1, 2""",
    "jn16_codon": """WITH r AS (SELECT l_partkey % 500 AS gene, l_suppkey % 40 AS residue, l_linenumber % 5 AS change, l_orderkey % 3 AS base, l_returnflag = 'R' AS bad FROM lineitem WHERE l_linenumber % 5 <> 0),
v AS (SELECT DISTINCT gene, residue, change, base FROM r)
SELECT v.gene, v.residue, v.change, v.base, count(*) FILTER (r.bad AND r.change = v.change AND r.base <> v.base) AS ps1, count(*) FILTER (r.bad AND r.change <> v.change) AS pm5,
  count(*) FILTER (NOT r.bad AND (r.change <> v.change OR r.base <> v.base)) AS other FROM v JOIN r ON r.gene = v.gene AND r.residue = v.residue GROUP BY ALL""",
}
QUERIES = {"jn02_annotation": query_annotation, "win06_budget": query_budget, "win07_late": query_late, "jn15_clinvar_locus": query_clinvar_locus, "jn16_codon": query_codon}
