"""Ontology closure, information content and phenotype-driven ranking of diseases and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.operators import ranking
from helixframe.plans import projections as P
from helixframe.sources.scratch import keep, narrow

TOP = 10
FLOOR = 0.01  #: least frequency
GENE_POOL = 200  #: best diseases of a case that may speak for a gene


def closure(edges: DataFrame) -> DataFrame:
    """(term, ancestor), each term being its own ancestor: semi-naive, one written table a round."""
    nodes = edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct()
    known = keep(nodes.select("term", F.col("term").alias("ancestor")), "closure")
    new = known
    while True:
        step = new.join(edges, F.col("ancestor") == F.col("child")).select("term", F.col("parent").alias("ancestor")).distinct()
        new = keep(step.join(known, ["term", "ancestor"], "left_anti"), "closure")
        if not new.limit(1).count():
            return known
        known = known.union(new)


def disease_closure(annotation: DataFrame, closed: DataFrame) -> DataFrame:
    """(disease, ancestor, freq): positive annotations carried up; the highest known frequency of what lies below.

    The ancestors of a term come as one row. While that table is narrow, annotations that lie by disease stay where they are.
    """
    positive = annotation.where("num > 0").select("disease", "term", (F.col("num") / F.col("den")).alias("freq"))
    over = narrow(closed.groupBy("term").agg(F.collect_list("ancestor").alias("over")))
    return positive.join(over, "term").select("disease", F.explode("over").alias("ancestor"), "freq").groupBy("disease", "ancestor").agg(F.max("freq").alias("freq"))


def information_content(carried: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """(ancestor, ic): -ln of the share of diseases that have the term; `total` is one row with their number `n_all`."""
    if total is None:
        total = carried.agg(F.countDistinct("disease").alias("n_all"))
    by = carried.groupBy("ancestor").agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(total)).select("ancestor", (-F.log(F.col("n").cast("double") / F.col("n_all").cast("double"))).alias("ic"))


def _parts(spark: SparkSession, sf_dir: str):
    """Closure, diseases (one row each, `ranking.by_disease`), information, terms of cases."""
    closed = closure(P.ontology_edges(spark, sf_dir))
    diseases = keep(ranking.by_disease(disease_closure(P.annotations(spark, sf_dir), closed)), "diseases")  # read by the counts and by the matches
    return closed, diseases, information_content(_carried(diseases), diseases.agg(F.count("*").alias("n_all"))), P.case_terms(spark, sf_dir)


def _carried(diseases: DataFrame) -> DataFrame:
    return diseases.selectExpr("disease", "inline(arrays_zip(ancestors, freqs)) AS (ancestor, freq)")


def query_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closure(P.ontology_edges(spark, sf_dir))


def query_information_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ic, _ = _parts(spark, sf_dir)
    return ic.select("ancestor", F.round("ic", 6).alias("ic"))


def query_frequency_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, diseases, _, _ = _parts(spark, sf_dir)
    return _carried(diseases).select("disease", "ancestor", F.round("freq", 6).alias("freq"))


def query_resnik_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed, diseases, ic, cases = _parts(spark, sf_dir)
    return ranking.rank(cases, closed, diseases, ic, TOP).drop("excluded_hits")


def query_likelihood_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over query terms of information content plus log frequency, not under 0; excluded terms the disease shows cost."""
    closed, diseases, ic, cases = _parts(spark, sf_dir)
    return ranking.rank(cases, closed, diseases, ic, TOP, ranking.likelihood(FLOOR))


def _absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.annotations(spark, sf_dir).where("num = 0").select("disease", "term")


def query_resnik_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of information with penalties of excluded terms and of curated absences that present terms contradict."""
    closed, diseases, ic, cases = _parts(spark, sf_dir)
    return ranking.rank(cases, closed, diseases, ic, TOP, ranking.resnik_with_penalties, _absent(spark, sf_dir))


def query_likelihood_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood with its cap of excluded terms and the value of contradicted ones."""
    closed, diseases, ic, cases = _parts(spark, sf_dir)
    return ranking.rank(cases, closed, diseases, ic, TOP, ranking.likelihood_with_penalties, _absent(spark, sf_dir))


def query_gene_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes (brands) by the best of their diseases among the first GENE_POOL of a case, with the sum as support."""
    closed, diseases, ic, cases = _parts(spark, sf_dir)
    best = ranking.rank(cases, closed, diseases, ic, GENE_POOL)
    genes = P.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("disease"), F.col("p_brand").alias("gene"))
    by = best.join(genes, "disease").groupBy("case_id", "gene").agg(
        F.max("score").alias("score"), (F.sum(F.round(F.col("score") * 1e6).cast("long")) / F.lit(1e6)).alias("support"), F.min("rank").alias("best_rank"), F.count("*").alias("diseases")
    )
    n = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("score"), F.asc("best_rank"), "gene")).cast("long")
    return by.withColumn("rank", n).where(F.col("rank") <= TOP)


def query_not_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, disease, term): the disease is annotated without the term, and nothing at or below it is positive."""
    closed, diseases, _, cases = _parts(spark, sf_dir)
    negative = P.annotations(spark, sf_dir).where("num = 0").select("disease", "term")
    present = cases.where("status = 'present'").select("case_id", "term")
    excluded_up = negative.withColumnRenamed("term", "ancestor").join(closed, "ancestor").select("disease", "term")
    hit = present.join(excluded_up, "term")
    return hit.join(_carried(diseases).select("disease", F.col("ancestor").alias("term")), ["disease", "term"], "left_anti").select("case_id", "disease", "term").distinct()


def query_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations per disease that lie under the first region."""
    closed = closure(P.ontology_edges(spark, sf_dir)).where("ancestor = 'R0'").select("term")
    inside = P.annotations(spark, sf_dir).join(F.broadcast(closed), "term", "left_semi")
    return inside.groupBy("disease").agg(F.count("*").alias("n_terms"), F.sum("den").alias("observations"))


_CARRIED = """carried AS (SELECT a.disease, c.ancestor, max(CAST(num AS DOUBLE) / den) AS freq FROM annotation a JOIN closure c ON c.term = a.term WHERE num > 0 GROUP BY 1, 2),
ic AS (SELECT ancestor, -ln(CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT disease) FROM carried)) AS ic FROM carried GROUP BY 1)"""
_MATCH = """hit AS (SELECT q.case_id, q.term, k.disease, i.ic, CASE WHEN c.ancestor = q.term THEN 1 ELSE 0 END AS exact, k.freq
  FROM case_term q JOIN closure c ON c.term = q.term JOIN ic i ON i.ancestor = c.ancestor AND i.ic > 0 JOIN carried k ON k.ancestor = c.ancestor WHERE q.status = 'present'),
m AS (SELECT case_id, term, disease, ic, exact, freq FROM (SELECT *, row_number() OVER (PARTITION BY case_id, term, disease ORDER BY ic DESC, exact DESC, freq DESC) AS rn FROM hit) WHERE rn = 1)"""
_RESNIK = """nq AS (SELECT case_id, count(*) AS nq FROM case_term WHERE status = 'present' GROUP BY 1),
scored AS (SELECT case_id, disease, round(sum(ic) / any_value(nq), 6) AS score, CAST(sum(exact) AS BIGINT) AS exact, round(avg(ic), 6) AS specificity FROM m JOIN nq USING (case_id) GROUP BY 1, 2)"""
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, exact DESC, specificity DESC, disease DESC) AS rank, count(*) OVER (PARTITION BY case_id, score) AS tied FROM scored)"""
_CONTRA = """contra AS (SELECT q.case_id, n.disease, n.term AS pterm, min(q.term) AS qterm FROM case_term q JOIN closure c ON c.term = q.term JOIN annotation n ON n.term = c.ancestor AND n.num = 0
  WHERE q.status = 'present' AND NOT EXISTS (SELECT 1 FROM carried k WHERE k.disease = n.disease AND k.ancestor = q.term) GROUP BY 1, 2, 3)"""
_ALL = P.with_("edge", "closure", "annotation", "case_term", recursive=True) + ",\n" + _CARRIED

SQL = {
    "set02_closure": P.with_("edge", "closure", recursive=True) + "\nSELECT term, ancestor FROM closure",
    "agg04_information_content": _ALL + "\nSELECT ancestor, round(ic, 6) AS ic FROM ic",
    "gra04_frequency_propagation": _ALL + "\nSELECT disease, ancestor, round(freq, 6) AS freq FROM carried",
    "agg05_resnik_rank": f"{_ALL},\n{_MATCH},\n{_RESNIK},\n{_RANKED}\nSELECT case_id, disease, score, exact, specificity, rank, tied FROM ranked WHERE rank <= {TOP}",
    "agg06_likelihood_rank": f"""{_ALL},\n{_MATCH},
cost AS (SELECT q.case_id, k.disease, sum(ln(greatest(1 - k.freq, {FLOOR}))) AS cost, count(*) AS excluded_hits FROM case_term q JOIN carried k ON k.ancestor = q.term WHERE q.status = 'excluded' GROUP BY 1, 2),
sums AS (SELECT case_id, disease, sum(greatest(0, ic + ln(greatest(freq, {FLOOR})))) AS s, CAST(sum(exact) AS BIGINT) AS exact, round(avg(ic), 6) AS specificity FROM m GROUP BY 1, 2),
scored AS (SELECT case_id, disease, round(s + coalesce(cost, 0), 6) AS score, exact, specificity, coalesce(excluded_hits, 0) AS excluded_hits FROM sums LEFT JOIN cost USING (case_id, disease)),
{_RANKED}\nSELECT case_id, disease, score, exact, specificity, excluded_hits, rank, tied FROM ranked WHERE rank <= {TOP}""",
    "agg05_resnik_penalties": f"""{_ALL},\n{_MATCH},\n{_CONTRA},
nq AS (SELECT case_id, count(*) AS nq FROM case_term WHERE status = 'present' GROUP BY 1),
cost AS (SELECT q.case_id, k.disease, sum(coalesce(i.ic, 0) * k.freq) AS cost, count(*) AS excluded_hits FROM case_term q JOIN carried k ON k.ancestor = q.term LEFT JOIN ic i ON i.ancestor = q.term WHERE q.status = 'excluded' GROUP BY 1, 2),
pen AS (SELECT case_id, disease, sum(coalesce(ic, 0)) AS pen FROM contra LEFT JOIN ic ON ancestor = pterm GROUP BY 1, 2),
sums AS (SELECT case_id, disease, sum(ic) AS s, CAST(sum(exact) AS BIGINT) AS exact, round(avg(ic), 6) AS specificity FROM m GROUP BY 1, 2),
scored AS (SELECT case_id, disease, round((s - coalesce(cost, 0) - coalesce(pen, 0)) / nq, 6) AS score, exact, specificity, coalesce(excluded_hits, 0) AS excluded_hits FROM sums JOIN nq USING (case_id) LEFT JOIN cost USING (case_id, disease) LEFT JOIN pen USING (case_id, disease)),
{_RANKED}\nSELECT case_id, disease, score, exact, specificity, excluded_hits, rank, tied FROM ranked WHERE rank <= {TOP}""",
    "agg06_likelihood_penalties": f"""{_ALL},\n{_MATCH},\n{_CONTRA},
best AS (SELECT case_id, term, disease, max(ic + ln(greatest(freq, 0.02))) AS v FROM hit GROUP BY 1, 2, 3),
low AS (SELECT DISTINCT case_id, qterm AS term, disease, true AS low FROM contra),
total AS (SELECT case_id, disease, sum(CASE WHEN low THEN least(coalesce(v, 0), -2.3e0) ELSE v END) AS s FROM best FULL JOIN low USING (case_id, term, disease) GROUP BY 1, 2),
cost AS (SELECT q.case_id, k.disease, sum(ln(1 - least(k.freq, 0.9e0))) AS cost, count(*) AS excluded_hits FROM case_term q JOIN carried k ON k.ancestor = q.term WHERE q.status = 'excluded' GROUP BY 1, 2),
sums AS (SELECT case_id, disease, CAST(sum(exact) AS BIGINT) AS exact, round(avg(ic), 6) AS specificity FROM m GROUP BY 1, 2),
scored AS (SELECT case_id, disease, round(s + coalesce(cost, 0), 6) AS score, exact, specificity, coalesce(excluded_hits, 0) AS excluded_hits FROM sums JOIN total USING (case_id, disease) LEFT JOIN cost USING (case_id, disease)),
{_RANKED}\nSELECT case_id, disease, score, exact, specificity, excluded_hits, rank, tied FROM ranked WHERE rank <= {TOP}""",
    "agg07_gene_rank": f"""{_ALL},\n{_MATCH},\n{_RESNIK},\n{_RANKED},
g AS (SELECT case_id, p_brand AS gene, max(score) AS score, CAST(sum(CAST(round(score * 1e6) AS BIGINT)) AS DOUBLE) / 1e6 AS support, min(rank) AS best_rank, count(*) AS diseases FROM ranked JOIN part ON p_partkey = disease WHERE rank <= {GENE_POOL} GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, best_rank, gene) AS rank FROM g) WHERE rank <= {TOP}""",
    "jn10_not_contradiction": _ALL + """
SELECT DISTINCT q.case_id, a.disease, q.term FROM annotation a JOIN closure c ON c.ancestor = a.term JOIN case_term q ON q.term = c.term AND q.status = 'present'
WHERE a.num = 0 AND NOT EXISTS (SELECT 1 FROM carried k WHERE k.disease = a.disease AND k.ancestor = q.term)""",
    "gra03_subtree": P.with_("edge", "closure", "annotation", recursive=True) + """
SELECT disease, count(*) AS n_terms, CAST(sum(den) AS BIGINT) AS observations FROM annotation WHERE term IN (SELECT term FROM closure WHERE ancestor = 'R0') GROUP BY 1""",
}
QUERIES = {
    "set02_closure": query_closure,
    "agg04_information_content": query_information_content,
    "gra04_frequency_propagation": query_frequency_propagation,
    "agg05_resnik_rank": query_resnik_rank,
    "agg06_likelihood_rank": query_likelihood_rank,
    "agg05_resnik_penalties": query_resnik_penalties,
    "agg06_likelihood_penalties": query_likelihood_penalties,
    "agg07_gene_rank": query_gene_rank,
    "jn10_not_contradiction": query_not_contradiction,
    "gra03_subtree": query_subtree,
}
