"""Identifiers across sources: disease links with how each was made, shapes, positions of the truth in ranked lists, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.ontology import closure
from helixframe.plans import projections as P
from helixframe.sources.scratch import keep, narrow, spread

#: shapes of identifiers by prefix (fixed values)
SHAPES = {
    "HP": r"^\d{7}$", "OMIM": r"^\d{6}$", "ORPHA": r"^\d+$", "MONDO": r"^\d{7}$", "PMID": r"^\d+$", "NCT": r"^\d{8}$",
}


def links(asked: DataFrame, exact: DataFrame, mapped: DataFrame, replaced: DataFrame) -> DataFrame:
    """(omim, mondo, how): classes that an entry leads to, each with how the first link to it was made.

    `exact` (omim, orpha): exact cross-references. `mapped` (object, mondo, obsolete): exact matches of either id. An obsolete
    class leads to its replacement in `replaced` (mondo, by), or, having none, is listed as such. Links of the entry itself
    come before those of its cross-reference, and links to a class in use before links through an obsolete one.
    """
    own = asked.select("omim", F.concat(F.lit("OMIM:"), F.col("omim").cast("string")).alias("object"), F.lit(0).alias("step"))
    through = asked.join(exact, "omim").select("omim", F.concat(F.lit("ORPHA:"), F.col("orpha").cast("string")).alias("object"), F.lit(1).alias("step"))
    # The best link of an object to a class is the same for all entries, so it is found once an object.
    how = F.when(~F.col("obsolete"), "exact match").when(F.col("by").isNotNull(), "replacement of an obsolete match").otherwise("obsolete, not replaced")
    target = F.coalesce(F.when(F.col("obsolete"), F.col("by")), "mondo").alias("mondo")
    best = mapped.join(replaced, "mondo", "left").groupBy("object", target).agg(F.min(F.struct(F.col("obsolete").cast("int").alias("o"), how.alias("how"))).alias("link"))
    best = keep(best.select("object", "mondo", "link.o", "link.how"), "best")
    asks = keep(own.union(through), "asks")
    rows = asks.groupBy("object").agg(F.count("*").alias("a")).join(best.groupBy("object").agg(F.count("*").alias("b")), "object").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
    each = spread(asks, rows or 0, "omim").join(narrow(best), "object").select("omim", "mondo", F.struct((F.col("step") * 2 + F.col("o")).alias("o"), "how", "object").alias("link"))
    first = each.groupBy("omim", "mondo").agg(F.min("link").alias("link"))
    return first.select("omim", "mondo", F.col("link.how").alias("how"), F.col("link.object").alias("source"))


def query_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, p = (P.table(spark, sf_dir, t) for t in ("supplier", "customer", "part"))
    asked = s.select(F.col("s_suppkey").alias("omim"))
    exact = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("omim"), (F.col("s_suppkey") % 50).alias("orpha"))
    mondo = lambda key: (F.col(key) % 300).alias("mondo")
    of = lambda prefix, key: F.concat(F.lit(prefix), key.cast("string")).alias("object")
    mapped = c.select(of("OMIM:", F.col("c_custkey") % 700), mondo("c_custkey")).union(p.select(of("ORPHA:", F.col("p_size")), mondo("p_partkey"))).distinct()
    mapped = mapped.withColumn("obsolete", F.col("mondo") % 10 == 0)
    replaced = mapped.where("mondo % 20 = 0").select("mondo", (F.col("mondo") + 1).alias("by")).distinct()
    return links(asked, exact, mapped, replaced)


def shape(raw: Column) -> Column:
    """An identifier as PREFIX:VALUE, null if its prefix is unknown or its value can't be one; NCT numbers carry their own prefix."""
    text = F.trim(raw)
    text = F.when(text.rlike(r"(?i)^NCT\d+$"), F.concat(F.lit("NCT:"), F.substring(text, 4, 100))).otherwise(text)
    prefix, value = F.upper(F.trim(F.split_part(text, F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace(text, "^[^:]*:", ""))
    known = F.create_map(*(F.lit(x) for kv in SHAPES.items() for x in kv))
    return F.when(F.contains(text, F.lit(":")) & F.regexp_like(value, known[prefix]), F.concat(prefix, F.lit(":"), value))


def query_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = P.table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    forms = F.array(
        F.concat(F.lit(" hp:"), F.lpad(k, 7, "0")), F.concat(F.lit("OMIM:"), k), F.concat(F.lit("orpha : "), k), F.concat(F.lit("nct"), F.lpad(k, 8, "0")),
        F.concat(F.lit("XX:"), k), k, F.concat(F.lit("PMID:"), k, F.lit("x")), F.concat(F.lit("MONDO:"), F.lpad(k, 7, "1")),
    )
    return p.select("p_partkey", F.posexplode(forms).alias("form", "raw")).select("p_partkey", "form", shape(F.col("raw")).alias("id"))


def positions(ranked: DataFrame) -> DataFrame:
    """(case, source, first, tie_first, tied, listed) from (case, source, rank, score, hit): where the truth stands, with its tie block.

    `first` is the best rank of a hit; `tie_first` and `tied` are the first place and the size of the block of that
    score, null if there is no hit. Scores of a list are counted before they are met, so no list is gathered.
    """
    key = ["case", "source"]
    hits = ranked.groupBy(*key).agg(F.min(F.when(F.col("hit"), F.struct("rank", "score"))).alias("h"), F.count("*").alias("listed"))
    blocks = ranked.groupBy(*key, "score").agg(F.min("rank").alias("tie_first"), F.count("*").alias("tied"))
    hits = hits.select(*key, "listed", F.col("h.rank").alias("first"), F.col("h.score").alias("score"))
    return hits.join(blocks, [*key, "score"], "left").select(*key, "first", "tie_first", "tied", "listed")


def query_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = P.table(spark, sf_dir, "lineitem")
    ranked = li.select(F.col("l_orderkey").alias("case"), F.col("l_linestatus").alias("source"), F.col("l_linenumber").alias("rank"), (-F.floor(F.col("l_linenumber") / 2)).alias("score"), (F.col("l_partkey") % 4 == F.col("l_orderkey") % 4).alias("hit"))
    return positions(ranked)


def remove(cited: DataFrame, removed: DataFrame) -> DataFrame:
    """(hypothesis, support, against, dropped, unsupported) from (hypothesis, item, side) and the items taken away.

    `unsupported`: something that supported it was taken away and nothing that supports it is left.
    """
    j = cited.join(removed.select("item", F.lit(True).alias("_gone")).distinct(), "item", "left")
    gone, side = F.col("_gone").isNotNull(), F.col("side")
    by = j.groupBy("hypothesis").agg(F.count_if(~gone & (side == "support")).alias("support"), F.count_if(~gone & (side == "against")).alias("against"), F.count_if(gone).alias("dropped"), F.count_if(gone & (side == "support")).alias("_lost"))
    return by.withColumn("unsupported", (F.col("_lost") > 0) & (F.col("support") == 0)).drop("_lost")


def query_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s = P.table(spark, sf_dir, "lineitem"), P.table(spark, sf_dir, "supplier")
    cited = li.select(F.col("l_orderkey").alias("hypothesis"), F.col("l_suppkey").alias("item"), F.when(F.col("l_returnflag") == "N", "against").otherwise("support").alias("side"))
    return remove(cited, s.where("s_acctbal < 3000").select(F.col("s_suppkey").alias("item")))


def query_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded terms of each case (carried to their parents), and whether a present term lies under them, so that they go."""
    edges, cases = P.ontology_edges(spark, sf_dir), P.case_terms(spark, sf_dir)
    excluded = cases.where("status = 'excluded'").join(edges, F.col("term") == F.col("child")).select("case_id", F.col("parent").alias("excluded")).distinct()
    implied = cases.where("status = 'present'").join(closure(edges), "term").select("case_id", F.col("ancestor").alias("excluded"), F.lit(True).alias("_in")).distinct()
    return excluded.join(implied, ["case_id", "excluded"], "left").select("case_id", "excluded", F.col("_in").isNotNull().alias("contradicted"))


def query_descendant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of each case by how they meet the truth (the nation of its first term): equal, below it, or elsewhere."""
    edges, cases = P.ontology_edges(spark, sf_dir), P.case_terms(spark, sf_dir).where("status = 'present'")
    truth = cases.groupBy("case_id").agg(F.min("term").alias("child")).join(edges, "child").groupBy("case_id").agg(F.min("parent").alias("truth"))
    under = closure(edges).select("term", F.col("ancestor").alias("truth"), F.lit(True).alias("_under"))
    answers = cases.select("case_id", "term").union(truth.select("case_id", F.col("truth").alias("term")))
    j = answers.join(truth, "case_id").join(under, ["term", "truth"], "left")
    verdict = F.when(F.col("term") == F.col("truth"), "equal").when(F.col("_under").isNotNull(), "below").otherwise("elsewhere")
    return j.groupBy("case_id", verdict.alias("verdict")).agg(F.count("*").alias("n"))


_SHAPE = "CASE prefix " + " ".join(f"WHEN '{k}' THEN regexp_matches(value, '{v}')" for k, v in SHAPES.items()) + " ELSE false END"
SQL = {
    "res01_links": """WITH m AS (SELECT DISTINCT 'OMIM:' || (c_custkey % 700) AS object, c_custkey % 300 AS mondo FROM customer UNION SELECT DISTINCT 'ORPHA:' || p_size, p_partkey % 300 FROM part),
a AS (SELECT s_suppkey AS omim, 'OMIM:' || s_suppkey AS object, 0 AS step FROM supplier UNION ALL SELECT s_suppkey, 'ORPHA:' || (s_suppkey % 50), 1 FROM supplier WHERE s_suppkey % 3 <> 0),
l AS (SELECT omim, CASE WHEN mondo % 20 = 0 THEN mondo + 1 ELSE mondo END AS mondo, step * 2 + CASE WHEN mondo % 10 = 0 THEN 1 ELSE 0 END AS o,
  CASE WHEN mondo % 10 <> 0 THEN 'exact match' WHEN mondo % 20 = 0 THEN 'replacement of an obsolete match' ELSE 'obsolete, not replaced' END AS how, object AS source FROM a JOIN m USING (object))
SELECT omim, mondo, how, source FROM (SELECT *, row_number() OVER (PARTITION BY omim, mondo ORDER BY o, how, source) AS rn FROM l) WHERE rn = 1""",
    "src25_shapes": f"""WITH p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part),
f AS (SELECT p_partkey, unnest([' hp:' || lpad(k, 7, '0'), 'OMIM:' || k, 'orpha : ' || k, 'NCT:' || lpad(k, 8, '0'), 'XX:' || k, k, 'PMID:' || k || 'x', 'MONDO:' || lpad(k, 7, '1')]) AS raw, unnest(range(8)) AS form FROM p),
s AS (SELECT *, upper(trim(split_part(raw, ':', 1))) AS prefix, trim(split_part(raw, ':', 2)) AS value FROM f)
SELECT p_partkey, CAST(form AS INTEGER) AS form, CASE WHEN contains(raw, ':') AND {_SHAPE} THEN prefix || ':' || value END AS id FROM s""",
    "evl01_positions": """WITH r AS (SELECT l_orderkey AS c, l_linestatus AS source, l_linenumber AS rank, l_linenumber // 2 AS score, l_partkey % 4 = l_orderkey % 4 AS hit FROM lineitem),
f AS (SELECT c, source, min(rank) FILTER (hit) AS first, count(*) AS listed FROM r GROUP BY 1, 2)
SELECT f.c AS "case", f.source, first, min(rank) AS tie_first, CASE WHEN first IS NOT NULL THEN count(r.rank) END AS tied, listed FROM f LEFT JOIN r ON r.c = f.c AND r.source = f.source AND r.score = f.first // 2 GROUP BY 1, 2, 3, listed""",
    "ups04_remove": """WITH j AS (SELECT l_orderkey AS hypothesis, s_suppkey IS NOT NULL AS gone, l_returnflag <> 'N' AS sup FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal < 3000)
SELECT hypothesis, count(*) FILTER (NOT gone AND sup) AS support, count(*) FILTER (NOT gone AND NOT sup) AS against, count(*) FILTER (gone) AS dropped, bool_or(gone AND sup) AND NOT bool_or(NOT gone AND sup) AS unsupported FROM j GROUP BY 1""",
    "jn11_contradiction": P.with_("edge", "closure", "case_term", recursive=True) + """
SELECT DISTINCT x.case_id, e.parent AS excluded, EXISTS (SELECT 1 FROM case_term p JOIN closure c ON c.term = p.term WHERE p.case_id = x.case_id AND p.status = 'present' AND c.ancestor = e.parent) AS contradicted
FROM case_term x JOIN edge e ON e.child = x.term WHERE x.status = 'excluded'""",
    "gra05_descendant": P.with_("edge", "closure", "case_term", recursive=True) + """,
f AS (SELECT case_id, min(term) AS child FROM case_term WHERE status = 'present' GROUP BY 1), t AS (SELECT case_id, min(parent) AS truth FROM f JOIN edge USING (child) GROUP BY 1),
a AS (SELECT case_id, term FROM case_term WHERE status = 'present' UNION ALL SELECT case_id, truth FROM t)
SELECT case_id, CASE WHEN a.term = truth THEN 'equal' WHEN EXISTS (SELECT 1 FROM closure c WHERE c.term = a.term AND c.ancestor = truth) THEN 'below' ELSE 'elsewhere' END AS verdict, count(*) AS n FROM a JOIN t USING (case_id) GROUP BY ALL""",
}
QUERIES = {
    "res01_links": query_links, "src25_shapes": query_shapes, "evl01_positions": query_positions, "ups04_remove": query_remove,
    "jn11_contradiction": query_contradiction, "gra05_descendant": query_descendant,
}
