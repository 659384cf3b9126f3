"""Ordered merges, allele comparison, spellings of names, token scores, paired alleles and the scoring of runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from helixframe.operators import names, ontology
from helixframe.plans import projections as P

HEADS = ("disease", "disorder", "syndrome")  #: nouns that a name of persons or letters may stand before
BORDERLINE, EXPANDED = 44, 66  #: repeats of the recessive expansion: from here borderline, from here pathogenic (fixed values)


def merged(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, place, id): the first `limit` distinct ids of rows (key, source, at, id), source by source in their order.

    Repeats are dropped before the shuffle by places, so a key with many repeats of few ids stays small.
    """
    first = rows.groupBy(key, "id").agg(F.min(F.struct("source", "at")).alias("f"))
    place = F.row_number().over(W.partitionBy(key).orderBy("f", "id"))
    return first.select(key, place.alias("place"), "id").where(F.col("place") <= limit)


def allele_match(recorded: Column, ours: Column) -> Column:
    """same, different or unknown: different only for two substitutions at one position; anything else is unknown."""
    a, b = names.comparable_change(recorded), names.comparable_change(ours)
    protein, coding = r"^(P\.[A-Z]{3}[0-9]+)([A-Z]{3}|=|\*)$", r"^(C\.[0-9*+-]+[ACGT]>)([ACGT])$"
    place = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, protein, 1), F.lit("")), F.nullif(F.regexp_extract(c, coding, 1), F.lit("")))
    return F.when(a == b, "same").when(place(a) == place(b), "different").otherwise("unknown")


@F.pandas_udf(StringType())
def composed(names_: pd.Series) -> pd.Series:
    """Unicode's compatibility composition (NFKC), which Spark SQL lacks."""
    return names_.str.normalize("NFKC")


def folded(name: Column) -> Column:
    """The tokens of a name run together; null is empty. A name with compatibility forms is to be `composed` before.

    Tokens are runs of digits and runs of letters, these with a possessive ending. Letters are lower-cased; the ending
    goes, so does the last s of a word of five letters or more before one of HEADS; `ae` within a word becomes e. Numerals,
    Roman ones too, that follow each other stay apart by a hyphen, whatever stood between them.
    """
    t = F.translate(F.lower(F.coalesce(name, F.lit(""))), "’‘ʼ", "'''")
    tokens = F.regexp_extract_all(t, F.lit(r"[0-9]+|\p{L}+(?:'s\b)?"), F.lit(0))
    numeral = lambda x: F.coalesce(x.rlike("^(?:[0-9]+|[ivx]+)$"), F.lit(False))

    def each(x: Column, i: Column) -> Column:
        bare = F.regexp_replace(x, "'s$", "")
        plural = (bare == x) & (F.length(x) > 4) & F.endswith(x, F.lit("s")) & F.coalesce(F.get(tokens, i + 1).isin(*HEADS), F.lit(False))
        bare = F.when(plural, F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(bare)
        apart = numeral(x) & (i > 0) & numeral(F.get(tokens, i - 1))
        return F.concat(F.when(apart, "-").otherwise(""), F.substring(bare, 1, 1), F.replace(F.substring(bare, F.lit(2), F.length(bare)), F.lit("ae"), F.lit("e")))

    return F.array_join(F.transform(tokens, each), "")


def is_acronym(text: Column) -> Column:
    """Whether a name is an acronym, alone or before nothing but HEADS, `type` and numerals.

    Its shape has capitals as A, small letters as a, digits as 0 and other ASCII signs as themselves: an acronym's
    has up to 8 places, two A or more and one a at most.
    """
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")
    shape = F.get(parts, F.lit(0))
    for letters, sign in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0")):
        shape = F.regexp_replace(shape, letters, sign)
    formed = shape.rlike(r"^\p{ASCII}{1,8}$") & (F.regexp_count(shape, F.lit("A")) > 1) & (F.regexp_count(shape, F.lit("a")) < 2)
    after = lambda w: F.lower(w).isin(*HEADS, "type") | F.lower(w).rlike("^(?:[0-9]+|[ivx]+)[a-z]?$")
    return formed & F.forall(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), after)

def log_probability(logits: Column, token: Column) -> Column:
    """Log of the softmax at `token` (from 0), shifted by the largest; null for an empty array or a token beyond it."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.get(logits, token) - top - F.log(total)


def published_within(day: Column, since: Column, until: Column) -> Column:
    """After `since`, up to and including `until`; false for a null day, an end that is null is open."""
    return F.coalesce(day.isNotNull() & F.coalesce(day > since, F.lit(True)) & F.coalesce(day <= until, F.lit(True)), F.lit(False))


def joint_reading(first: Column, second: Column) -> Column:
    """What two alleles of a recessive repeat say together; a null second size is not stated, two nulls give null."""
    low, high = F.least(first, second), F.greatest(first, second)
    one = first.isNull() | second.isNull()
    return (
        F.when(high.isNull(), None).when(one, F.when(high >= EXPANDED, "one size, pathogenic").otherwise("one size, not pathogenic")).when(low >= EXPANDED, "biallelic")
        .when(high >= EXPANDED, F.when(low >= BORDERLINE, "one pathogenic, one borderline").otherwise("heterozygous")).when(high >= BORDERLINE, "borderline").otherwise("none")
    )


def run_positions(runs: DataFrame, truth: DataFrame, closed: DataFrame) -> DataFrame:
    """(case, strict, linked): the first rank of each case that names its truth, and that names it or a descendant of it.

    Cases without a hit have nulls; cases without a run are kept. `runs` (case, rank, id), `truth` (case, truth).
    """
    up = closed.select(F.col("term").alias("id"), F.col("ancestor").alias("truth"))
    hit = runs.join(truth, "case").join(up, ["id", "truth"])
    best = hit.groupBy("case").agg(F.min(F.when(F.col("id") == F.col("truth"), F.col("rank"))).alias("strict"), F.min("rank").alias("linked"))
    return truth.select("case").distinct().join(best, "case", "left")


def tuned(rows: DataFrame) -> DataFrame:
    """The candidate with the best top-10 rate, then top-1 rate, on the dev split (the smallest of equals), with its rates on both.

    `rows` (candidate, split, rank); a null rank is a miss. Held-out rows of other candidates aren't looked at in the choice.
    """
    rate = lambda k, s: F.try_divide(F.count_if((F.col("split") == s) & (F.col("rank") <= k)), F.count_if(F.col("split") == s))
    each = rows.groupBy("candidate").agg(*(rate(k, s).alias(f"{s}_top{k}") for s in ("dev", "held") for k in (1, 10)))
    best = each.agg(F.max(F.struct("dev_top10", "dev_top1", (-F.col("candidate")).alias("c"), "held_top1", "held_top10")).alias("b"))
    return best.select((-F.col("b.c")).alias("candidate"), "b.dev_top1", "b.dev_top10", "b.held_top1", "b.held_top10").where("candidate is not null")


def query_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = P.table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", (F.col("l_linenumber") % 3).alias("source"), F.col("l_linenumber").alias("at"), (F.col("l_suppkey") % 6).alias("id"))
    return merged(rows, "l_orderkey", 3).groupBy("place", "id").agg(F.count("*").alias("n"))


def query_allele_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of one spelling against recorded ones of another: the same, another allele, another kind."""
    li, n = P.table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    at = (F.col("l_suppkey") % 5).cast("string")
    recorded = F.when(n % 3 == 0, F.concat(F.lit("p.R"), at, F.lit("W"))).when(n % 3 == 1, F.concat(F.lit("p.(Arg"), at, F.lit("Gln)"))).otherwise(F.concat(F.lit("c."), at, F.lit("G>A")))
    ours = F.concat(F.lit("p.Arg"), (F.col("l_partkey") % 5).cast("string"), F.lit("Trp"))
    return li.groupBy((n % 3).cast("long").alias("kind"), allele_match(recorded, ours).alias("match")).agg(F.count("*").alias("n"))


def query_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and orders' clerks as names of diseases in many spellings: the folded forms and how many are acronyms."""
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    place = lambda n: (F.col("p_partkey") % n).cast("int")
    eponym = F.concat(F.initcap(first), F.element_at(F.array(*map(F.lit, ("’s", "'S", "s", ""))), place(4) + 1), F.lit(" "), second, F.element_at(F.array(*map(F.lit, (" Disease", "-syndrome", " ae"))), place(5) % 3 + 1))
    listed = F.concat(F.upper(F.substring(first, 1, 3)), F.element_at(F.array(*map(F.lit, (" type ", "-", " disorder ", " with "))), place(4) + 1), F.lit("II, III/"), (F.col("p_partkey") % 7).cast("string"))
    mixed = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(second, 1, 2), F.upper(F.substring(second, 3, 2)), F.lit(" Syndrome"))
    raw = F.when(place(3) == 0, eponym).when(place(3) == 1, listed).otherwise(mixed)
    names_ = P.table(spark, sf_dir, "part").select(composed(raw).alias("raw"))
    return names_.groupBy(folded(F.col("raw")).alias("folded")).agg(F.count_if(is_acronym(F.col("raw"))).alias("acronyms"), F.count("*").alias("n"))


def query_log_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = P.table(spark, sf_dir, "lineitem")
    logits = F.array(F.col("l_quantity") / 10, F.col("l_discount") * 20, F.col("l_tax") * 30)
    each = li.select((F.col("l_linenumber") % 4).alias("token"), F.round(log_probability(logits, F.col("l_linenumber") % 4), 6).alias("p"))
    return each.groupBy(F.col("token").cast("long").alias("token")).agg(F.count("p").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))


def query_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer after its own last look, up to a fixed day."""
    o, c = P.table(spark, sf_dir, "orders"), P.table(spark, sf_dir, "customer")
    since = F.when(F.col("c_custkey") % 4 != 0, F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")))
    looked = c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", since.alias("since"))
    new = published_within(F.to_date("o_orderdate"), F.col("since"), F.lit("1997-06-30").cast("date"))
    return o.join(looked, "o_custkey").groupBy("c_mktsegment").agg(F.count_if(new).alias("new"), F.count("*").alias("n"))


def query_joint_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = P.table(spark, sf_dir, "lineitem")
    second = F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("long") * 2)
    return li.groupBy(joint_reading(F.col("l_partkey") % 100, second).alias("reading")).agg(F.count("*").alias("n"))


def query_run_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases whose runs name suppliers or nations; the truth is a nation."""
    li = P.table(spark, sf_dir, "lineitem")
    said = F.when(F.col("l_returnflag") == "R", P.term("N", F.col("l_suppkey") % 25)).otherwise(P.term("S", "l_suppkey"))
    runs = li.select(F.col("l_orderkey").alias("case"), F.col("l_linenumber").alias("rank"), said.alias("id"))
    truth = P.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), P.term("N", F.col("o_orderkey") % 25).alias("truth"))
    found = run_positions(runs, truth, ontology.closure(P.ontology_edges(spark, sf_dir)))
    return found.groupBy("strict", "linked").agg(F.count("*").alias("n"))


def query_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four candidates, their ranks made from order numbers; even orders are for tuning."""
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("candidate"))
    r = (F.col("o_custkey") * (F.col("candidate") + 2) + F.col("o_orderkey") * F.col("candidate")) % 17
    rows = o.select("candidate", F.when(F.col("o_orderkey") % 2 == 0, "dev").otherwise("held").alias("split"), F.when(r < 16, r + 1).alias("rank"))
    return tuned(rows).select("candidate", *(F.round(c, 6).alias(c) for c in ("dev_top1", "dev_top10", "held_top1", "held_top10")))


_HEADS = ", ".join(f"'{h}'" for h in HEADS)
SQL = {
    "set01_merged": """WITH f AS (SELECT l_orderkey AS k, l_suppkey % 6 AS id, min({'s': l_linenumber % 3, 'a': l_linenumber}) AS f FROM lineitem GROUP BY 1, 2),
p AS (SELECT id, CAST(row_number() OVER (PARTITION BY k ORDER BY f.s, f.a, id) AS INTEGER) AS place FROM f) SELECT place, id, count(*) AS n FROM p WHERE place <= 3 GROUP BY 1, 2""",
    "jn17_allele_match": """SELECT CAST(l_linenumber % 3 AS BIGINT) AS kind, CASE WHEN l_suppkey % 5 <> l_partkey % 5 OR l_linenumber % 3 = 2 THEN 'unknown' WHEN l_linenumber % 3 = 0 THEN 'same' ELSE 'different' END AS match, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "str05_spellings": f"""WITH a AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', -1) AS g FROM part),
b AS (SELECT CASE p_partkey % 3 WHEN 0 THEN upper(f[1:1]) || lower(f[2:]) || ['’s', chr(39) || 'S', 's', ''][1 + p_partkey % 4] || ' ' || g || [' Disease', '-syndrome', ' ae'][1 + p_partkey % 5 % 3]
  WHEN 1 THEN upper(f[1:3]) || [' type ', '-', ' disorder ', ' with '][1 + p_partkey % 4] || 'II, III/' || (p_partkey % 7)
  ELSE upper(f[1:1]) || g[1:2] || upper(g[3:4]) || ' Syndrome' END AS raw FROM a),
c AS (SELECT raw, regexp_extract_all(replace(lower(raw), '’', chr(39)), '[0-9]+|\\p{{L}}+(?:'||chr(39)||'s\\b)?') AS t, string_split(raw, ' ') AS p FROM b),
d AS (SELECT *, list_transform(t, lambda x: regexp_full_match(x, '[0-9]+|[ivx]+')) AS num FROM c),
e AS (SELECT *, list_transform(t, lambda x, i: CASE WHEN x LIKE '%'||chr(39)||'s' THEN x[:-3] WHEN length(x) > 4 AND x LIKE '%s' AND coalesce(t[i + 1] IN ({_HEADS}), false) THEN x[:-2] ELSE x END) AS bare FROM d),
g AS (SELECT *, array_to_string(list_transform(bare, lambda x, i: CASE WHEN i > 1 AND num[i] AND num[greatest(i - 1, 1)] THEN '-' ELSE '' END || x[1:1] || replace(x[2:], 'ae', 'e')), '') AS folded,
  length(p[1]) BETWEEN 1 AND 8 AND length(regexp_replace(p[1], '[^A-Z]', '', 'g')) > 1 AND length(regexp_replace(p[1], '[^a-z]', '', 'g')) < 2
  AND list_bool_and(list_transform(p, lambda w, i: i = 1 OR lower(w) IN ({_HEADS}, 'type') OR regexp_full_match(lower(w), '([0-9]+|[ivx]+)[a-z]?'))) AS acronym FROM e)
SELECT folded, count(*) FILTER (acronym) AS acronyms, count(*) AS n FROM g GROUP BY 1""",
    "scl09_log_probability": """WITH x AS (SELECT l_linenumber % 4 AS token, [l_quantity / 10, l_discount * 20, l_tax * 30] AS v FROM lineitem),
p AS (SELECT token, round(v[1 + token] - ln(exp(v[1]) + exp(v[2]) + exp(v[3])), 6) AS p FROM x) SELECT CAST(token AS BIGINT) AS token, count(p) AS n, min(p) AS low, max(p) AS high FROM p GROUP BY 1""",
    "scl03_published": """SELECT c_mktsegment, count(*) FILTER ((c_custkey % 4 = 0 OR CAST(o_orderdate AS DATE) > DATE '1995-01-01' + CAST(c_custkey % 300 AS INTEGER)) AND CAST(o_orderdate AS DATE) <= DATE '1997-06-30') AS new, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "var05_joint_reading": """WITH s AS (SELECT l_partkey % 100 AS a, CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS BIGINT) * 2 END AS b FROM lineitem)
SELECT CASE WHEN b IS NULL THEN CASE WHEN a >= 66 THEN 'one size, pathogenic' ELSE 'one size, not pathogenic' END WHEN a >= 66 AND b >= 66 THEN 'biallelic' WHEN a < 44 AND b < 44 THEN 'none' WHEN a < 66 AND b < 66 THEN 'borderline'
  WHEN a >= 44 AND b >= 44 THEN 'one pathogenic, one borderline' ELSE 'heterozygous' END AS reading, count(*) AS n FROM s GROUP BY 1""",
    "evl02_run_positions": P.with_("edge", "closure", recursive=True) + """,
h AS (SELECT l_orderkey AS k, l_linenumber AS rank, CASE WHEN l_returnflag = 'R' THEN 'N' || (l_suppkey % 25) ELSE 'S' || l_suppkey END AS id, 'N' || (l_orderkey % 25) AS truth FROM lineitem),
b AS (SELECT k, min(CASE WHEN id = truth THEN rank END) AS strict, min(rank) AS linked FROM h JOIN closure ON term = id AND ancestor = truth GROUP BY 1)
SELECT strict, linked, count(*) AS n FROM (SELECT DISTINCT o_orderkey AS k FROM orders) LEFT JOIN b USING (k) GROUP BY 1, 2""",
    "evl03_tuned": """WITH r AS (SELECT c, o_orderkey % 2 = 0 AS dev, (o_custkey * (c + 2) + o_orderkey * c) % 17 AS r FROM orders, (SELECT unnest([0, 1, 2, 3]) AS c)),
g AS (SELECT c, avg(CASE WHEN dev THEN CAST(r = 0 AS INTEGER) END) AS d1, avg(CASE WHEN dev THEN CAST(r < 10 AS INTEGER) END) AS d10, avg(CASE WHEN NOT dev THEN CAST(r = 0 AS INTEGER) END) AS h1, avg(CASE WHEN NOT dev THEN CAST(r < 10 AS INTEGER) END) AS h10 FROM r GROUP BY 1)
SELECT c AS candidate, round(d1, 6) AS dev_top1, round(d10, 6) AS dev_top10, round(h1, 6) AS held_top1, round(h10, 6) AS held_top10 FROM g ORDER BY d10 DESC, d1 DESC, c LIMIT 1""",
}
QUERIES = {
    "set01_merged": query_merged, "jn17_allele_match": query_allele_match, "str05_spellings": query_spellings, "scl09_log_probability": query_log_probability,
    "scl03_published": query_published, "var05_joint_reading": query_joint_reading, "evl02_run_positions": query_run_positions, "evl03_tuned": query_tuned,
}
