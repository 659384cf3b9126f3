"""Benchmark analytics: top-k rates with intervals, cluster bootstrap, strata, splits, samples, nearest neighbours, quotas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.operators.genotype import wilson
from helixframe.plans import projections as P
from helixframe.sources.scratch import keep, spread

REPS = 1000
KS = (1, 3, 10, 25)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, disease, pos, n_terms, split): one case an order; `pos` is null for a miss."""
    o = P.table(spark, sf_dir, "orders")
    li = P.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n_terms"), F.min("l_partkey").alias("disease"), F.max(F.col("l_quantity").cast("int")).alias("q"))
    pos = F.when(F.col("q") % 10 != 9, F.col("q") - F.lit(20)).cast("int")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("case_id"), "disease", F.when(pos.isNotNull(), F.greatest(pos, F.lit(1))).alias("pos"), "n_terms", F.when(F.col("disease") % 2 == 0, "dev").otherwise("held_out").alias("split"), F.col("o_orderstatus").alias("mode")
    )


def bucket(n: Column) -> Column:
    return F.when(n <= 3, "1-3").when(n <= 6, "4-6").when(n <= 10, "7-10").otherwise(">10")


def top_k(data: DataFrame, *by: str) -> DataFrame:
    """Rate of cases placed in the first k for each k, by case and by disease, with Wilson's interval."""
    hit = [F.coalesce(F.col("pos") <= k, F.lit(False)).cast("int") for k in KS]
    each = data.select(*by, "disease", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), h.alias("hit")) for k, h in zip(KS, hit, strict=True)))).alias("x")).select(*by, "disease", "x.*")
    micro = each.groupBy(*by, "k").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    macro = each.groupBy(*by, "k", "disease").agg(F.avg("hit").alias("r")).groupBy(*by, "k").agg(F.avg("r").alias("macro"))
    low, high = wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return micro.join(macro, [*by, "k"]).select(*by, "k", "hits", "n", F.round(F.col("hits") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round("macro", 6).alias("macro"))


def query_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(cases(spark, sf_dir), "split")


def query_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and hits by split, bucket of terms and mode, with their subtotals, in one pass."""
    c = cases(spark, sf_dir).withColumn("bucket", bucket(F.col("n_terms")))
    g = c.cube("split", "bucket", "mode").agg(F.count("*").alias("n"), F.count_if(F.col("pos") <= 10).alias("top10"), F.grouping_id().cast("int").alias("level"))
    return g.select(*(F.coalesce(x, F.lit("all")).alias(x) for x in ("split", "bucket", "mode")), "level", "n", "top10")


def poisson_edges(mean: float = 1.0, tail: float = 1e-16) -> list[float]:
    """Cumulative probabilities of a Poisson number, up to where less than `tail` is left."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while 1 - total > tail and total + term > total:
        total += term
        out.append(total)
        k += 1
        term *= mean / k
    return out


EDGES = poisson_edges()


def unit(rep: Column, cluster: Column) -> Column:
    """A number in [0, 1) from the md5 of replicate and cluster."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", rep.cast("string"), cluster.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def draws(u: Column) -> Column:
    """Times a cluster is drawn in a replicate: the Poisson number of mean one at `u`, looked for from the likeliest on."""
    out = F.lit(len(EDGES))
    for k in range(len(EDGES) - 1, -1, -1):
        out = F.when(u < EDGES[k], F.lit(k)).otherwise(out)
    return out


def query_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster bootstrap of the top-10 rate: whole diseases are drawn, REPS times; disease sums are made once."""
    by = cases(spark, sf_dir).groupBy("split", "disease").agg(F.count("*").alias("n"), F.count_if(F.col("pos") <= 10).alias("hits"))
    reps = by.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(REPS)))).select("*", F.explode(F.array(unit(F.col("rep"), F.col("disease")))).alias("u")).withColumn("m", draws(F.col("u")))  # a generator: u is made once
    rates = reps.groupBy("split", "rep").agg(F.try_divide(F.sum(F.col("m") * F.col("hits")), F.sum(F.col("m") * F.col("n"))).alias("rate"))
    order = W.partitionBy("split").orderBy("rate", "rep")
    r = rates.withColumn("i", F.row_number().over(order))
    return r.groupBy("split").agg(F.round(F.max(F.when(F.col("i") == REPS // 40, F.col("rate"))), 6).alias("low"), F.round(F.max(F.when(F.col("i") == REPS - REPS // 40, F.col("rate"))), 6).alias("high"), F.round(F.avg("rate"), 6).alias("mean"))


def query_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole diseases to two halves by a hash, never a disease to both; with the cases of each."""
    c = cases(spark, sf_dir).groupBy("disease").agg(F.count("*").alias("n"))
    half = F.when(F.conv(F.substring(F.md5(F.col("disease").cast("string")), 1, 4), 16, 10).cast("int") < 32768, "dev").otherwise("held_out")
    return c.groupBy(half.alias("half")).agg(F.count("*").alias("diseases"), F.sum("n").alias("cases"), F.min("disease").alias("first"))


def query_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case a disease: the one with the smallest md5 of its id."""
    order = W.partitionBy("disease").orderBy(F.md5(F.concat(F.lit("s:"), F.col("case_id").cast("string"))), "case_id")
    return cases(spark, sf_dir).withColumn("i", F.row_number().over(order)).where("i = 1").select("disease", "case_id", "pos")


PAIRS = 2_000_000  #: pairs that a task makes and counts, about


def nearest(sets: DataFrame, part: int = PAIRS) -> DataFrame:
    """(a, b, jaccard): of each a of the distinct rows (a, x) the other one of greatest Jaccard similarity to six digits, of equals the smallest.

    An inverted index, of which each member of an entry gets the entry itself, as two arrays of small numbers; pairs are
    made and counted where all entries of an `a` meet, in tasks of about `part` pairs, and none is shuffled.
    """
    sets = keep(sets.withColumn("n", F.count("*").over(W.partitionBy("a"))), "sets")
    most = sets.agg(F.max("a").alias("a"), F.min("a").alias("least"), F.max("n").alias("n")).first()
    ids = "int" if most["a"] is not None and isinstance(most["a"], int) and -(1 << 31) <= most["least"] and most["a"] < 1 << 31 else sets.schema["a"].dataType.simpleString()
    sizes = "smallint" if (most["n"] or 0) < 1 << 15 else "int"
    entry = F.sort_array(F.collect_list(F.struct(F.col("a").cast(ids).alias("a"), F.col("n").cast(sizes).alias("n"))))
    entries = sets.groupBy("x").agg(entry.alias("e")).where(F.size("e") > 1)
    index = keep(entries.select(F.col("e.a").alias("bs"), F.col("e.n").alias("ns")), "index")
    pairs = index.agg(F.sum(F.size("bs").cast("long") * F.size("bs"))).first()[0] or 0
    sent = spread(index.select(F.posexplode("bs").alias("i", "a"), "bs", "ns").select("a", F.expr("ns[i]").alias("na"), "bs", "ns"), pairs, "a", part=part)
    met = sent.select("a", "na", F.explode(F.arrays_zip("bs", "ns")).alias("o")).select("a", "na", F.col("o.bs").alias("b"), F.col("o.ns").alias("nb")).where("a <> b")
    common = met.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("i"))
    j = common.select("a", "b", F.round(F.col("i") / (F.col("na").cast("long") + F.col("nb") - F.col("i")), 6).alias("jaccard"))
    best = j.groupBy("a").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "b")).alias("m"))
    kind = sets.schema["a"].dataType
    return best.select(F.col("a").cast(kind).alias("a"), F.col("m.b").cast(kind).alias("b"), (-F.col("m.j")).alias("jaccard"))


def query_nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out nearest customer by Jaccard of the parts bought, through an inverted index, and whether its segment is the same."""
    o, li, c = (P.table(spark, sf_dir, x) for x in ("orders", "lineitem", "customer"))
    best = nearest(o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_partkey").alias("x")).where("a IS NOT NULL AND x IS NOT NULL").distinct())
    seg = c.select(F.col("c_custkey"), "c_mktsegment")
    return best.join(seg.toDF("a", "sa"), "a").join(seg.toDF("b", "sb"), "b").select("a", "b", "jaccard", (F.col("sa") == F.col("sb")).alias("hit"))


def query_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per user within the last minute and hour (RANGE frames), and those over the limits."""
    e = P.table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    last = lambda sec: W.partitionBy("user_id").orderBy("s").rangeBetween(-sec * 1_000_000, 0)
    q = e.select("user_id", F.count("*").over(last(60)).alias("minute"), F.count("*").over(last(3600)).alias("hour"))
    return q.groupBy("user_id").agg(F.max("minute").alias("most_a_minute"), F.max("hour").alias("most_an_hour"), F.count_if(F.col("hour") > 3).alias("over"))


def query_recheck_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask again: per kind the newest five of each user, with how many are left out."""
    e = P.table(spark, sf_dir, "events")
    w = W.partitionBy("user_id", "event_type")
    n = e.select("user_id", "event_type", "event_id", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("n"), F.count("*").over(w).alias("all"))
    return n.where("n <= 5").groupBy("user_id", "event_type").agg(F.count("*").alias("asked"), F.max(F.col("all") - 5).alias("x"), F.max("event_id").alias("newest")).select("user_id", "event_type", "asked", F.greatest("x", F.lit(0)).alias("left_out"), "newest")


_CASES = """li AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_terms, min(l_partkey) AS disease, max(CAST(l_quantity AS INTEGER)) AS q FROM lineitem GROUP BY 1),
cases AS (SELECT o_orderkey AS case_id, disease, CASE WHEN q % 10 <> 9 THEN greatest(q - 20, 1) END AS pos, n_terms, CASE WHEN disease % 2 = 0 THEN 'dev' ELSE 'held_out' END AS split, o_orderstatus AS mode FROM orders JOIN li ON o_orderkey = l_orderkey)"""
_Z = "1.959963984540054e0"
SQL = {
    "agg27_top_k": f"""WITH {_CASES}, k(k) AS (VALUES {', '.join(f'({k})' for k in KS)}), e AS (SELECT split, k, disease, CASE WHEN pos <= k THEN 1 ELSE 0 END AS hit FROM cases, k),
m AS (SELECT split, k, avg(r) AS macro FROM (SELECT split, k, disease, avg(hit) AS r FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2),
h AS (SELECT split, k, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS n, CAST(sum(hit) AS DOUBLE) / count(*) AS p, {_Z} * {_Z} AS z2 FROM e GROUP BY 1, 2)
SELECT split, k, hits, n, round(p, 6) AS rate, round(greatest(0, (p + z2 / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + z2 / (4e0 * n * n))) / (1 + z2 / n)), 6) AS low, round(least(1, (p + z2 / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + z2 / (4e0 * n * n))) / (1 + z2 / n)), 6) AS high, round(macro, 6) AS macro FROM h JOIN m USING (split, k)""",
    "agg28_strata": f"""WITH {_CASES}, b AS (SELECT *, CASE WHEN n_terms <= 3 THEN '1-3' WHEN n_terms <= 6 THEN '4-6' WHEN n_terms <= 10 THEN '7-10' ELSE '>10' END AS bucket FROM cases)
SELECT coalesce(split, 'all') AS split, coalesce(bucket, 'all') AS bucket, coalesce(mode, 'all') AS mode, CAST(grouping_id(split, bucket, mode) AS INTEGER) AS level, count(*) AS n, count(*) FILTER (pos <= 10) AS top10 FROM b GROUP BY CUBE (split, bucket, mode)""",
    "agg27_bootstrap": f"""WITH {_CASES}, d AS (SELECT split, disease, count(*) AS n, count(*) FILTER (pos <= 10) AS hits FROM cases GROUP BY 1, 2),
u AS (SELECT d.*, rep, CAST(CAST('0x' || substr(md5(rep || ':' || disease), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0 AS u FROM d, range(1, {REPS + 1}) t(rep)),
m AS (SELECT *, {' + '.join(f"CASE WHEN u >= CAST('{e!r}' AS DOUBLE) THEN 1 ELSE 0 END" for e in EDGES)} AS m FROM u),
r AS (SELECT split, rep, CAST(sum(m * hits) AS DOUBLE) / CAST(sum(m * n) AS DOUBLE) AS rate FROM m WHERE m > 0 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY rate, rep) AS i FROM r)
SELECT split, round(max(CASE WHEN i = {REPS // 40} THEN rate END), 6) AS low, round(max(CASE WHEN i = {REPS - REPS // 40} THEN rate END), 6) AS high, round(avg(rate), 6) AS mean FROM o GROUP BY 1""",
    "top06_split": f"""WITH {_CASES}, d AS (SELECT disease, count(*) AS n FROM cases GROUP BY 1)
SELECT CASE WHEN CAST('0x' || substr(md5(CAST(disease AS VARCHAR)), 1, 4) AS INTEGER) < 32768 THEN 'dev' ELSE 'held_out' END AS half, count(*) AS diseases, CAST(sum(n) AS BIGINT) AS cases, min(disease) AS first FROM d GROUP BY 1""",
    "top07_stratified_sample": f"""WITH {_CASES} SELECT disease, case_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY disease ORDER BY md5('s:' || case_id), case_id) AS i FROM cases) WHERE i = 1""",
    "top08_nearest_neighbour": """WITH s AS (SELECT DISTINCT o_custkey AS a, l_partkey AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey), n AS (SELECT a, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT p.a, q.a AS b, count(*) AS i FROM s p JOIN s q ON p.x = q.x AND p.a <> q.a GROUP BY 1, 2),
j AS (SELECT c.a, c.b, round(CAST(i AS DOUBLE) / (x.n + y.n - i), 6) AS jaccard FROM c JOIN n x ON x.a = c.a JOIN n y ON y.a = c.b),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, b) AS n FROM j) WHERE n = 1)
SELECT f.a, f.b, jaccard, x.c_mktsegment = y.c_mktsegment AS hit FROM f JOIN customer x ON x.c_custkey = f.a JOIN customer y ON y.c_custkey = f.b""",
    "qta01_quota": """WITH q AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS minute, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS hour FROM events)
SELECT user_id, max(minute) AS most_a_minute, max(hour) AS most_an_hour, count(*) FILTER (hour > 3) AS over FROM q GROUP BY 1""",
    "pln01_recheck_plan": """WITH n AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS a FROM events)
SELECT user_id, event_type, count(*) AS asked, greatest(max(a) - 5, 0) AS left_out, max(event_id) AS newest FROM n WHERE n <= 5 GROUP BY 1, 2""",
}
QUERIES = {
    "agg27_top_k": query_top_k, "agg28_strata": query_strata, "agg27_bootstrap": query_bootstrap, "top06_split": query_split, "top07_stratified_sample": query_stratified_sample,
    "top08_nearest_neighbour": query_nearest_neighbour, "qta01_quota": query_quota, "pln01_recheck_plan": query_recheck_plan,
}
