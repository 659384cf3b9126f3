"""Classical statistics: exact tests, tails, intervals, survival, log-rank, segregation, carriers, N-of-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions.special import lgamma, log_choose
from helixframe.operators.genotype import wilson
from helixframe.plans import projections as P
from helixframe.sources.scratch import keep, spread


STRETCH = 2048  #: cells of a table's support that are dealt together


def fisher(tables: DataFrame, key: str) -> DataFrame:
    """tables(key, a, b, c, d): two-sided and greater p, odds ratio with Haldane's correction and Woolf's interval.

    The support of each table is exploded, so a table costs a row for each possible first cell. It is dealt in stretches
    of STRETCH cells, so that few tables of large counts use as many tasks as many small ones.
    """
    tables = keep(tables, "tables")
    lo, hi = F.greatest(F.lit(0), F.col("a") + F.col("c") - F.col("c") - F.col("d")), F.least(F.col("a") + F.col("b"), F.col("a") + F.col("c"))
    n, row, col = F.col("a") + F.col("b") + F.col("c") + F.col("d"), F.col("a") + F.col("b"), F.col("a") + F.col("c")
    g = lambda x: lgamma((x + 1).cast("double"))
    tables = tables.withColumns({"_col": g(col), "_rest": g(n - col), "_all": log_choose(n, row)})  # what all cells of a table share
    logp = lambda x: (F.col("_col") - g(x) - g(col - x)) + (F.col("_rest") - g(row - x) - g(n - col - row + x)) - F.col("_all")
    cells = tables.agg(F.sum(hi - lo + 1)).first()[0] or 0
    parts = tables.select("*", hi.alias("_hi"), F.explode(F.sequence(lo, hi, F.lit(STRETCH).cast("long"))).alias("_x"))
    parts = spread(parts.withColumn("seen", logp(F.col("a"))), cells, key, "_x", part=10 * STRETCH)
    each = parts.select("*", F.explode(F.sequence(F.col("_x"), F.least(F.col("_x") + STRETCH - 1, F.col("_hi")))).alias("x")).withColumn("lp", logp(F.col("x")))
    sums = each.groupBy(key, "a", "b", "c", "d").agg(
        F.sum(F.when(F.col("lp") <= F.col("seen") + 1e-7, F.exp("lp")).otherwise(0.0)).alias("p_two"), F.sum(F.when(F.col("x") >= F.col("a"), F.exp("lp")).otherwise(0.0)).alias("p_greater")
    )
    fix = F.when(F.least("a", "b", "c", "d") == 0, 0.5).otherwise(0.0)
    a, b, c, d = (F.col(x) + fix for x in "abcd")
    log_or, se = F.log(a * d / (b * c)), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    r = lambda x: F.round(x, 6)
    return sums.select(key, "a", "b", "c", "d", r(F.least("p_two", F.lit(1.0))).alias("p_two"), r(F.least("p_greater", F.lit(1.0))).alias("p_greater"), r(F.exp(log_or)).alias("odds_ratio"), r(F.exp(log_or - 1.96 * se)).alias("or_low"), r(F.exp(log_or + 1.96 * se)).alias("or_high"))


def query_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned against kept lines by status, for each brand."""
    li, p = P.table(spark, sf_dir, "lineitem"), P.table(spark, sf_dir, "part")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    r, f = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    return fisher(j.groupBy(F.col("p_brand").alias("brand")).agg(F.count_if(r & f).alias("a"), F.count_if(r & ~f).alias("b"), F.count_if(~r & f).alias("c"), F.count_if(~r & ~f).alias("d")), "brand")


def query_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers of a discount-heavy line among urgent (case) and low-priority (control) orders, per customer segment."""
    li, o, c = (P.table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer"))
    carrier = li.groupBy("l_orderkey").agg(F.max((F.col("l_discount") >= 0.08).cast("int")).alias("carrier"))
    j = o.join(carrier, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    case, control, yes = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW", F.col("carrier") == 1
    t = j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_if(case & yes).alias("a"), F.count_if(case & ~yes).alias("b"), F.count_if(control & yes).alias("c"), F.count_if(control & ~yes).alias("d"))
    return fisher(t, "segment")


def poisson_upper(k: Column, mu: Column) -> Column:
    """P(X >= k), summed from the term of k upwards, so that small tails keep their digits; a closed number of terms."""
    terms = F.ceil(F.abs(mu - k) + 10 * F.sqrt(mu) + 60).cast("int")
    first = F.exp(-mu + k * F.log(mu) - lgamma((k + 1).cast("double")))
    start = F.struct(first.alias("t"), first.alias("s"))

    def step(acc: Column, j: Column) -> Column:
        t = acc["t"] * mu / (k + j)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1), terms), start, step)["s"]
    return F.when(k <= 0, 1.0).when(mu <= 0, 0.0).otherwise(F.least(total, F.lit(1.0)))


def query_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines per supplier against the mean of all: upper Poisson tail, its logarithm, and enrichment."""
    li = P.table(spark, sf_dir, "lineitem")
    by = li.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") % 10 == F.col("l_suppkey") % 10)).alias("k"))
    by = by.crossJoin(F.broadcast(by.agg(F.avg("k").alias("mu"))))  # one row
    by = by.withColumn("p", poisson_upper(F.col("k"), F.col("mu")))
    return by.select("supplier", "k", F.round("p", 6).alias("p_upper"), F.round(F.log10(F.when(F.col("p") > 0, F.col("p"))), 6).alias("log10_p"), F.round(F.col("k") / F.col("mu"), 6).alias("enrichment"))


def query_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of status F among returned ones, per supplier: lower binomial tail at one half, with Wilson's interval."""
    li = P.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    by = li.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count_if(F.col("l_linestatus") == "F").alias("k"), F.count("*").alias("n"))
    each = by.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    term = F.exp(log_choose(F.col("n"), F.col("i")) - F.col("n") * F.log(F.lit(2.0)))
    low, high = wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    sums = each.groupBy("supplier", "k", "n").agg(F.sum(term).alias("p"))
    return sums.select("supplier", "k", "n", F.round("p", 6).alias("p_lower"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def life_table(data: DataFrame, by: str = "grp") -> DataFrame:
    """(by, time, d, c, at_risk): events, censorings and numbers at risk at each time."""
    t = data.groupBy(by, "time").agg(F.sum("event").alias("d"), F.sum(1 - F.col("event")).alias("c"))
    return t.withColumn("at_risk", F.sum(F.col("d") + F.col("c")).over(W.partitionBy(by).orderBy(F.desc("time")).rowsBetween(W.unboundedPreceding, 0)))


def kaplan_meier(data: DataFrame, by: str = "grp") -> DataFrame:
    """Rows at event times: survival with Greenwood bounds; once nobody is left it is 0."""
    t = life_table(data, by).where("d > 0")
    run = W.partitionBy(by).orderBy("time").rowsBetween(W.unboundedPreceding, 0)
    alive = F.col("at_risk") > F.col("d")
    t = t.withColumns({
        "_log": F.sum(F.when(alive, F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)).over(run),
        "_over": F.max((~alive).cast("int")).over(run),
        "_green": F.sum(F.when(alive, F.col("d") / (F.col("at_risk") * (F.col("at_risk") - F.col("d")))).otherwise(0.0)).over(run),
    })
    s = F.when(F.col("_over") == 1, 0.0).otherwise(F.exp("_log"))
    se = s * F.sqrt("_green")
    return t.select(by, "time", "at_risk", F.col("d").alias("events"), F.round(s, 6).alias("survival"), F.round(F.greatest(F.lit(0.0), s - 1.96 * se), 6).alias("low"), F.round(F.least(F.lit(1.0), s + 1.96 * se), 6).alias("high"))


def query_kaplan_meier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kaplan_meier(P.survival(spark, sf_dir))


def query_median_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = kaplan_meier(P.survival(spark, sf_dir))
    return km.groupBy("grp").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"), F.max("time").alias("last_event"))


def query_logrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders against all others."""
    d = P.survival(spark, sf_dir).withColumn("grp", (F.col("grp") == "1-URGENT").cast("int"))
    t = d.groupBy("time").agg(F.sum(F.col("event") * F.col("grp")).alias("d1"), F.sum("event").alias("d"), F.sum("grp").alias("n1"), F.count("*").alias("n"))
    later = W.orderBy(F.desc("time")).rowsBetween(W.unboundedPreceding, 0)  # one row a distinct time
    t = t.withColumns({"r1": F.sum("n1").over(later), "r": F.sum("n").over(later)}).where("d > 0")
    expected = F.col("d") * F.col("r1") / F.col("r")
    var = F.when(F.col("r") > 1, F.col("d") * (F.col("r1") / F.col("r")) * (1 - F.col("r1") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    s = t.agg(F.sum("d1").alias("observed"), F.sum(expected).alias("e"), F.sum(var).alias("v"))
    return s.select("observed", F.round("e", 4).alias("expected"), F.round("v", 4).alias("variance"), F.round((F.col("observed") - F.col("e")) * (F.col("observed") - F.col("e")) / F.col("v"), 5).alias("chi2"))


def query_hardy_weinberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per chromosome the mother's allele frequency, expected and seen heterozygotes, and the largest credible frequency."""
    g = P.genotypes(spark, sf_dir).groupBy("chrom").agg(F.sum("m").alias("alt"), F.count("*").alias("n"), F.count_if(F.col("m") == 1).alias("hets"))
    q = F.col("alt") / (2 * F.col("n"))
    return g.select("chrom", F.round(q, 6).alias("q"), F.round(2 * q * (1 - q), 6).alias("expected_het"), F.round(F.col("hets") / F.col("n"), 6).alias("seen_het"), F.round(q * q, 6).alias("prevalence"), F.round(0.1 * F.sqrt(q * q * 0.5 / 0.8), 6).alias("max_credible_af"))


def query_segregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families as customers: points of affected and unaffected members (orders), capped at 5, and their tier."""
    o = P.table(spark, sf_dir, "orders")
    by = o.groupBy(F.col("o_custkey").alias("family")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("affected"), F.count_if(F.col("o_orderstatus") == "P").alias("unaffected"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("against"))
    points = F.least(F.lit(5.0), F.greatest(F.col("affected") - 1, F.lit(0)) * 1.0 + F.col("unaffected") * 0.4)
    lod = (F.greatest(F.col("affected") - 1, F.lit(0)) + F.col("unaffected")) * F.log10(F.lit(2.0))
    tier = F.when(F.col("against") > 3, "BS4").when(points >= 4, "PP1_Strong").when(points >= 2, "PP1_Moderate").when(points >= 1, "PP1").otherwise("none")
    return by.select("family", F.round(points, 4).alias("points"), F.round(lod, 6).alias("lod"), tier.alias("tier"))


def xlinked_posterior(sons: Column) -> Column:
    """Carrier probability after so many unaffected sons, from an even prior."""
    return F.pow(F.lit(0.5), sons + 1) / (F.pow(F.lit(0.5), sons + 1) + 0.5)


def query_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.pedigree(spark, sf_dir).where("mother is not null").groupBy("mother").agg(F.count("*").alias("sons"))
    return p.select("mother", "sons", F.round(xlinked_posterior(F.col("sons")), 6).alias("posterior"), F.round(xlinked_posterior(F.col("sons")) / 2, 6).alias("recurrence"))


def query_nof1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired periods per user: purchases less views by hour; mean difference, its t and standard error."""
    e = P.table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("HOUR", "ts"))
    v = F.col("value").cast("decimal(18,4)")
    pairs = e.groupBy("user_id", "hour").agg(F.avg(F.when(F.col("event_type") == "purchase", v)).cast("double").alias("a"), F.avg(F.when(F.col("event_type") == "view", v)).cast("double").alias("b")).where("a is not null and b is not null")
    s = pairs.groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("d"), F.stddev_samp(F.col("a") - F.col("b")).alias("sd")).where("n >= 2 and sd > 0")
    return s.select("user_id", "n", F.round("d", 3).alias("mean"), F.round(F.col("d") / (F.col("sd") / F.sqrt("n")), 3).alias("t"))


_FISHER = """x AS (SELECT *, a + b AS r, a + c AS k, a + b + c + d AS n FROM t),
e AS (SELECT *, unnest(range(greatest(0, k - c - d), least(r, k) + 1)) AS i FROM x),
l AS (SELECT *, lgamma(k + 1e0) - lgamma(i + 1e0) - lgamma(k - i + 1e0) + lgamma(n - k + 1e0) - lgamma(r - i + 1e0) - lgamma(n - k - r + i + 1e0) - lgamma(n + 1e0) + lgamma(r + 1e0) + lgamma(n - r + 1e0) AS lp FROM e),
s AS (SELECT *, max(CASE WHEN i = a THEN lp END) OVER (PARTITION BY key) AS seen FROM l),
g AS (SELECT key, a, b, c, d, sum(CASE WHEN lp <= seen + 1e-7 THEN exp(lp) ELSE 0 END) AS p2, sum(CASE WHEN i >= a THEN exp(lp) ELSE 0 END) AS pg FROM s GROUP BY ALL),
h AS (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5e0 ELSE 0e0 END AS z FROM g),
o AS (SELECT *, ln((a + z) * (d + z) / ((b + z) * (c + z))) AS lo, sqrt(1 / (a + z) + 1 / (b + z) + 1 / (c + z) + 1 / (d + z)) AS se FROM h)
SELECT key AS {key}, a, b, c, d, round(least(p2, 1), 6) AS p_two, round(least(pg, 1), 6) AS p_greater, round(exp(lo), 6) AS odds_ratio, round(exp(lo - 1.96e0 * se), 6) AS or_low, round(exp(lo + 1.96e0 * se), 6) AS or_high FROM o"""
_KM = P.with_("survival") + """,
t AS (SELECT grp, time, sum(event) AS d, count(*) AS n FROM survival GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY time DESC) AS at_risk FROM t),
k AS (SELECT *, sum(CASE WHEN at_risk > d THEN ln(1 - CAST(d AS DOUBLE) / CAST(at_risk AS DOUBLE)) ELSE 0 END) OVER w AS lg, max(CASE WHEN at_risk > d THEN 0 ELSE 1 END) OVER w AS dead,
  sum(CASE WHEN at_risk > d THEN CAST(d AS DOUBLE) / (CAST(at_risk AS DOUBLE) * CAST(at_risk - d AS DOUBLE)) ELSE 0 END) OVER w AS gr FROM r WHERE d > 0 WINDOW w AS (PARTITION BY grp ORDER BY time)),
s AS (SELECT *, CASE WHEN dead = 1 THEN 0 ELSE exp(lg) END AS s FROM k),
km AS (SELECT grp, time, CAST(at_risk AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS events, round(s, 6) AS survival, round(greatest(0, s - 1.96e0 * s * sqrt(gr)), 6) AS low, round(least(1, s + 1.96e0 * s * sqrt(gr)), 6) AS high FROM s)"""
_WZ = "1.959963984540054e0"
SQL = {
    "agg14_fisher": "WITH t AS (SELECT p_brand AS key, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS b, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS c, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'F') AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),\n" + _FISHER.format(key="brand"),
    "agg15_burden": "WITH y AS (SELECT l_orderkey, max(CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END) AS y FROM lineitem GROUP BY 1), t AS (SELECT c_mktsegment AS key, count(*) FILTER (o_orderpriority = '1-URGENT' AND y = 1) AS a, count(*) FILTER (o_orderpriority = '1-URGENT' AND y = 0) AS b, count(*) FILTER (o_orderpriority = '5-LOW' AND y = 1) AS c, count(*) FILTER (o_orderpriority = '5-LOW' AND y = 0) AS d FROM orders JOIN y ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1),\n" + _FISHER.format(key="segment"),
    "agg16_poisson": """WITH b AS (SELECT l_suppkey AS supplier, count(*) FILTER (l_returnflag = 'R' AND CAST(l_quantity AS BIGINT) % 10 = l_suppkey % 10) AS k FROM lineitem GROUP BY 1), m AS (SELECT *, avg(k) OVER () AS mu FROM b),
e AS (SELECT *, unnest(range(k, k + CAST(ceil(abs(mu - k) + 10 * sqrt(mu) + 61) AS BIGINT))) AS i FROM m), s AS (SELECT supplier, k, mu, CASE WHEN k = 0 THEN 1 ELSE least(1, sum(exp(-mu + i * ln(mu) - lgamma(i + 1e0)))) END AS p FROM e GROUP BY 1, 2, 3)
SELECT supplier, k, round(p, 6) AS p_upper, round(log10(p), 6) AS log10_p, round(k / mu, 6) AS enrichment FROM s""",
    "agg17_binomial": f"""WITH b AS (SELECT l_suppkey AS supplier, count(*) FILTER (l_linestatus = 'F') AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), e AS (SELECT *, unnest(range(0, k + 1)) AS i FROM b),
s AS (SELECT supplier, k, n, sum(exp(lgamma(n + 1e0) - lgamma(i + 1e0) - lgamma(n - i + 1e0) - n * ln(2e0))) AS p FROM e GROUP BY 1, 2, 3),
w AS (SELECT *, CAST(k AS DOUBLE) / n AS q, {_WZ} * {_WZ} AS z2 FROM s)
SELECT supplier, k, n, round(p, 6) AS p_lower, round(greatest(0, (q + z2 / (2 * n) - {_WZ} * sqrt(q * (1 - q) / n + z2 / (4e0 * n * n))) / (1 + z2 / n)), 6) AS low, round(least(1, (q + z2 / (2 * n) + {_WZ} * sqrt(q * (1 - q) / n + z2 / (4e0 * n * n))) / (1 + z2 / n)), 6) AS high FROM w""",
    "agg19_kaplan_meier": _KM + "\nSELECT * FROM km",
    "agg19_median_survival": _KM + "\nSELECT grp, min(CASE WHEN survival <= 0.5 THEN time END) AS median, max(time) AS last_event FROM km GROUP BY 1",
    "agg20_logrank": P.with_("survival") + """,
t AS (SELECT time, sum(CASE WHEN grp = '1-URGENT' THEN event ELSE 0 END) AS d1, sum(event) AS d, count(*) FILTER (grp = '1-URGENT') AS n1, count(*) AS n FROM survival GROUP BY 1),
r AS (SELECT CAST(d1 AS DOUBLE) AS d1, CAST(d AS DOUBLE) AS d, CAST(sum(n1) OVER w AS DOUBLE) AS r1, CAST(sum(n) OVER w AS DOUBLE) AS r FROM t WINDOW w AS (ORDER BY time DESC)),
s AS (SELECT sum(d1) AS o, sum(d * r1 / r) AS e, sum(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS v FROM r WHERE d > 0)
SELECT CAST(o AS BIGINT) AS observed, round(e, 4) AS expected, round(v, 4) AS variance, round((o - e) * (o - e) / v, 5) AS chi2 FROM s""",
    "agg21_hardy_weinberg": P.with_("genotype") + """,
g AS (SELECT chrom, CAST(sum(m) AS DOUBLE) / (2 * count(*)) AS q, CAST(count(*) FILTER (m = 1) AS DOUBLE) / count(*) AS h FROM genotype GROUP BY 1)
SELECT chrom, round(q, 6) AS q, round(2 * q * (1 - q), 6) AS expected_het, round(h, 6) AS seen_het, round(q * q, 6) AS prevalence, round(0.1e0 * sqrt(q * q * 0.5e0 / 0.8e0), 6) AS max_credible_af FROM g""",
    "agg22_segregation": """WITH f AS (SELECT o_custkey AS family, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'P') AS u, count(*) FILTER (o_orderpriority = '1-URGENT') AS g FROM orders GROUP BY 1),
p AS (SELECT *, least(5e0, greatest(a - 1, 0) * 1e0 + u * 0.4e0) AS pt, (greatest(a - 1, 0) + u) * log10(2e0) AS lod FROM f)
SELECT family, round(pt, 4) AS points, round(lod, 6) AS lod, CASE WHEN g > 3 THEN 'BS4' WHEN pt >= 4 THEN 'PP1_Strong' WHEN pt >= 2 THEN 'PP1_Moderate' WHEN pt >= 1 THEN 'PP1' ELSE 'none' END AS tier FROM p""",
    "agg23_carriers": P.with_("pedigree") + """, s AS (SELECT mother, count(*) AS sons FROM pedigree WHERE mother IS NOT NULL GROUP BY 1), p AS (SELECT *, pow(0.5e0, sons + 1) / (pow(0.5e0, sons + 1) + 0.5e0) AS p FROM s)
SELECT mother, sons, round(p, 6) AS posterior, round(p / 2, 6) AS recurrence FROM p""",
    "agg24_nof1": """WITH p AS (SELECT user_id, date_trunc('hour', ts) AS h, avg(CASE WHEN event_type = 'purchase' THEN value END) AS a, avg(CASE WHEN event_type = 'view' THEN value END) AS b FROM events GROUP BY 1, 2),
s AS (SELECT user_id, count(*) AS n, avg(a - b) AS d, stddev_samp(a - b) AS sd FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT user_id, n, round(d, 3) AS mean, round(d / (sd / sqrt(n)), 3) AS t FROM s WHERE n >= 2 AND sd > 0""",
}
QUERIES = {
    "agg14_fisher": query_fisher, "agg15_burden": query_burden, "agg16_poisson": query_poisson, "agg17_binomial": query_binomial, "agg19_kaplan_meier": query_kaplan_meier, "agg19_median_survival": query_median_survival,
    "agg20_logrank": query_logrank, "agg21_hardy_weinberg": query_hardy_weinberg, "agg22_segregation": query_segregation, "agg23_carriers": query_carriers, "agg24_nof1": query_nof1,
}
