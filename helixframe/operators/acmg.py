"""Evidence codes: points, classes by points and by the 2015 rules, the PM1+PP3 cap, and codes suggested from numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans import projections as P

#: code, strength, direction (fixed values)
CODES = (
    ("PVS1", "VeryStrong", "P"), ("PS1", "Strong", "P"), ("PS3", "Strong", "P"), ("PM1", "Moderate", "P"), ("PM2", "Supporting", "P"), ("PM5", "Moderate", "P"), ("PP1", "Supporting", "P"), ("PP3", "Supporting", "P"),
    ("BS1", "Strong", "B"), ("BS4", "Strong", "B"), ("BP4", "Supporting", "B"), ("BP7", "Supporting", "B"),
)
POINTS = {"VeryStrong": 8, "Strong": 4, "Moderate": 2, "Supporting": 1}
LEAST_CALLS = 2000  #: alleles called, from which absence counts


def code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, s, d, POINTS[s] * (1 if d == "P" else -1)) for i, (c, s, d) in enumerate(CODES)], "i int, code string, strength string, direction string, points int")


def points_class(points: Column) -> Column:
    return F.when(points >= 10, "P").when(points >= 6, "LP").when(points >= 0, "VUS").when(points >= -6, "LB").otherwise("B")


def richards_class(n: dict[str, Column]) -> Column:
    """The 2015 combining rules, from numbers of codes of each tier."""
    pvs, ps, pm, pp, bs, bp = (n[x] for x in ("pvs", "ps", "pm", "pp", "bs", "bp"))
    p = ((pvs >= 1) & ((ps >= 1) | (pm >= 2) | ((pm == 1) & (pp == 1)) | (pp >= 2))) | (pvs >= 2) | (ps >= 2) | ((ps == 1) & ((pm >= 3) | ((pm == 2) & (pp >= 2)) | ((pm == 1) & (pp >= 4))))
    lp = ((pvs >= 1) & (pm == 1)) | ((ps == 1) & pm.between(1, 2)) | ((ps == 1) & (pp >= 2)) | (pm >= 3) | ((pm == 2) & (pp >= 2)) | ((pm == 1) & (pp >= 4))
    b, lb = bs >= 2, ((bs == 1) & (bp >= 1)) | (bp >= 2)
    path, benign = p | lp, b | lb
    return F.when(path & benign, "VUS (conflicting)").when(p, "P").when(lp, "LP").when(b, "B").when(lb, "LB").otherwise("VUS")


COMPUTATIONAL = ("PP3", "BP4", "BP7")
PAIR_CAP = POINTS["Strong"]  #: most points that PM1 and PP3 may have together


def weakened(pm1: int, pp3: int, cap: int = PAIR_CAP) -> tuple[int, int]:
    """Points of PM1 and PP3 under the cap: each at its own or a weaker strength or dropped, with the largest sum, PM1 as strong as may be."""
    tiers = (0, *POINTS.values())
    pairs = [(m + p, m, p) for m in tiers if m <= pm1 for p in tiers if p <= pp3 if m + p <= cap]
    _, m, p = max(pairs)
    return m, p


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, code, points): the codes of each order, one a line; of a code that is given twice the first line counts."""
    li = P.table(spark, sf_dir, "lineitem")
    i, q = (F.col("l_suppkey") + F.col("l_linenumber") * 5) % len(CODES), F.col("l_quantity").cast("int")
    given = li.select(F.col("l_orderkey").alias("variant"), i.cast("int").alias("i"), F.struct("l_linenumber", q.alias("q")).alias("at")).groupBy("variant", "i").agg(F.min("at").alias("at"))
    # PM1 and PP3 may be given at other strengths than their own.
    stated = F.when(F.col("code").isin("PM1", "PP3"), F.element_at(F.array(*(F.lit(POINTS[x]) for x in ("Supporting", "Moderate", "Strong"))), F.col("at.q") % 3 + 1)).otherwise(F.col("points"))
    return given.join(F.broadcast(code_table(spark)), "i").select("variant", "code", stated.alias("points"))


def query_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and both classes of each variant, with PM1 and PP3 capped together and computational evidence alone never benign."""
    e = evidence(spark, sf_dir)
    own = lambda c: F.coalesce(F.max(F.when(F.col("code") == c, F.col("points"))), F.lit(0))
    rest = ~F.col("code").isin("PM1", "PP3")
    tiers = {"pvs": 8, "ps": 4, "pm": 2, "pp": 1, "bs": -4, "bp": -1}
    by = e.groupBy("variant").agg(
        F.coalesce(F.sum(F.when(rest, F.col("points"))), F.lit(0)).alias("others"), own("PM1").alias("m"), own("PP3").alias("p"),
        *(F.count_if(rest & (F.col("points") == x)).alias(n) for n, x in tiers.items()),
        F.min(F.col("code").isin(*COMPUTATIONAL).cast("int")).alias("computational"), F.concat_ws(",", F.array_sort(F.collect_set("code"))).alias("codes"),
    )
    levels = (0, *POINTS.values())
    table = {(m, p): weakened(m, p) for m in levels for p in levels}
    capped = F.create_map(*(x for (m, p), (a, b) in table.items() for x in (F.lit(m * 16 + p), F.struct(F.lit(a).alias("m"), F.lit(b).alias("p")))))
    by = by.withColumn("c", capped[F.col("m") * 16 + F.col("p")])
    n = {x: F.col(x) + sum((F.col(f"c.{k}") == v).cast("int") for k in ("m", "p")) for x, v in tiers.items()}
    points = F.col("others") + F.col("c.m") + F.col("c.p")
    alone = lambda c: F.when((F.col("computational") == 1) & c.isin("B", "LB"), "VUS").otherwise(c)
    was_capped = F.col("m") + F.col("p") > PAIR_CAP
    return by.select("variant", "codes", points.alias("points"), alone(points_class(points)).alias("by_points"), alone(richards_class(n)).alias("by_rules"), was_capped.alias("capped"))


def query_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that the numbers of a variant support, and what could not be assessed."""
    p = P.table(spark, sf_dir, "part")
    li = P.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("ac"), (F.count("*") * 100).alias("an"))
    v = p.join(li, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("variant"), "ac", "an", F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 50.0).alias("revel"),
        F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") % 100) / 200.0).alias("splice"), F.when(F.col("p_partkey") % 4 != 0, F.col("ac") / F.col("an")).alias("faf"),
    )
    af = F.col("ac") / F.col("an")
    ba1 = F.when(F.col("faf").isNotNull(), F.col("faf") > 0.05).otherwise((af > 0.05) & (F.col("an") >= LEAST_CALLS))
    bs1 = F.col("faf") > 0.004
    pp3 = F.when(F.col("revel") >= 0.932, "PP3_Strong").when(F.col("revel") >= 0.773, "PP3_Moderate").when(F.col("revel") >= 0.644, "PP3").when(F.col("splice") >= 0.2, "PP3")
    bp4 = F.when((F.col("revel") <= 0.290) & ((F.col("splice") <= 0.1) | F.col("splice").isNull()), F.when(F.col("revel") <= 0.016, "BP4_Strong").when(F.col("revel") <= 0.183, "BP4_Moderate").otherwise("BP4"))
    pm2 = F.when(~F.coalesce(bs1, F.lit(False)) & (F.col("an") >= LEAST_CALLS) & (af < 0.0034), "PM2_Supporting")
    codes = F.when(F.coalesce(ba1, F.lit(False)), F.array(F.lit("BA1"))).otherwise(F.array_compact(F.array(F.when(bs1, F.lit("BS1")), pm2, pp3, bp4)))
    missing = F.array_compact(F.array(F.when(F.col("revel").isNull(), F.lit("REVEL")), F.when(F.col("splice").isNull(), F.lit("SpliceAI")), F.when(F.col("faf").isNull(), F.lit("faf95"))))
    return v.select("variant", F.concat_ws(",", codes).alias("codes"), F.concat_ws(",", missing).alias("not_assessed"))


_VALUES = ", ".join(f"({i}, '{c}', '{s}', '{d}', {POINTS[s] * (1 if d == 'P' else -1)})" for i, (c, s, d) in enumerate(CODES))
SQL = {
    "agg25_classify": f"""WITH c(i, code, strength, direction, points) AS (VALUES {_VALUES}),
g AS (SELECT l_orderkey AS variant, (l_suppkey + l_linenumber * 5) % {len(CODES)} AS i, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_orderkey, (l_suppkey + l_linenumber * 5) % {len(CODES)} ORDER BY l_linenumber, l_quantity) AS rn FROM lineitem),
e AS (SELECT variant, code, CASE WHEN code IN ('PM1', 'PP3') THEN [1, 2, 4][q % 3 + 1] ELSE points END AS x FROM g JOIN c USING (i) WHERE rn = 1),
w AS (SELECT variant, code, x, coalesce(max(CASE WHEN code = 'PM1' THEN x END) OVER (PARTITION BY variant), 0) AS m, coalesce(max(CASE WHEN code = 'PP3' THEN x END) OVER (PARTITION BY variant), 0) AS p FROM e),
k AS (SELECT variant, code, m + p > 4 AS capped, CASE WHEN m + p <= 4 THEN x WHEN code = 'PM1' THEN CASE m WHEN 4 THEN 4 WHEN 2 THEN 2 ELSE 0 END WHEN code = 'PP3' THEN CASE m WHEN 4 THEN 0 WHEN 2 THEN 2 ELSE 4 END ELSE x END AS x FROM w),
n AS (SELECT variant, CAST(sum(x) AS BIGINT) AS raw, array_to_string(list_sort(list(code)), ',') AS codes, bool_and(code IN ('PP3', 'BP4', 'BP7')) AS comp, bool_or(capped) AS capped,
  count(*) FILTER (x = 8) AS pvs, count(*) FILTER (x = 4) AS ps, count(*) FILTER (x = 2) AS pm, count(*) FILTER (x = 1) AS pp, count(*) FILTER (x = -4) AS bs, count(*) FILTER (x = -1) AS bp FROM k GROUP BY 1),
q AS (SELECT *, (pvs >= 1 AND (ps >= 1 OR pm >= 2 OR (pm = 1 AND pp = 1) OR pp >= 2)) OR pvs >= 2 OR ps >= 2 OR (ps = 1 AND (pm >= 3 OR (pm = 2 AND pp >= 2) OR (pm = 1 AND pp >= 4))) AS p,
  (pvs >= 1 AND pm = 1) OR (ps = 1 AND pm BETWEEN 1 AND 2) OR (ps = 1 AND pp >= 2) OR pm >= 3 OR (pm = 2 AND pp >= 2) OR (pm = 1 AND pp >= 4) AS lp, bs >= 2 AS b, (bs = 1 AND bp >= 1) OR bp >= 2 AS lb FROM n),
r AS (SELECT *, CASE WHEN raw >= 10 THEN 'P' WHEN raw >= 6 THEN 'LP' WHEN raw >= 0 THEN 'VUS' WHEN raw >= -6 THEN 'LB' ELSE 'B' END AS x, CASE WHEN (p OR lp) AND (b OR lb) THEN 'VUS (conflicting)' WHEN p THEN 'P' WHEN lp THEN 'LP' WHEN b THEN 'B' WHEN lb THEN 'LB' ELSE 'VUS' END AS y FROM q)
SELECT variant, codes, raw AS points, CASE WHEN comp AND x IN ('B', 'LB') THEN 'VUS' ELSE x END AS by_points, CASE WHEN comp AND y IN ('B', 'LB') THEN 'VUS' ELSE y END AS by_rules, capped FROM r""",
    "agg26_suggest": f"""WITH l AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') AS ac, count(*) * 100 AS an FROM lineitem GROUP BY 1),
v AS (SELECT p_partkey AS variant, ac, an, CAST(ac AS DOUBLE) / an AS af, CASE WHEN p_size % 7 <> 0 THEN p_size / 50e0 END AS revel, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 100) / 200e0 END AS splice, CASE WHEN p_partkey % 4 <> 0 THEN CAST(ac AS DOUBLE) / an END AS faf FROM part LEFT JOIN l ON l_partkey = p_partkey)
SELECT variant, CASE WHEN coalesce(CASE WHEN faf IS NOT NULL THEN faf > 0.05e0 ELSE af > 0.05e0 AND an >= {LEAST_CALLS} END, false) THEN 'BA1' ELSE concat_ws(',', CASE WHEN faf > 0.004e0 THEN 'BS1' END,
  CASE WHEN NOT coalesce(faf > 0.004e0, false) AND an >= {LEAST_CALLS} AND af < 0.0034e0 THEN 'PM2_Supporting' END,
  CASE WHEN revel >= 0.932e0 THEN 'PP3_Strong' WHEN revel >= 0.773e0 THEN 'PP3_Moderate' WHEN revel >= 0.644e0 OR splice >= 0.2e0 THEN 'PP3' END,
  CASE WHEN revel <= 0.290e0 AND (splice <= 0.1e0 OR splice IS NULL) THEN CASE WHEN revel <= 0.016e0 THEN 'BP4_Strong' WHEN revel <= 0.183e0 THEN 'BP4_Moderate' ELSE 'BP4' END END) END AS codes,
  concat_ws(',', CASE WHEN revel IS NULL THEN 'REVEL' END, CASE WHEN splice IS NULL THEN 'SpliceAI' END, CASE WHEN faf IS NULL THEN 'faf95' END) AS not_assessed FROM v""",
}
QUERIES = {"agg25_classify": query_classify, "agg26_suggest": query_suggest}
