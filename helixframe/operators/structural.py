"""Copy-number reports: losses and gains by sex and chromosome, gene-count bands, repeat-array sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import intervals
from helixframe.plans import projections as P

#: kb of a fragment outside the repeat array, by digest (fixed values)
FLANK = {"ecori": 6.8, "ecori_blni": 3.8, "ecori_hindiii": 4.7}
UNIT, ERROR = 3.3, 1.0  #: kb a repeat unit, kb of sizing error (fixed values)
#: least gene count of the bands, by kind (fixed values)
BANDS = {"loss": (25, 35), "gain": (35, 50)}
WIDE = 65536  #: bin of the overlap join, as events are wide


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def array_band(units: Column) -> Column:
    return F.when(units <= 0, "below one unit").when(units <= 3, "1-3").when(units <= 6, "4-6").when(units <= 10, "7-10").otherwise("11+")


def query_array_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat units of a fragment, their range under the sizing error, and whether the band is settled."""
    names = list(FLANK)
    d = (F.col("p_partkey") % 3 + 1).cast("int")
    p = P.table(spark, sf_dir, "part").select("p_partkey", (F.lit(5.0) + (F.col("p_partkey") * 7 % 3900) / F.lit(10.0)).alias("kb"), F.element_at(F.array(*map(F.lit, names)), d).alias("digest"), F.element_at(F.array(*(F.lit(FLANK[n]) for n in names)), d).alias("flank"))
    units = lambda kb: half_up((kb - F.col("flank")) / F.lit(UNIT))
    zero = F.lit(0).cast("long")
    r = p.select("p_partkey", "digest", F.greatest(zero, units(F.col("kb"))).alias("units"), F.greatest(zero, units(F.col("kb") - ERROR)).alias("low"), units(F.col("kb") + ERROR).alias("high"))
    return r.select("*", array_band(F.col("units")).alias("band"), (array_band(F.col("low")) == array_band(F.col("high"))).alias("settled"))


def copies_type(chrom: Column, low: Column, high: Column, sex: Column, par: Column) -> Column:
    """Loss or gain against the copies that are normal here; `low` < `high` is a mosaic range. Else unknown."""
    sexed = chrom.isin("X", "Y") & ~par
    male = sex == "male"
    normal = F.when(~sexed, 2).when(sex.isNull(), None).when(chrom == "X", F.when(male, 1).otherwise(2)).otherwise(F.when(male, 1).otherwise(0))
    one = low == high
    unsexed = F.when(one & (low == 0), "loss").when(one & (low >= 3), "gain").otherwise("unknown")
    female_y = one & sexed & (chrom == "Y") & (sex == "female")
    known = F.when((high <= normal) & (low < normal), "loss").when((low >= normal) & (high > normal), "gain").otherwise("unknown")
    return F.when((chrom == "MT") | F.coalesce(female_y, F.lit(False)), "unknown").when(normal.isNull(), unsexed).otherwise(known)


def query_copy_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = P.table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey") % 25
    r = li.select(
        F.when(k == 22, "X").when(k == 23, "Y").when(k == 24, "MT").otherwise("autosome").alias("chrom"), F.when(F.col("l_suppkey") % 3 == 0, "male").when(F.col("l_suppkey") % 3 == 1, "female").alias("sex"),
        (F.col("l_linenumber") == 1).alias("par"), (F.col("l_quantity").cast("int") % 5).alias("low"), (F.col("l_quantity").cast("int") % 5 + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("high"),
    )
    kind = copies_type(*map(F.col, ("chrom", "low", "high", "sex", "par")))
    return r.groupBy("chrom", "sex", "par", "low", "high", kind.alias("kind")).agg(F.count("*").alias("n"))


def gene_band(kind: str, n: Column) -> Column:
    b, c = BANDS[kind]
    return F.when(n >= c, "3C").when(n >= b, "3B").otherwise("3A")


def query_gene_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes that an event touches, and the band of that count for a loss and for a gain."""
    o = P.table(spark, sf_dir, "orders")
    start = F.col("o_custkey") * 150
    events = o.select(F.col("o_orderkey").alias("event"), (F.col("o_custkey") % 22).alias("chrom"), start.alias("s"), (start + (F.col("o_orderkey") % 60) * 3000).alias("e"))
    genes = intervals.regions(spark, sf_dir)
    hits = intervals.overlap_join(events, genes, "chrom", ("s", "e"), ("rs", "re"), WIDE).groupBy("event").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return events.join(hits, "event", "left").select("event", n.alias("genes"), gene_band("loss", n).alias("as_loss"), gene_band("gain", n).alias("as_gain"))


def _band_sql(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 'below one unit' WHEN {x} <= 3 THEN '1-3' WHEN {x} <= 6 THEN '4-6' WHEN {x} <= 10 THEN '7-10' ELSE '11+' END"


SQL = {
    "prj22_array_units": f"""WITH p AS (SELECT p_partkey, 5e0 + (p_partkey * 7 % 3900) / 10e0 AS kb, {list(FLANK)}[p_partkey % 3 + 1] AS digest, CAST({list(FLANK.values())} AS DOUBLE[])[p_partkey % 3 + 1] AS flank FROM part),
u AS (SELECT p_partkey, digest, greatest(0, CAST(floor((kb - flank) / 3.3e0 + 0.5e0) AS BIGINT)) AS units, greatest(0, CAST(floor((kb - 1e0 - flank) / 3.3e0 + 0.5e0) AS BIGINT)) AS low, CAST(floor((kb + 1e0 - flank) / 3.3e0 + 0.5e0) AS BIGINT) AS high FROM p)
SELECT *, {_band_sql('units')} AS band, {_band_sql('low')} = {_band_sql('high')} AS settled FROM u""",
    "prj24_copy_number": """WITH r AS (SELECT CASE l_partkey % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'MT' ELSE 'autosome' END AS chrom, CASE l_suppkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex, l_linenumber = 1 AS par,
  CAST(l_quantity AS INTEGER) % 5 AS low, CAST(l_quantity AS INTEGER) % 5 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS high FROM lineitem),
n AS (SELECT *, CASE WHEN par OR chrom NOT IN ('X', 'Y') THEN 2 WHEN sex IS NULL THEN NULL WHEN sex = 'male' THEN 1 WHEN chrom = 'X' THEN 2 ELSE 0 END AS normal FROM r)
SELECT chrom, sex, par, low, high, CASE WHEN chrom = 'MT' THEN 'unknown' WHEN normal IS NULL THEN CASE WHEN low = high AND low = 0 THEN 'loss' WHEN low = high AND low >= 3 THEN 'gain' ELSE 'unknown' END
  WHEN normal = 0 AND low = high THEN 'unknown' WHEN low < normal AND high <= normal THEN 'loss' WHEN high > normal AND low >= normal THEN 'gain' ELSE 'unknown' END AS kind, count(*) AS n FROM n GROUP BY ALL""",
    "agg32_gene_band": """WITH e AS (SELECT o_orderkey AS event, o_custkey % 22 AS chrom, o_custkey * 150 AS s, o_custkey * 150 + (o_orderkey % 60) * 3000 AS e FROM orders),
n AS (SELECT event, count(c_custkey) AS genes FROM e LEFT JOIN customer ON c_custkey % 22 = chrom AND s <= c_custkey * 150 + 900 + c_nationkey * 10 AND c_custkey * 150 <= e GROUP BY 1)
SELECT event, genes, CASE WHEN genes >= 35 THEN '3C' WHEN genes >= 25 THEN '3B' ELSE '3A' END AS as_loss, CASE WHEN genes >= 50 THEN '3C' WHEN genes >= 35 THEN '3B' ELSE '3A' END AS as_gain FROM n""",
}
QUERIES = {"prj22_array_units": query_array_units, "prj24_copy_number": query_copy_number, "agg32_gene_band": query_gene_band}
