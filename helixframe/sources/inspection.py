"""Counts of a variant file, the genome build its header points to, and the transcript to annotate on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import trio
from helixframe.plans import projections as P
from helixframe.sources import queries as files
from helixframe.sources import readers

#: lengths of chromosomes 1 to 22, X and Y (fixed values)
LENGTHS = {
    "GRCh38": [
        248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309,
        114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895, 57227415,
    ],
    "GRCh37": [
        249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895,
        115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566, 155270560, 59373566,
    ],
}
#: spellings of a build in `##reference` and `assembly=` (fixed values)
TAGS = {"GRCh38": r"(?i)grch38|hg38|hs38|\bb38\b|GCA_000001405\.(1[5-9]|2\d)", "GRCh37": r"(?i)grch37|hg19|hs37|\bb37\b|g1k_v37|GCA_000001405\.1\b"}
CHROMS = [*map(str, range(1, 23)), "X", "Y"]


def guess_build(contigs: DataFrame, tags: DataFrame) -> DataFrame:
    """(file, guess, conflict) of contigs (file, name, length) and tags (file, tag).

    Known lengths vote, and tags only where no length did; votes for two builds, or a tag that contradicts the
    lengths, are a conflict and leave no guess. Files without any vote have neither.
    """
    spark = contigs.sparkSession
    known = spark.createDataFrame([(c, n, b) for b, ns in LENGTHS.items() for c, n in zip(CHROMS, ns, strict=True)], "chrom string, length long, build string")
    by_length = contigs.withColumn("chrom", readers.chromosome(F.col("name"))).join(F.broadcast(known), ["chrom", "length"]).select("file", "build", F.lit("length").alias("by"))
    build = F.lit(None).cast("string")
    for name, shape in reversed(TAGS.items()):
        build = F.when(F.col("tag").rlike(shape), name).otherwise(build)
    by_tag = tags.select("file", build.alias("build"), F.lit("tag").alias("by")).where("build is not null")
    none = contigs.select("file").union(tags.select("file")).distinct().select("file", F.lit(None).cast("string"), F.lit("none"))
    names = lambda by: F.sort_array(F.collect_set(F.when(F.col("by") == by, F.col("build"))))
    g = by_length.union(by_tag).union(none).groupBy("file").agg(names("length").alias("l"), names("tag").alias("t"))
    voted = F.when(F.size("l") > 0, F.col("l")).otherwise(F.col("t"))
    conflict = (F.size(voted) > 1) | ((F.size("l") > 0) & (F.size(F.array_except("t", "l")) > 0))
    return g.select("file", F.when(~conflict, F.get(voted, F.lit(0))).alias("guess"), conflict.alias("conflict"))


def inspect(records: DataFrame) -> DataFrame:
    """(what, name, n): records by filter, chromosome and naming, records of several alleles, and alleles by kind.

    Every record is read once and gives a few small rows that are counted before the shuffle.
    """
    row = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    declared = readers.info_map(F.col("info"))["SVTYPE"]
    kinds = F.transform("alts", lambda a: row("allele", F.coalesce(trio.sv_type(a, declared), F.when(a == "*", "star"), F.when(trio.allele_kind(a) == "small", "small"), F.lit("other"))))
    naming = F.when(F.lower("chrom_raw").startswith("chr"), "chr").otherwise("plain")
    facts = F.array(row("filter", F.col("filter")), row("chrom", F.col("chrom")), row("naming", naming), row("records", F.when(F.size("alts") > 1, "multiallelic").otherwise("biallelic")))
    return records.select(F.explode(F.concat(facts, kinds)).alias("f")).groupBy("f.what", "f.name").agg(F.count("*").alias("n"))


def genotype_kind(gt: Column) -> Column:
    """missing, ref, haploid, hom or het of an allele array (null for a dot)."""
    called = F.filter(gt, lambda a: a.isNotNull())
    kind = F.when(F.size(gt) == 1, "haploid").when((F.size(F.array_distinct(called)) == 1) & (F.size(called) == F.size(gt)), "hom").otherwise("het")
    return F.when(gt.isNull() | (F.size(called) == 0), "missing").when(~F.exists(called, lambda a: a > 0), "ref").otherwise(kind)


def inspect_samples(records: DataFrame) -> DataFrame:
    """(sample, missing, ref, alt, het, hom, haploid, x_called, x_haploid, x_alt, x_het, sex_hint); counts outside the pseudo-autosomal regions for X.

    At least half haploid genotypes on X hint at a male; else, from 20 calls with another allele on, a share of
    heterozygotes over 0.2 hints at a female and one under 0.05 at a male.
    """
    at = F.array_position("fmt", "GT").cast("int")
    each = records.where(at > 0).select(trio.chromosome_type(F.col("chrom"), F.col("pos")).alias("on"), at.alias("at"), F.posexplode("samples").alias("sample", "call"))
    gt = F.transform(F.split(F.get(F.split("call", ":"), F.col("at") - 1), r"[/|]"), lambda a: F.when(~a.startswith("-") & ~a.startswith("+"), a.try_cast("int")))
    one = each.select("sample", "on", F.explode(F.array(gt)).alias("gt")).select("sample", "on", F.size("gt").alias("ploidy"), genotype_kind(F.col("gt")).alias("kind"))
    x = F.col("on") == "x_nonpar"
    n = lambda c, name: F.count_if(c).alias(name)
    is_alt = F.col("kind").isin("het", "hom", "haploid")
    by = one.groupBy("sample").agg(
        n(F.col("kind") == "missing", "missing"), n(F.col("kind") == "ref", "ref"), n(is_alt, "alt"), n(F.col("kind") == "het", "het"), n(F.col("kind") == "hom", "hom"), n(F.col("kind") == "haploid", "haploid"),
        n(x & (F.col("kind") != "missing"), "x_called"), n(x & (F.col("kind") != "missing") & (F.col("ploidy") == 1), "x_haploid"), n(x & is_alt, "x_alt"), n(x & (F.col("kind") == "het"), "x_het"),
    )
    share = F.try_divide(F.col("x_het"), F.col("x_alt"))
    hint = F.when((F.col("x_haploid") > 0) & (2 * F.col("x_haploid") >= F.col("x_called")), "male-like").when(
        F.col("x_alt") >= 20, F.when(share > 0.2, "female-like").when(share < 0.05, "male-like").otherwise("unclear")
    )
    return by.withColumn("sex_hint", F.coalesce(hint, F.lit("unknown")))


def pick_transcript(rows: DataFrame, key: str, gene: str | None = None) -> DataFrame:
    """One transcript a variant, as struct `pick`, of rows (key, at, gene, overlaps, mane, canonical, coding, severe).

    Rows of the asked gene come before others, then those that overlap the variant, then MANE with the most severe
    consequence, canonical with it, MANE, canonical and coding, canonical, coding; the first listed of equals.
    """
    other = F.coalesce(F.upper("gene") != F.upper(F.col(gene)), F.lit(True)) if gene else F.lit(False)
    mane, canonical, coding, severe = map(F.col, ("mane", "canonical", "coding", "severe"))
    step = F.when(mane & severe, 1).when(canonical & severe, 2).when(mane, 3).when(canonical & coding, 4).when(canonical, 5).when(coding, 6).otherwise(7)
    order = F.struct(other.alias("other"), (~F.col("overlaps")).alias("outside"), step.alias("step"), F.col("at"), F.col("gene"))
    return rows.groupBy(key).agg(F.min(order).alias("pick"))


def query_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as records; every eleventh order has a declared or a named structural allele, or a star."""
    r = readers.parse_vcf(files.vcf_lines(spark, sf_dir)).where("why is null")
    named = F.when(F.col("pos") % 11 == 0, F.transform("alts", lambda a: F.lit("<DUP:TANDEM>"))).when(F.col("pos") % 11 == 1, F.transform("alts", lambda a: F.lit("*"))).otherwise(F.col("alts"))
    stated = F.when(F.col("pos") % 22 == 0, F.concat("info", F.lit(";SVTYPE=cnv"))).otherwise(F.col("info"))
    return inspect(r.withColumns({"alts": named, "info": stated}))


def query_inspect_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples: the one of the lines, and one with a genotype of another ploidy by order."""
    r = readers.parse_vcf(files.vcf_lines(spark, sf_dir)).where("why is null")
    second = F.get(F.array(*map(F.lit, ["1", "0", "1/1:9", "./.", "1|2", "0/.", "."])), (F.col("pos") % 7).cast("int"))
    return inspect_samples(r.withColumns({"samples": F.concat("samples", F.array(second)), "pos": F.col("pos") + 3_000_000})).drop("x_alt", "x_het", "x_haploid")


def query_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files: lengths of either build, of both, or none; some with a tag."""
    s, k = P.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    new, old = F.lit(LENGTHS["GRCh38"][0]), F.lit(LENGTHS["GRCh37"][1])
    lengths = F.array(F.struct(F.lit("chr1").alias("name"), F.when(k % 4 != 1, new).otherwise(5).cast("long").alias("length")), F.struct(F.lit("2").alias("name"), F.when(k % 4 != 0, old).otherwise(7).cast("long").alias("length")))
    contigs = s.where(k % 4 != 3).select(k.alias("file"), F.explode(lengths).alias("c")).select("file", "c.*")
    tags = s.where(k % 3 != 0).select(k.alias("file"), F.when(k % 3 == 1, "file:///refs/hg19.fa").otherwise("GCA_000001405.15").alias("tag"))
    return guess_build(contigs, tags)


def query_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the transcripts of an order; the asked gene is the order's own."""
    li, q = P.table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("long")
    rows = li.select(
        "l_orderkey", F.concat(F.lit("G"), (F.col("l_orderkey") % 5).cast("string")).alias("asked"), F.col("l_linenumber").alias("at"), F.concat(F.lit("g"), (F.col("l_partkey") % 5).cast("string")).alias("gene"),
        (F.col("l_linestatus") == "F").alias("overlaps"), (q % 5 == 0).alias("mane"), (q % 3 == 0).alias("canonical"), (F.col("l_suppkey") % 2 == 0).alias("coding"), (F.col("l_returnflag") == "R").alias("severe"),
    )
    r = pick_transcript(rows, "l_orderkey", "asked").select("pick.*")
    return r.groupBy("other", "outside", F.col("step").cast("long").alias("step"), "gene").agg(F.count("*").alias("n"), F.sum("at").alias("places"))


_R = """v AS (SELECT l_orderkey AS pos, l_partkey, l_linenumber AS ln, l_returnflag AS rf, l_linestatus AS ls,
  CASE l_partkey % 25 WHEN 23 THEN 'X' WHEN 24 THEN 'MT' ELSE CAST(l_partkey % 25 AS VARCHAR) END AS chrom FROM lineitem WHERE l_linenumber <> 7 AND l_suppkey <> 0 AND l_orderkey > 0 AND NOT (l_linenumber = 6 AND l_returnflag = 'A'))"""
SQL = {
    "agg01_inspect": f"""WITH {_R}
SELECT 'filter' AS what, 'PASS' AS name, count(*) AS n FROM v HAVING count(*) > 0 UNION ALL SELECT 'naming', 'chr', count(*) FROM v HAVING count(*) > 0 UNION ALL SELECT 'chrom', chrom, count(*) FROM v GROUP BY 2
UNION ALL SELECT 'records', CASE WHEN rf = 'R' THEN 'multiallelic' ELSE 'biallelic' END, count(*) FROM v GROUP BY 2
UNION ALL SELECT 'allele', CASE WHEN pos % 22 = 0 THEN 'CNV' WHEN pos % 11 = 0 THEN 'DUP' WHEN pos % 11 = 1 THEN 'star' ELSE 'small' END, CAST(sum(CASE WHEN rf = 'R' THEN 2 ELSE 1 END) AS BIGINT) FROM v GROUP BY 2""",
    "agg01_inspect_samples": f"""WITH {_R},
k AS (SELECT 0 AS sample, chrom, CASE WHEN rf = 'A' THEN 'ref' ELSE 'het' END AS kind, false AS one FROM v
UNION ALL SELECT 1, chrom, CASE pos % 7 WHEN 0 THEN 'haploid' WHEN 1 THEN 'ref' WHEN 2 THEN 'hom' WHEN 4 THEN 'het' WHEN 5 THEN 'ref' ELSE 'missing' END, pos % 7 < 2 FROM v),
c AS (SELECT sample, count(*) FILTER (kind = 'missing') AS missing, count(*) FILTER (kind = 'ref') AS ref, count(*) FILTER (kind IN ('het', 'hom', 'haploid')) AS alt, count(*) FILTER (kind = 'het') AS het, count(*) FILTER (kind = 'hom') AS hom, count(*) FILTER (kind = 'haploid') AS haploid,
  count(*) FILTER (chrom = 'X' AND kind <> 'missing') AS x_called, count(*) FILTER (chrom = 'X' AND kind <> 'missing' AND one) AS xo, count(*) FILTER (chrom = 'X' AND kind IN ('het', 'hom', 'haploid')) AS xa, count(*) FILTER (chrom = 'X' AND kind = 'het') AS xh FROM k GROUP BY 1)
SELECT CAST(sample AS INTEGER) AS sample, missing, ref, alt, het, hom, haploid, x_called, CASE WHEN xo > 0 AND 2 * xo >= x_called THEN 'male-like' WHEN xa < 20 THEN 'unknown' WHEN xh > 0.2 * xa THEN 'female-like' WHEN xh < 0.05 * xa THEN 'male-like' ELSE 'unclear' END AS sex_hint FROM c""",
    "prj19_build": """WITH g AS (SELECT s_suppkey AS file, s_suppkey % 4 AS l, s_suppkey % 3 AS t FROM supplier WHERE s_suppkey % 4 <> 3 OR s_suppkey % 3 <> 0),
c AS (SELECT *, l = 2 OR (l = 0 AND t = 1) OR (l = 1 AND t = 2) AS conflict FROM g)
SELECT file, CASE WHEN conflict THEN NULL WHEN l = 0 OR (l = 3 AND t = 2) THEN 'GRCh38' ELSE 'GRCh37' END AS guess, conflict FROM c""",
    "prj20_transcript": """WITH t AS (SELECT l_orderkey AS k, l_orderkey % 5 <> l_partkey % 5 AS other, l_linestatus <> 'F' AS outside, l_linenumber AS place, 'g' || (l_partkey % 5) AS gene, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 2 = 0 AS coding, l_returnflag = 'R' AS severe FROM lineitem),
s AS (SELECT *, CASE WHEN q % 5 = 0 AND severe THEN 1 WHEN q % 3 = 0 AND severe THEN 2 WHEN q % 5 = 0 THEN 3 WHEN q % 3 = 0 AND coding THEN 4 WHEN q % 3 = 0 THEN 5 WHEN coding THEN 6 ELSE 7 END AS step FROM t),
p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY other, outside, step, place, gene) = 1)
SELECT other, outside, CAST(step AS BIGINT) AS step, gene, count(*) AS n, CAST(sum(place) AS BIGINT) AS places FROM p GROUP BY 1, 2, 3, 4""",
}
QUERIES = {"agg01_inspect": query_inspect, "agg01_inspect_samples": query_inspect_samples, "prj19_build": query_build, "prj20_transcript": query_transcript}
