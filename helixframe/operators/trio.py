"""Trio calls: allele kinds, chromosome types, call quality, parents' adequacy, inheritance classes and fit to a mode.

Classes are decided from genotypes. Calls are long rows (family, site, sample role), joined at a site by
grouping on the site, so one shuffle brings child and parents together whatever the number of families.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans import projections as P
from helixframe.sources.scratch import spread

MIN_DP, MIN_GQ = 10, 20
CARRIER = ("het", "hom_alt", "hemi")
#: pseudo-autosomal regions of X in GRCh38 (fixed values)
PAR_X = ((10001, 2781479), (155701383, 156030895))
#: what a gVCF writes for any other allele (fixed values)
PLACEHOLDERS = ("<NON_REF>", "<*>", "<X>")
DOMINANT = ("de_novo", "possible_de_novo", "inherited_het", "het")


def allele_kind(alt: Column) -> Column:
    """small, structural, placeholder (a gVCF's other allele) or none (star, dot, empty)."""
    named = alt.startswith("<") | F.contains(alt, F.lit("[")) | F.contains(alt, F.lit("]"))
    return F.when(F.upper(alt).isin(*PLACEHOLDERS), "placeholder").when(named, "structural").when(alt.isin("*", ".", ""), "none").otherwise("small")


def sv_type(alt: Column, declared: Column) -> Column:
    """The declared type, else BND for a breakend, else the first part of the allele's token; null for what isn't structural."""
    stated = F.upper(F.trim(F.coalesce(declared, F.lit(""))))
    token = F.upper(F.get(F.split(F.regexp_replace(alt, "^[<>]+|[<>]+$", ""), ":"), F.lit(0)))
    kind = F.when(stated != "", stated).when(F.contains(alt, F.lit("[")) | F.contains(alt, F.lit("]")), "BND").when(token != "", token).otherwise("SV")
    return F.when(allele_kind(alt) == "structural", kind)


def chromosome_type(chrom: Column, pos: Column) -> Column:
    """mt, y, x_par, x_nonpar or auto."""
    par = F.lit(False)
    for a, b in PAR_X:
        par |= pos.between(a, b)
    return F.when(chrom == "MT", "mt").when(chrom == "Y", "y").when(chrom == "X", F.when(par, "x_par").otherwise("x_nonpar")).otherwise("auto")


def quality(filters: Column, z: Column, dp: Column, gq: Column) -> Column:
    """Why a call is left out, or `ok`, or `ok_no_depth`: a missing depth or quality passes."""
    passes = filters.isin("PASS", ".")
    return (
        F.when(~passes, "filter").when(~z.isin(*CARRIER), "not_carrier").when(dp < MIN_DP, "depth").when(gq < MIN_GQ, "quality").when(dp.isNull(), "ok_no_depth").otherwise("ok")
    )


def reasons(z: Column, dp: Column, gq: Column, alt_reads: Column) -> Column:
    """Why a parent's call can't show that the allele is absent; empty if nothing is against it."""
    return F.array_compact(
        F.array(
            F.when(z == "missing", "missing").when(z == "other", "other_alt"), F.when(dp.isNull(), "no_depth").when(dp < MIN_DP, "depth"),
            F.when(gq < MIN_GQ, "quality"), F.when((z == "hom_ref") & (alt_reads >= 2), "alt_reads"),
        )
    )


def adequate_ref(z: Column, why: Column) -> Column:
    return (z == "hom_ref") & (F.size(why) == 0)


def inheritance(ctype: Column, sex: Column, z: Column, mz: Column, m_ok: Column, fz: Column, f_ok: Column) -> tuple[Column, Column]:
    """(class, origin) of a child's call. A parent who isn't tested has a null zygosity; `*_ok`: an adequate reference call."""
    no = F.lit(False)
    has_m, has_f = mz.isNotNull(), fz.isNotNull()
    mc, fc = F.coalesce(mz.isin(*CARRIER), no), F.coalesce(fz.isin(*CARRIER), no)
    m_ok, f_ok = F.coalesce(m_ok, no), F.coalesce(f_ok, no)
    male_x = (ctype == "x_nonpar") & (F.coalesce(sex == "male", no) | (sex.isNull() & (z == "hemi")))
    hom = z.isin("hom_alt", "hemi")
    unknown_x = (ctype == "x_nonpar") & sex.isNull()
    cls = (
        F.when(ctype == "mt", "mitochondrial").when(ctype == "y", "y_hemizygous").when(male_x, "x_hemizygous")
        .when(hom, F.when(has_m | has_f, "hom_recessive").otherwise("hom")).when(~has_m & ~has_f, "het")
        .when(has_m & has_f, F.when(mc | fc, "inherited_het").when(m_ok & f_ok, "de_novo").otherwise("possible_de_novo"))
        .when(mc | fc, "inherited_het").otherwise("het")
    )
    origin = (
        F.when(ctype == "mt", F.when(mc, "maternal")).when(ctype == "y", F.when(fc, "paternal"))
        .when(male_x, F.when(mc, "maternal").when(has_m & m_ok, "de_novo")).when(hom, F.when(mc & fc & ~unknown_x, "biparental"))
        .when(mc & fc, "both").when(mc, "maternal").when(fc, "paternal").when(has_m & has_f & m_ok & f_ok, "de_novo")
    )
    return cls, origin


def moi_fit(cls: Column, modes: Column, ctype: Column) -> Column:
    """Whether a class fits a gene's modes of inheritance: fits, against or unknown."""
    any_of = lambda *m: F.arrays_overlap(modes, F.array(*map(F.lit, m)))
    on_x = ctype.startswith("x")
    dominant = any_of("AD", "SD", "XLD") | (on_x & any_of("XL") & ~any_of("XLR"))
    recessive = any_of("AR", "SD") | (on_x & any_of("XL", "XLR", "XLD"))
    yes_no = lambda x: F.when(x, "fits").otherwise("against")
    return (
        F.when(F.coalesce(F.size(modes), F.lit(0)) <= 0, "unknown")
        .when(cls.isin(*DOMINANT), F.when(dominant, "fits").when(any_of("AR", "XLR", "MT", "YL"), "against").otherwise("unknown"))
        .when(cls.isin("hom_recessive", "hom", "comphet", "comphet_unphased"), F.when(recessive, "fits").when(any_of("AD", "MT", "YL"), "against").otherwise("unknown"))
        .when(cls == "x_hemizygous", yes_no(any_of("XL", "XLR", "XLD"))).when(cls == "mitochondrial", yes_no(any_of("MT"))).when(cls == "y_hemizygous", yes_no(any_of("YL"))).otherwise("unknown")
    )


# --- projections -------------------------------------------------------------------------------------------------

SITES_PART = 250_000  #: sites that a task takes
ZYGOSITIES = ("hom_ref", "het", "hom_alt", "missing", "other", "hemi")
MODES = (("AD",), ("AR",), ("XL",), ("XLR",), ("XLD",), ("MT",), ("YL",), ("SD",), (), ("AD", "AR"), ("XL", "XLR"))


def _pick(values: tuple, i: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), i.cast("int") + 1)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fam, chrom, pos, sex): sites of a family, which is a supplier; one a line item number, part and order."""
    li = P.table(spark, sf_dir, "lineitem")
    chrom = F.when(F.col("l_partkey") % 25 == 22, "X").when(F.col("l_partkey") % 25 == 23, "Y").when(F.col("l_partkey") % 25 == 24, "MT").otherwise((F.col("l_partkey") % 25 + 1).cast("string"))
    rows = li.select(F.col("l_suppkey").alias("fam"), chrom.alias("chrom"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10).alias("pos"), F.col("l_partkey").alias("gene"), F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("ln"))
    # Three calls come of each site where it lies, and are put together there, so a task takes a stated number of sites.
    return spread(rows, li.count(), "fam", "chrom", "pos", part=SITES_PART).groupBy("fam", "chrom", "pos").agg(F.min("gene").alias("gene"), F.min("q").alias("q"), F.min("ln").alias("ln"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fam, chrom, pos, gene, role, z, dp, gq, alt_reads): one row a sample; some parents aren't tested, some depths and qualities missing."""
    s = sites(spark, sf_dir)
    x = s.withColumn("r", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where((F.col("r") == 0) | ((F.col("fam") + F.col("r")) % 5 != 0))
    n = F.col("q") * (F.col("r") + 1) + F.col("ln") * 3 + F.col("r")
    z = F.when(F.col("r") == 0, _pick(("het", "hom_alt", "hemi", "het"), n % 4)).otherwise(_pick(("hom_ref", "hom_ref", "hom_ref", "het", "hom_alt", "missing", "other", "hom_ref", "hemi"), n % 9))
    return x.select(
        "fam", "chrom", "pos", "gene", F.when(F.col("r") == 0, "child").when(F.col("r") == 1, "mother").otherwise("father").alias("role"), z.alias("z"),
        F.when(n % 11 != 0, (n * 7) % 40).alias("dp"), F.when(n % 13 != 0, (n * 5) % 90).alias("gq"), F.when(n % 3 != 0, n % 5).alias("alt_reads"),
    )


def trios(c: DataFrame) -> DataFrame:
    """(fam, chrom, pos, gene, child, mother, father): the calls of a site side by side; null where a parent isn't tested."""
    call = F.struct("z", "dp", "gq", "alt_reads")
    of = lambda role: F.max(F.when(F.col("role") == role, call)).alias(role)
    return c.groupBy("fam", "chrom", "pos", "gene").agg(of("child"), of("mother"), of("father")).where("child is not null")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trios(calls(spark, sf_dir))
    why = {r: reasons(*(F.col(f"{r}.{x}") for x in ("z", "dp", "gq", "alt_reads"))) for r in ("mother", "father")}
    ok = {r: adequate_ref(F.col(f"{r}.z"), why[r]) for r in why}
    t = t.select("*", chromosome_type(F.col("chrom"), F.col("pos")).alias("ctype"), _pick(("male", "female", None), F.col("fam") % 3).alias("sex"), ok["mother"].alias("m_ok"), ok["father"].alias("f_ok"))
    cls, origin = inheritance(F.col("ctype"), F.col("sex"), F.col("child.z"), F.col("mother.z"), F.col("m_ok"), F.col("father.z"), F.col("f_ok"))
    return t.select("fam", "chrom", "pos", "gene", "ctype", "sex", cls.alias("cls"), origin.alias("origin"))


def query_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = P.table(spark, sf_dir, "lineitem")
    alt = _pick(("A", "*", ".", "<DEL>", "<DUP:TANDEM>", "<NON_REF>", "<*>", "G]17:198982]", "[13:123457[T", "<CNV>", "", "<x>", "ACGT", "<>"), (F.col("l_partkey") + F.col("l_linenumber")) % 14)
    x = li.select(alt.alias("alt"), F.when(F.col("l_suppkey") % 4 == 0, " inv ").when(F.col("l_suppkey") % 4 == 1, "").alias("declared"))
    return x.groupBy("alt", allele_kind(F.col("alt")).alias("kind"), sv_type(F.col("alt"), F.col("declared")).alias("sv")).agg(F.count("*").alias("n"))


def query_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).groupBy("fam", chromosome_type(F.col("chrom"), F.col("pos")).alias("ctype")).agg(F.count("*").alias("n"))


def query_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    filters = _pick(("PASS", ".", "LowQual"), F.col("pos") % 3)
    return c.groupBy("fam", "role", quality(filters, F.col("z"), F.col("dp"), F.col("gq")).alias("outcome")).agg(F.count("*").alias("n"))


def query_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir).where("role <> 'child'")
    why = reasons(*(F.col(x) for x in ("z", "dp", "gq", "alt_reads")))
    return c.groupBy("role", "z", F.array_join(why, ",").alias("why"), adequate_ref(F.col("z"), why).alias("adequate")).agg(F.count("*").alias("n"), F.countDistinct("fam").alias("families"))


def query_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trios(calls(spark, sf_dir))
    z = lambda r: F.coalesce(f"{r}.z", F.lit("untested")).alias(r)
    return t.groupBy(z("child"), z("mother"), z("father")).agg(F.count("*").alias("n"), F.sum("mother.dp").alias("mother_dp"), F.sum("father.dp").alias("father_dp"))


def query_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).drop("gene")


def query_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = F.element_at(F.array(*(F.array(*map(F.lit, m)).cast("array<string>") for m in MODES)), (F.col("gene") % len(MODES)).cast("int") + 1)
    c = classified(spark, sf_dir).withColumn("modes", modes)
    return c.groupBy("cls", "ctype", F.array_join("modes", ",").alias("modes"), moi_fit(F.col("cls"), F.col("modes"), F.col("ctype")).alias("fit")).agg(F.count("*").alias("n"))


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


_SITE = """site AS (SELECT l_suppkey AS fam, CASE l_partkey % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'MT' ELSE CAST(l_partkey % 25 + 1 AS VARCHAR) END AS chrom,
  l_orderkey * 1000 + l_linenumber * 10 AS pos, min(l_partkey) AS gene, min(CAST(l_quantity AS BIGINT)) AS q, min(CAST(l_linenumber AS BIGINT)) AS ln FROM lineitem GROUP BY 1, 2, 3),
typed AS (SELECT *, CASE chrom WHEN 'MT' THEN 'mt' WHEN 'Y' THEN 'y' WHEN 'X' THEN CASE WHEN pos BETWEEN 10001 AND 2781479 OR pos BETWEEN 155701383 AND 156030895 THEN 'x_par' ELSE 'x_nonpar' END ELSE 'auto' END AS ctype FROM site)"""
_CALL = _SITE + """,
num AS (SELECT typed.*, r, q * (r + 1) + ln * 3 + r AS n FROM typed, (VALUES (0), (1), (2)) v(r) WHERE r = 0 OR (fam + r) % 5 <> 0),
call AS (SELECT fam, chrom, pos, gene, ctype, ['child', 'mother', 'father'][r + 1] AS role,
  CASE WHEN r = 0 THEN ['het', 'hom_alt', 'hemi', 'het'][n % 4 + 1] ELSE ['hom_ref', 'hom_ref', 'hom_ref', 'het', 'hom_alt', 'missing', 'other', 'hom_ref', 'hemi'][n % 9 + 1] END AS z,
  CASE WHEN n % 11 <> 0 THEN (n * 7) % 40 END AS dp, CASE WHEN n % 13 <> 0 THEN (n * 5) % 90 END AS gq, CASE WHEN n % 3 <> 0 THEN n % 5 END AS reads FROM num),
judged AS (SELECT *, concat_ws(',', CASE z WHEN 'missing' THEN 'missing' WHEN 'other' THEN 'other_alt' END, CASE WHEN dp IS NULL THEN 'no_depth' WHEN dp < 10 THEN 'depth' END, CASE WHEN gq < 20 THEN 'quality' END, CASE WHEN z = 'hom_ref' AND reads >= 2 THEN 'alt_reads' END) AS why FROM call)"""
_CLASS = _CALL + """,
trio AS (SELECT c.fam, c.chrom, c.pos, c.gene, c.ctype, CASE c.fam % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex, c.z, m.z AS mz, f.z AS fz, coalesce(m.z IN ('het', 'hom_alt', 'hemi'), false) AS mc, coalesce(f.z IN ('het', 'hom_alt', 'hemi'), false) AS fc,
  coalesce(m.z = 'hom_ref' AND m.why = '', false) AS m_ok, coalesce(f.z = 'hom_ref' AND f.why = '', false) AS f_ok
  FROM judged c LEFT JOIN judged m ON m.role = 'mother' AND m.fam = c.fam AND m.chrom = c.chrom AND m.pos = c.pos LEFT JOIN judged f ON f.role = 'father' AND f.fam = c.fam AND f.chrom = c.chrom AND f.pos = c.pos WHERE c.role = 'child'),
x AS (SELECT *, ctype = 'x_nonpar' AND (coalesce(sex = 'male', false) OR (sex IS NULL AND z = 'hemi')) AS male_x FROM trio),
class AS (SELECT *, CASE WHEN ctype = 'mt' THEN 'mitochondrial' WHEN ctype = 'y' THEN 'y_hemizygous' WHEN male_x THEN 'x_hemizygous' WHEN z IN ('hom_alt', 'hemi') THEN CASE WHEN mz IS NULL AND fz IS NULL THEN 'hom' ELSE 'hom_recessive' END
  WHEN mc OR fc THEN 'inherited_het' WHEN mz IS NULL OR fz IS NULL THEN 'het' WHEN m_ok AND f_ok THEN 'de_novo' ELSE 'possible_de_novo' END AS cls,
  CASE WHEN ctype = 'mt' THEN CASE WHEN mc THEN 'maternal' END WHEN ctype = 'y' THEN CASE WHEN fc THEN 'paternal' END WHEN male_x THEN CASE WHEN mc THEN 'maternal' WHEN m_ok THEN 'de_novo' END
  WHEN z IN ('hom_alt', 'hemi') THEN CASE WHEN mc AND fc AND NOT (ctype = 'x_nonpar' AND sex IS NULL) THEN 'biparental' END WHEN mc AND fc THEN 'both' WHEN mc THEN 'maternal' WHEN fc THEN 'paternal' WHEN m_ok AND f_ok THEN 'de_novo' END AS origin FROM x)"""
SQL = {
    "prj05_allele_kinds": """WITH a AS (SELECT ['A', '*', '.', '<DEL>', '<DUP:TANDEM>', '<NON_REF>', '<*>', 'G]17:198982]', '[13:123457[T', '<CNV>', '', '<x>', 'ACGT', '<>'][(l_partkey + l_linenumber) % 14 + 1] AS alt, CASE l_suppkey % 4 WHEN 0 THEN 'INV' END AS d FROM lineitem),
k AS (SELECT alt, d, CASE WHEN alt IN ('<NON_REF>', '<*>', '<x>') THEN 'placeholder' WHEN alt[1:1] = '<' OR alt LIKE '%[%' OR alt LIKE '%]%' THEN 'structural' WHEN alt IN ('*', '.', '') THEN 'none' ELSE 'small' END AS kind FROM a)
SELECT alt, kind, CASE WHEN kind = 'structural' THEN coalesce(d, CASE alt WHEN '<DEL>' THEN 'DEL' WHEN '<DUP:TANDEM>' THEN 'DUP' WHEN '<CNV>' THEN 'CNV' WHEN '<>' THEN 'SV' ELSE 'BND' END) END AS sv, count(*) AS n FROM k GROUP BY 1, 2, 3""",
    "prj08_chromosome_types": f"WITH {_SITE} SELECT fam, ctype, count(*) AS n FROM typed GROUP BY 1, 2",
    "prj09_quality": f"""WITH {_CALL} SELECT fam, role, CASE WHEN pos % 3 = 2 THEN 'filter' WHEN z NOT IN ('het', 'hom_alt', 'hemi') THEN 'not_carrier' WHEN dp < 10 THEN 'depth' WHEN gq < 20 THEN 'quality' WHEN dp IS NULL THEN 'ok_no_depth' ELSE 'ok' END AS outcome, count(*) AS n FROM call GROUP BY 1, 2, 3""",
    "prj11_parent_adequacy": f"WITH {_CALL} SELECT role, z, why, z = 'hom_ref' AND why = '' AS adequate, count(*) AS n, count(DISTINCT fam) AS families FROM judged WHERE role <> 'child' GROUP BY 1, 2, 3, 4",
    "jn05_trio_join": f"""WITH {_CALL} SELECT c.z AS child, coalesce(m.z, 'untested') AS mother, coalesce(f.z, 'untested') AS father, count(*) AS n, CAST(sum(m.dp) AS BIGINT) AS mother_dp, CAST(sum(f.dp) AS BIGINT) AS father_dp
FROM call c LEFT JOIN call m ON m.role = 'mother' AND m.fam = c.fam AND m.chrom = c.chrom AND m.pos = c.pos LEFT JOIN call f ON f.role = 'father' AND f.fam = c.fam AND f.chrom = c.chrom AND f.pos = c.pos WHERE c.role = 'child' GROUP BY 1, 2, 3""",
    "prj12_inheritance_class": f"WITH {_CLASS} SELECT fam, chrom, pos, ctype, sex, cls, origin FROM class",
    "prj15_moi_fit": f"""WITH {_CLASS}, g AS (SELECT cls, ctype, [{', '.join(_list(m) for m in MODES)}][gene % {len(MODES)} + 1] AS m FROM class),
b AS (SELECT *, list_has_any(m, ['AD', 'SD', 'XLD']) OR (ctype[1:1] = 'x' AND list_contains(m, 'XL') AND NOT list_contains(m, 'XLR')) AS dom, list_has_any(m, ['AR', 'SD']) OR (ctype[1:1] = 'x' AND list_has_any(m, ['XL', 'XLR', 'XLD'])) AS rec FROM g)
SELECT cls, ctype, array_to_string(m, ',') AS modes, CASE WHEN len(m) = 0 THEN 'unknown' WHEN cls IN ('de_novo', 'possible_de_novo', 'inherited_het', 'het') THEN CASE WHEN dom THEN 'fits' WHEN list_has_any(m, ['AR', 'XLR', 'MT', 'YL']) THEN 'against' ELSE 'unknown' END
  WHEN cls IN ('hom_recessive', 'hom') THEN CASE WHEN rec THEN 'fits' WHEN list_has_any(m, ['AD', 'MT', 'YL']) THEN 'against' ELSE 'unknown' END WHEN cls = 'x_hemizygous' THEN CASE WHEN list_has_any(m, ['XL', 'XLR', 'XLD']) THEN 'fits' ELSE 'against' END
  WHEN cls = 'mitochondrial' THEN CASE WHEN list_contains(m, 'MT') THEN 'fits' ELSE 'against' END ELSE CASE WHEN list_contains(m, 'YL') THEN 'fits' ELSE 'against' END END AS fit, count(*) AS n FROM b GROUP BY 1, 2, 3, 4""",
}
QUERIES = {
    "prj05_allele_kinds": query_kinds, "prj08_chromosome_types": query_types, "prj09_quality": query_quality, "prj11_parent_adequacy": query_adequacy,
    "jn05_trio_join": query_join, "prj12_inheritance_class": query_class, "prj15_moi_fit": query_fit,
}
