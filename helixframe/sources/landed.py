"""Parsers of landed source files and responses: one text a row in, typed rows out. Nothing is fetched here.

Fields that are missing, or of another type than stated, are null; a text that isn't JSON gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans import projections as P

#: inheritance modes by term (fixed values)
MODES = {
    "HP:0000006": "AD", "HP:0012275": "AD", "HP:0012274": "AD", "HP:0000007": "AR", "HP:0032113": "SD",
    "HP:0001417": "XL", "HP:0001419": "XLR", "HP:0001423": "XLD", "HP:0001427": "MT", "HP:0001450": "YL",
}
#: stars of a review status (fixed values)
STARS = {
    "practice guideline": 4, "reviewed by expert panel": 3, "criteria provided, multiple submitters, no conflicts": 2, "criteria provided, multiple submitters": 2,
    "criteria provided, conflicting classifications": 1, "criteria provided, conflicting interpretations": 1, "criteria provided, single submitter": 1,
    "no assertion criteria provided": 0, "no assertion provided": 0, "no classification provided": 0,
    "no classifications from unflagged records": 0, "no classification for the individual variant": 0,
}
#: ancestry groups that don't count for the highest group frequency, and names that are no groups (fixed values)
BOTTLENECKED = ("ami", "asj", "fin", "oth", "remaining", "rmi")
NO_GROUPS = ("xx", "xy")
STALE_DAYS = 730
PLACEHOLDER = "MONDO:0000001"  #: stands for "no diagnosis yet"


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def finite(c: Column) -> Column:
    """Null for NaN and infinities, which JSON can't carry."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def columns_of(lines: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    """Tab-separated lines as trimmed string columns, empty ones null; comments and empty lines are left out."""
    kept = lines.where(~F.col(value).startswith("#") & (F.trim(value) != "")).select(F.explode(F.array(F.split(value, "\t"))).alias("c"))
    return kept.select(*(F.nullif(F.trim(F.get("c", i)), F.lit("")).alias(n) for i, n in enumerate(names)))


def one_or_many(raw: Column, schema: str) -> Column:
    """An array, whether the source wrote one object or a list of them; empty if neither."""
    raw = F.ltrim(raw)
    many = F.from_json(raw, f"array<struct<{schema}>>")
    return F.coalesce(F.when(raw.startswith("["), many).when(raw.startswith("{"), F.array(F.from_json(raw, f"struct<{schema}>"))), F.array().cast(f"array<struct<{schema}>>"))


def gene_modes(rows: DataFrame) -> DataFrame:
    """(gene, modes): inheritance modes of rows (gene_symbol, hpo_id), sorted; genes without any are left out."""
    mode = lookup(MODES, F.col("hpo_id"))
    return rows.select(F.col("gene_symbol").alias("gene"), mode.alias("mode")).where("mode is not null and gene <> ''").distinct().groupBy("gene").agg(F.sort_array(F.collect_list("mode")).alias("modes"))


def translations(rows: DataFrame) -> DataFrame:
    """(term, label): translated names of rows (subject_id, predicate_id, translation_value); empty ones are left out."""
    label = F.trim("translation_value")
    return rows.where((F.col("predicate_id") == "rdfs:label") & (label != "")).groupBy(F.col("subject_id").alias("term")).agg(F.min(label).alias("label"))


def location(raw: Column) -> Column:
    """`chr1:10-20` as (chrom, start, end), M as MT; null if it can't be read."""
    shape = r"(?i)^\s*(?:chr)?([0-9]+|X|Y|MT?):([0-9]+)-([0-9]+)\s*$"
    part = lambda i: F.regexp_extract(raw, shape, i)
    chrom = F.upper(part(1))
    return F.when(raw.rlike(shape), F.struct(F.when(chrom == "M", "MT").otherwise(chrom).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end")))


_CLASS = "struct<id:string,label:string>"
_PACKET = (
    f"subject:struct<id:string,sex:string>,phenotypicFeatures:array<struct<type:{_CLASS},excluded:string,negated:string>>,"
    f"diseases:array<struct<term:{_CLASS},excluded:string>>,interpretations:array<struct<progressStatus:string,diagnosis:struct<disease:{_CLASS}>>>"
)


def phenopackets(lines: DataFrame, value: str = "value") -> DataFrame:
    """Packets (one JSON text a row) with present and excluded terms, in their order, and what was not taken.

    Of a family only the proband is read. A term that is recorded twice keeps its first status; `conflicts` counts
    terms with both. `skipped` counts features that aren't HPO terms. The placeholder disease is no diagnosis.
    `why` is set if the text is no packet.
    """
    read = lines.select("*", F.from_json(value, f"struct<{_PACKET},proband:struct<{_PACKET}>,members:string,metaData:string>").alias("_p"))
    family = F.col("_p.phenotypicFeatures").isNull() & F.col("_p.proband").isNotNull()
    pick = lambda n: F.when(family, F.col(f"_p.proband.{n}")).otherwise(F.col(f"_p.{n}"))
    true = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))) == "true"
    raw = F.coalesce(pick("phenotypicFeatures"), F.array().cast(f"array<struct<type:{_CLASS},excluded:string,negated:string>>"))
    term = lambda f: F.upper(F.trim(F.coalesce(f["type"]["id"], F.lit(""))))
    features = F.transform(raw, lambda f: F.struct(term(f).alias("term"), (true(f["excluded"]) | true(f["negated"])).alias("out")))
    hpo = F.filter(features, lambda f: f["term"].rlike("^HP:[0-9]{7}$"))
    nothing = ~family & F.coalesce(*(F.col(f"_p.{n}").cast("string") for n in ("phenotypicFeatures", "interpretations", "diseases", "subject", "metaData"))).isNull()
    why = F.when(F.col("_p.phenotypicFeatures").isNull() & ~family & F.col("_p.members").isNotNull(), "cohort").when(nothing, "not a phenopacket")
    ids = F.transform(F.coalesce(pick("diseases"), F.array().cast(f"array<struct<term:{_CLASS},excluded:string>>")), lambda d: F.when(~true(d["excluded"]), d["term"]["id"]))
    found = F.transform(F.coalesce(pick("interpretations"), F.array().cast(f"array<struct<progressStatus:string,diagnosis:struct<disease:{_CLASS}>>>")), lambda i: i["diagnosis"]["disease"]["id"])
    one = read.select(*lines.columns, why.alias("why"), F.size(raw).alias("_n"), F.explode(F.array(hpo)).alias("_f"), F.array_distinct(F.filter(F.concat(ids, found), lambda d: d.isNotNull() & (d != "") & (d != PLACEHOLDER))).alias("diseases"))
    terms = F.transform("_f", lambda f: f["term"])
    first = one.withColumn("_first", F.filter("_f", lambda f, i: F.array_position(terms, f["term"]) == i + 1))
    both = F.size(F.array_intersect(F.transform(F.filter("_f", lambda f: f["out"]), lambda f: f["term"]), F.transform(F.filter("_f", lambda f: ~f["out"]), lambda f: f["term"])))
    side = lambda keep: F.transform(F.filter("_first", keep), lambda f: f["term"])
    return first.select(
        *lines.columns, "why", side(lambda f: ~f["out"]).alias("present"), side(lambda f: f["out"]).alias("excluded"),
        (F.col("_n") - F.size("_f")).alias("skipped"), both.alias("conflicts"), "diseases",
    )


def variant_hits(lines: DataFrame, value: str = "value") -> DataFrame:
    """(query, found, records, af): hits of batch responses (a JSON list a row); records are objects or lists of them."""
    schema = "array<struct<query:string,notfound:boolean,clinvar:struct<rcv:string>,gnomad_exome:struct<af:struct<af:double>>,gnomad_genome:struct<af:struct<af:double>>>>"
    hit = lines.select(F.explode(F.from_json(value, schema)).alias("h"))
    rcv = one_or_many(F.col("h.clinvar.rcv"), "accession:string,clinical_significance:string")
    af = F.greatest(finite(F.col("h.gnomad_exome.af.af")), finite(F.col("h.gnomad_genome.af.af")))
    return hit.select("h.query", (~F.coalesce("h.notfound", F.lit(False))).alias("found"), rcv.alias("records"), af.alias("af"))


def highest_group(groups: Column) -> Column:
    """Of (id, ac, an) the group of highest frequency, the first among equals; bottlenecked groups and those without alleles don't count."""
    counted = F.filter(groups, lambda g: ~F.lower(g["id"]).isin(*BOTTLENECKED, *NO_GROUPS) & (g["an"] > 0))
    afs = F.transform(counted, lambda g: g["ac"] / g["an"])
    at = F.array_position(afs, F.array_max(afs)).cast("int")
    return F.when(F.size(counted) > 0, F.struct(F.get(counted, at - 1)["id"].alias("group"), F.array_max(afs).alias("af")))


def group_frequencies(lines: DataFrame, value: str = "value") -> DataFrame:
    """(variant, group, af) of variant responses, one a row."""
    r = lines.select(F.from_json(value, "struct<data:struct<variant:struct<variant_id:string,joint:struct<populations:array<struct<id:string,ac:bigint,an:bigint>>>>>>").alias("r")).select("r.data.variant.*")
    return r.where("variant_id is not null").select(F.col("variant_id").alias("variant"), highest_group(F.col("joint.populations")).alias("g")).select("variant", "g.group", "g.af")


def ranked_hits(rows: DataFrame) -> DataFrame:
    """(rank, score, id, matched, genes) of string rows; ranks may tie; rows without a finite score or a rank are left out."""
    many = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    score = F.round(finite(F.col("Score").try_cast("double")), 4)
    out = rows.select(F.col("Rank").try_cast("int").alias("rank"), score.alias("score"), F.col("ORPHA_ID").alias("id"), many(F.col("Matched_Phenotype")).alias("matched"), many(F.col("Causative_Gene")).alias("genes"))
    return out.where("rank is not null and score is not null")


def panels(lines: DataFrame, value: str = "value") -> DataFrame:
    """(gene, panel, rating, mode): rows of panel pages; confidence 3 and more is green, 2 amber, 1 and less red."""
    r = lines.select(F.explode(F.from_json(value, "struct<results:array<struct<gene_data:struct<gene_symbol:string>,confidence_level:string,mode_of_inheritance:string,panel:struct<id:bigint,name:string>>>>")["results"]).alias("r"))
    level = F.col("r.confidence_level").try_cast("int")
    rating = F.when(level >= 3, "green").when(level == 2, "amber").when(level.isNotNull(), "red")
    return r.select(F.col("r.gene_data.gene_symbol").alias("gene"), F.col("r.panel.id").alias("panel"), rating.alias("rating"), F.col("r.mode_of_inheritance").alias("mode"))


SHUT, OPEN = ("UNKNOWN", "COMPLETED", "TERMINATED", "WITHDRAWN", "SUSPENDED"), ("RECRUITING", "NOT_YET_RECRUITING")


def trials(lines: DataFrame, today: Column, value: str = "value") -> DataFrame:
    """(trial, status, updated, sites, flags): flags say stale, unverified and sites that conflict with the status."""
    schema = (
        "struct<studies:array<struct<protocolSection:struct<identificationModule:struct<nctId:string>,statusModule:struct<overallStatus:string,"
        "lastUpdatePostDateStruct:struct<date:string>>,contactsLocationsModule:struct<locations:array<struct<status:string,country:string>>>>>>>"
    )
    s = lines.select(F.explode(F.from_json(value, schema)["studies"]).alias("s")).select("s.protocolSection.*")
    clean = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    raw = F.col("statusModule.lastUpdatePostDateStruct.date")
    day = F.coalesce(raw.try_cast("date"), F.concat(raw, F.lit("-01")).try_cast("date"))
    one = s.select(F.col("identificationModule.nctId").alias("trial"), clean(F.col("statusModule.overallStatus")).alias("status"), day.alias("updated"), F.coalesce("contactsLocationsModule.locations", F.array().cast("array<struct<status:string,country:string>>")).alias("l"))
    flags = F.array_compact(F.array(
        F.when(F.date_diff(today, F.col("updated")) > STALE_DAYS, "stale"), F.when(F.col("status") == "UNKNOWN", "unverified"),
        F.when(F.col("status").isin(*SHUT) & F.exists("l", lambda x: clean(x["status"]).isin(*OPEN)), "conflict"),
    ))
    return one.select("trial", "status", "updated", F.size("l").alias("sites"), flags.alias("flags"))


def summaries(lines: DataFrame, value: str = "value") -> DataFrame:
    """(uid, accession, significance, stars) of record summaries, which come as a map by uid beside the list of uids."""
    r = lines.select(F.explode(F.from_json(value, "struct<result:map<string,string>>")["result"]).alias("uid", "text")).where("uid <> 'uids'")
    got = r.select("uid", F.from_json("text", "struct<accession:string,germline_classification:struct<description:string,review_status:string>>").alias("r"))
    status = F.lower(F.trim("r.germline_classification.review_status"))
    return got.select("uid", "r.accession", F.col("r.germline_classification.description").alias("significance"), lookup(STARS, status).alias("stars"))


def calibrated(score: Column, ranges: list[tuple[float | None, bool, float | None, bool, str]]) -> Column:
    """The class of the first range (low, inclusive, high, inclusive, class) that holds the score; an open end is None."""
    out = F.lit(None).cast("string")
    for low, low_in, high, high_in, name in reversed(ranges):
        above = F.lit(True) if low is None else (score >= low if low_in else score > low)
        below = F.lit(True) if high is None else (score <= high if high_in else score < high)
        out = F.when(above & below & score.isNotNull() & ~F.isnan(score), name).otherwise(out)
    return out


def medians(lines: DataFrame, value: str = "value") -> DataFrame:
    """(gene, tissue, median, unit) of expression responses; values that aren't finite are null."""
    r = lines.select(F.explode(F.from_json(value, "struct<data:array<struct<median:double,tissueSiteDetailId:string,geneSymbol:string,unit:string>>>")["data"]).alias("r"))
    return r.select(F.col("r.geneSymbol").alias("gene"), F.col("r.tissueSiteDetailId").alias("tissue"), finite(F.col("r.median")).alias("median"), "r.unit")


#: floors of expression bands in TPM (fixed values)
BANDS = ((10.0, "expressed"), (1.0, "expressed_low"), (0.1, "trace"))


def band(tpm: Column) -> Column:
    """The band of a median; null stays null."""
    out = F.when(tpm.isNotNull(), "not_detected")
    for floor, name in reversed(BANDS):
        out = F.when(tpm >= floor, name).otherwise(out)
    return out


# Queries: responses are written from the tables, read back and counted.


def _json(**fields) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def _pages(rows: DataFrame, by: Column, head: str, tail: str, *order) -> DataFrame:
    """Texts `j` put together, a page a value of `by`, sorted by `order` and themselves."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct(*order, "j"))), lambda x: x["j"])
    return rows.groupBy(by.alias("page")).agg(F.concat(F.lit(head), F.array_join(texts, ","), F.lit(tail)).alias("value"))


def _s(c) -> Column:
    return F.col(c).cast("string")


def query_phenopackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packets, every fifth as a family: features of all line items, some repeated, some no HPO terms."""
    li = P.table(spark, sf_dir, "lineitem")
    term = F.when(F.col("l_linenumber") == 7, "X:1").otherwise(F.concat(F.lit("HP:"), F.lpad((F.col("l_suppkey") % 4).cast("string"), 7, "0")))
    feature = _json(type=F.struct(term.alias("id")), excluded=F.col("l_returnflag") == "R")
    packets = _pages(li.select("l_orderkey", "l_linenumber", feature.alias("j")), F.col("l_orderkey"), '{"subject":{"id":"p"},"phenotypicFeatures":[', "]}", "l_linenumber")
    value = F.when(F.col("page") % 5 == 0, F.concat(F.lit('{"proband":'), "value", F.lit(',"id":"f"}'))).when(F.col("page") % 7 == 0, '{"a":1}').otherwise(F.col("value"))
    r = phenopackets(packets.select("page", value.alias("value")))
    return r.groupBy(F.coalesce("why", F.lit("read")).alias("why"), F.size("present").alias("n_present"), F.size("excluded").alias("n_excluded"), "skipped", "conflicts").agg(F.count("*").alias("n"))


def query_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as gene rows: a mode of inheritance or another term each; modes of a brand."""
    p = P.table(spark, sf_dir, "part")
    some = [k for k, _ in sorted(MODES.items())]
    term = F.coalesce(F.get(F.array(*map(F.lit, some)), (F.col("p_partkey") % 15).cast("int")), F.lit("HP:0001250"))
    m = gene_modes(p.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("gene_symbol"), term.alias("hpo_id")))
    return m.select("gene", F.array_join("modes", ",").alias("modes"))


def query_dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a dosage table, some without a location that can be read; genes and bases by chromosome."""
    p = P.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    chrom = F.when(k % 24 == 0, "chrM").when(k % 24 == 23, "x").otherwise(F.concat(F.lit("chr"), (k % 24).cast("string")))
    place = F.when(k % 10 == 3, "tbd").otherwise(F.concat(chrom, F.lit(":"), (k * 10).cast("string"), F.lit("-"), (k * 10 + F.col("p_size")).cast("string")))
    score = F.when(k % 6 == 0, "").otherwise((k % 4).cast("string"))
    line = F.concat(F.when(k % 11 == 0, "#").otherwise(""), F.concat_ws("\t", "p_brand", place, score))
    r = columns_of(p.select(line.alias("value")), ["gene", "location", "haploinsufficiency"]).withColumn("l", location(F.col("location")))
    return r.groupBy(F.coalesce("l.chrom", F.lit("none")).alias("chrom"), F.coalesce("haploinsufficiency", F.lit("not given")).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col("l.end") - F.col("l.start")).alias("bases"))


def query_variant_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as hits of batch responses, an order a batch: records as a list, an object, or left out."""
    li = P.table(spark, sf_dir, "lineitem")
    record = '{"accession":"R","clinical_significance":"Pathogenic"}'
    clinvar = F.when(F.col("l_returnflag") == "R", f',"clinvar":{{"rcv":[{record},{record}]}}').when(F.col("l_returnflag") == "A", f',"clinvar":{{"rcv":{record}}}').otherwise("")
    exome = F.when(F.col("l_linestatus") == "F", F.concat(F.lit(',"gnomad_exome":{"af":{"af":'), _s("l_discount"), F.lit("}}"))).otherwise("")
    genome = F.concat(F.lit(',"gnomad_genome":{"af":{"af":'), _s("l_tax"), F.lit("}}"))
    rest = F.when(F.col("l_linenumber") == 7, ',"notfound":true').otherwise(F.concat(clinvar, exome, genome))
    hits = li.select("l_orderkey", F.concat(F.lit('{"query":"chr'), (1 + F.col("l_partkey") % 22).cast("string"), F.lit('"'), rest, F.lit("}")).alias("j"))
    r = variant_hits(_pages(hits, F.col("l_orderkey"), "[", "]"))
    return r.groupBy("query").agg(F.count("*").alias("n"), F.count_if("found").alias("found"), F.sum(F.size("records")).alias("records"), F.round(F.sum("af"), 4).alias("af"))


def query_group_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as variants with five groups; the best of those that count."""
    p, k = P.table(spark, sf_dir, "part"), F.col("p_partkey")
    one = lambda i, ac, an: F.struct(F.lit(i).alias("id"), ac.cast("long").alias("ac"), an.cast("long").alias("an"))
    groups = F.array(one("fin", F.lit(99), F.lit(100)), one("nfe", k % 9, F.lit(100)), one("afr", k % 7, F.lit(50)), one("eas", k % 5, F.when(k % 3 == 0, 0).otherwise(80)), one("XX", F.lit(9), F.lit(10)))
    value = _json(data=F.struct(F.struct(_s("p_partkey").alias("variant_id"), F.struct(groups.alias("populations")).alias("joint")).alias("variant")))
    return group_frequencies(p.select(value.alias("value"))).select("variant", "group", F.round("af", 6).alias("af"))


def query_ranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ranked diseases; some without a score."""
    li = P.table(spark, sf_dir, "lineitem")
    score = F.when(F.col("l_linenumber") == 6, "").when(F.col("l_linenumber") == 7, "NaN").otherwise(_s("l_discount"))
    line = F.concat_ws("\t", _s("l_linenumber"), score, F.concat(F.lit("ORPHA:"), _s("l_suppkey")), F.lit("name"), F.when(F.col("l_returnflag") == "R", "HP:1,,HP:2").otherwise(""), F.lit("A,B,C"))
    rows = columns_of(li.select(line.alias("value")), ["Rank", "Score", "ORPHA_ID", "Disease_Name", "Matched_Phenotype", "Causative_Gene"])
    return ranked_hits(rows).groupBy("id").agg(F.count("*").alias("n"), F.min("rank").alias("best"), F.max("score").alias("score"), F.sum(F.size("matched")).alias("matched"), F.sum(F.size("genes")).alias("genes"))


def query_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as panel entries, a hundred a page; some without a level."""
    c = P.table(spark, sf_dir, "customer")
    level = F.when(F.col("c_custkey") % 6 < 5, (F.col("c_custkey") % 6).cast("string"))
    entry = _json(gene_data=F.struct(F.col("c_mktsegment").alias("gene_symbol")), confidence_level=level, mode_of_inheritance=F.lit("m"), panel=F.struct(F.col("c_nationkey").cast("long").alias("id")))
    pages = _pages(c.select("c_custkey", entry.alias("j")), F.expr("c_custkey div 100"), '{"count":1,"results":[', "]}")
    return panels(pages).groupBy("gene", F.coalesce("rating", F.lit("unrated")).alias("rating")).agg(F.count("*").alias("n"), F.countDistinct("panel").alias("panels"))


def query_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as studies, one a response, every second dated by month; flags on the first day of 1998."""
    o, k = P.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "UNKNOWN").otherwise("RECRUITING")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    sites = F.array(F.struct(F.when(k % 3 == 0, "recruiting").otherwise("COMPLETED").alias("status")))
    section = F.struct(
        F.struct(_s("o_orderkey").alias("nctId")).alias("identificationModule"),
        F.struct(status.alias("overallStatus"), F.struct(F.when(k % 2 == 0, F.left(day, F.lit(7))).otherwise(day).alias("date")).alias("lastUpdatePostDateStruct")).alias("statusModule"),
        F.when(k % 5 != 0, F.struct(sites.alias("locations"))).alias("contactsLocationsModule"),
    )
    r = trials(o.select(_json(studies=F.array(F.struct(section.alias("protocolSection")))).alias("value")), F.lit("1998-01-01").cast("date"))
    return r.groupBy("status", F.array_join("flags", ",").alias("flags")).agg(F.count("*").alias("n"), F.sum("sites").alias("sites"), F.max("updated").cast("string").alias("last"))


def query_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as record summaries, ten a response; stars by review status."""
    s, k = P.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    status = F.get(F.array(*map(F.lit, ["Practice guideline", "reviewed by expert panel", "criteria provided, single submitter", "something new"])), (k % 4).cast("int"))
    record = _json(accession=F.concat(F.lit("VCV"), _s("s_suppkey")), germline_classification=F.struct(F.col("s_name").alias("description"), status.alias("review_status")))
    entry = F.concat(F.lit('"'), _s("s_suppkey"), F.lit('":'), record)
    r = summaries(_pages(s.select("s_suppkey", entry.alias("j")), F.expr("s_suppkey div 10"), '{"result":{"uids":["1"],', "}}"))
    return r.select("uid", "accession", "significance", F.col("stars").cast("long").alias("stars"))


RANGES = [(None, False, 10.0, False, "low"), (10.0, True, 20.0, True, "middle"), (40.0, False, None, False, "high")]


def query_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = P.table(spark, sf_dir, "lineitem")
    name = F.coalesce(calibrated(F.col("l_quantity"), RANGES), F.lit("none"))
    return li.groupBy(name.alias("class")).agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


def query_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as expression rows, fifty a response, every ninth not a number; bands by tissue."""
    p, k = P.table(spark, sf_dir, "part"), F.col("p_partkey")
    value = F.when(k % 9 == 0, "NaN").otherwise(((k % 5 * k % 400) / 20).cast("string"))
    entry = F.concat(F.lit('{"median":'), value, F.lit(',"tissueSiteDetailId":"'), "p_brand", F.lit('","unit":"TPM"}'))
    r = medians(_pages(p.select("p_partkey", entry.alias("j")), F.expr("p_partkey div 50"), '{"data":[', "]}"))
    return r.groupBy("tissue", F.coalesce(band(F.col("median")), F.lit("unknown")).alias("band")).agg(F.count("*").alias("n"), F.max("median").alias("median"))


_TERMS = ", ".join(f"'{MODES[k]}'" for k in sorted(MODES))
SQL = {
    "src15_phenopackets": """WITH f AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_suppkey % 4 AS t, l_returnflag = 'R' AS ex, l_linenumber = 7 AS other,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber = 7, l_suppkey % 4 ORDER BY l_linenumber, l_returnflag = 'R') AS rn FROM lineitem),
b AS (SELECT k, t, count(DISTINCT ex) AS sides FROM f WHERE NOT other GROUP BY 1, 2), c AS (SELECT k, count(*) FILTER (sides = 2) AS conflicts FROM b GROUP BY 1),
r AS (SELECT k, count(*) FILTER (NOT other AND rn = 1 AND NOT ex) AS p, count(*) FILTER (NOT other AND rn = 1 AND ex) AS e, count(*) FILTER (other) AS s FROM f GROUP BY 1),
w AS (SELECT k % 5 <> 0 AND k % 7 = 0 AS bad, * FROM r LEFT JOIN c USING (k))
SELECT CASE WHEN bad THEN 'not a phenopacket' ELSE 'read' END AS why, CAST(CASE WHEN bad THEN 0 ELSE p END AS INTEGER) AS n_present, CAST(CASE WHEN bad THEN 0 ELSE e END AS INTEGER) AS n_excluded,
  CAST(CASE WHEN bad THEN 0 ELSE s END AS INTEGER) AS skipped, CAST(CASE WHEN bad THEN 0 ELSE coalesce(conflicts, 0) END AS INTEGER) AS conflicts, count(*) AS n FROM w GROUP BY ALL""",
    "src11_gene_modes": f"""WITH m AS (SELECT DISTINCT p_brand || '/' || p_size AS gene, [{_TERMS}][1 + p_partkey % 15] AS mode FROM part)
SELECT gene, string_agg(mode, ',' ORDER BY mode) AS modes FROM m WHERE mode IS NOT NULL GROUP BY 1""",
    "src17_dosage": """SELECT CASE WHEN p_partkey % 10 = 3 THEN 'none' WHEN p_partkey % 24 = 0 THEN 'MT' WHEN p_partkey % 24 = 23 THEN 'X' ELSE CAST(p_partkey % 24 AS VARCHAR) END AS chrom,
  CASE WHEN p_partkey % 6 = 0 THEN 'not given' ELSE CAST(p_partkey % 4 AS VARCHAR) END AS score, count(*) AS n, CAST(sum(CASE WHEN p_partkey % 10 <> 3 THEN p_size END) AS BIGINT) AS bases FROM part WHERE p_partkey % 11 <> 0 GROUP BY 1, 2""",
    "con02_variant_hits": """SELECT 'chr' || (1 + l_partkey % 22) AS query, count(*) AS n, count(*) FILTER (l_linenumber <> 7) AS found, CAST(sum(CASE WHEN l_linenumber = 7 THEN 0 WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS records,
  round(sum(CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linestatus = 'F' THEN greatest(l_discount, l_tax) ELSE l_tax END), 4) AS af FROM lineitem GROUP BY 1""",
    "con03_group_frequencies": """WITH g AS (SELECT p_partkey, unnest([{'i': 1, 'g': 'nfe', 'af': (p_partkey % 9) / 100e0}, {'i': 2, 'g': 'afr', 'af': (p_partkey % 7) / 50e0}, {'i': 3, 'g': 'eas', 'af': CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 5) / 80e0 END}]) AS x FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS variant, x.g AS "group", round(x.af, 6) AS af FROM g WHERE x.af IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY x.af DESC, x.i) = 1""",
    "con07_ranked_hits": """SELECT 'ORPHA:' || l_suppkey AS id, count(*) AS n, min(l_linenumber) AS best, max(l_discount) AS score, count(*) FILTER (l_returnflag = 'R') * 2 AS matched, count(*) * 3 AS genes FROM lineitem WHERE l_linenumber < 6 GROUP BY 1""",
    "con12_panels": """SELECT c_mktsegment AS gene, CASE WHEN c_custkey % 6 = 5 THEN 'unrated' WHEN c_custkey % 6 >= 3 THEN 'green' WHEN c_custkey % 6 = 2 THEN 'amber' ELSE 'red' END AS rating, count(*) AS n, count(DISTINCT c_nationkey) AS panels FROM customer GROUP BY 1, 2""",
    "con15_trials": """WITH t AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'UNKNOWN' ELSE 'RECRUITING' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS day FROM orders),
f AS (SELECT status, day, CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END AS site, concat_ws(',', CASE WHEN date_diff('day', day, DATE '1998-01-01') > 730 THEN 'stale' END, CASE WHEN status = 'UNKNOWN' THEN 'unverified' END, CASE WHEN status <> 'RECRUITING' AND k % 5 <> 0 AND k % 3 = 0 THEN 'conflict' END) AS flags FROM t)
SELECT status, flags, count(*) AS n, CAST(sum(site) AS BIGINT) AS sites, CAST(max(day) AS VARCHAR) AS last FROM f GROUP BY 1, 2""",
    "con04_summaries": """SELECT CAST(s_suppkey AS VARCHAR) AS uid, 'VCV' || s_suppkey AS accession, s_name AS significance, CAST(CASE s_suppkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 1 END AS BIGINT) AS stars FROM supplier""",
    "con21_calibrated": """SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity <= 20 THEN 'middle' WHEN l_quantity > 40 THEN 'high' ELSE 'none' END AS class, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1""",
    "con22_medians": """WITH m AS (SELECT p_brand AS tissue, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 5 * p_partkey % 400) / 20e0 END AS v FROM part)
SELECT tissue, CASE WHEN v IS NULL THEN 'unknown' WHEN v >= 10 THEN 'expressed' WHEN v >= 1 THEN 'expressed_low' WHEN v >= 0.1 THEN 'trace' ELSE 'not_detected' END AS band, count(*) AS n, max(v) AS median FROM m GROUP BY 1, 2""",
}
QUERIES = {
    "src15_phenopackets": query_phenopackets, "src11_gene_modes": query_modes, "src17_dosage": query_dosage, "con02_variant_hits": query_variant_hits,
    "con03_group_frequencies": query_group_frequencies, "con07_ranked_hits": query_ranked_hits, "con12_panels": query_panels, "con15_trials": query_trials,
    "con04_summaries": query_summaries, "con21_calibrated": query_calibrated, "con22_medians": query_medians,
}
