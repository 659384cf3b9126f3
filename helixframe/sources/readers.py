"""Readers of domain files as DataFrames: text lines in, typed columns out, rejected lines with their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: weights of frequency classes (fixed values)
CLASS_WEIGHT = {"HP:0040280": 1.0, "HP:0040281": 0.9, "HP:0040282": 0.55, "HP:0040283": 0.17, "HP:0040284": 0.025, "HP:0040285": 0.0}
EXCLUDED = "HP:0040285"
OBO = r"^http://purl\.obolibrary\.org/obo/([A-Za-z]+)_(.*)$"


def chromosome(name: Column) -> Column:
    """Without `chr`; M is MT; X and Y in upper case."""
    bare = F.regexp_replace(name, "^(?i)chr", "")
    return F.when(F.upper(bare).isin("M", "MT"), "MT").when(F.upper(bare).isin("X", "Y"), F.upper(bare)).otherwise(bare)


def parse_vcf(lines: DataFrame, value: str = "value") -> DataFrame:
    """Record lines (no headers) as columns, with `why` a line is rejected (null: it isn't)."""
    # A generator keeps the optimizer from copying the split into every column and filter that reads it.
    names, c = lines.columns, F.col("_c")
    lines = lines.select("*", F.explode(F.array(F.split(value, "\t"))).alias("_c"))
    part = lambda i: F.get(c, i)
    pos = part(1).try_cast("long")
    why = (
        F.when(F.size(c) < 8, "columns").when(pos.isNull(), "POS not an integer").when(pos < 1, "POS not 1-based")
        .when((part(3) == "") | (part(4) == ""), "empty REF or ALT").when(~part(3).rlike("(?i)^[ACGTUNRYSWKMBDHV]+$"), "REF not DNA")
    )
    return lines.select(
        *names, part(0).alias("chrom_raw"), chromosome(part(0)).alias("chrom"), pos.alias("pos"), part(2).alias("id"), F.upper(part(3)).alias("ref"), F.split(part(4), ",").alias("alts"), part(5).alias("qual"),
        part(6).alias("filter"), part(7).alias("info"), F.when(F.size(c) > 8, F.split(part(8), ":")).alias("fmt"), F.when(F.size(c) > 9, F.slice(c, F.lit(10), F.size(c))).alias("samples"), why.alias("why"),
    )


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Records and what the header declares. Refuses files with more than half, or over a tenth and twenty, bad lines."""
    lines = spark.read.text(path)
    head = [r.value for r in lines.where("value LIKE '#%'").collect()]  # header lines only
    names = next((h.split("\t") for h in head if h.startswith("#CHROM")), [])
    found = parse_vcf(lines.where("value NOT LIKE '#%' AND value <> ''"))
    n, bad = found.agg(F.count("*"), F.count("why")).first()
    if bad > 0.5 * n or (bad > 20 and bad > 0.1 * n):
        raise ValueError(f"{bad} of {n} lines are not VCF records")
    declared = {k: [h.split("ID=", 1)[1].split(",", 1)[0].rstrip(">") for h in head if h.startswith(f"##{k}=<ID=")] for k in ("INFO", "FORMAT", "FILTER", "contig")}
    return found.where("why is null").drop("why"), {"samples": names[9:], **declared}


def info_map(info: Column) -> Column:
    """`k=v;flag` as a map; flags have null values."""
    return F.map_from_entries(F.transform(F.filter(F.split(info, ";"), lambda x: x != ""), lambda x: F.struct(F.element_at(F.split(x, "=", 2), 1), F.get(F.split(x, "=", 2), 1))))


def calls(records: DataFrame) -> DataFrame:
    """One row a record, ALT (k from 1) and sample (from 0), with the sample's fields by name."""
    each = records.select("chrom", "pos", "ref", "fmt", "samples", F.posexplode("alts").alias("_k", "alt"))
    each = each.select("chrom", "pos", "ref", "alt", (F.col("_k") + 1).alias("k"), "fmt", F.posexplode("samples").alias("sample", "call"))
    # A sample's fields are split once and read by their place in FORMAT; a name FORMAT lacks, or a field that is left out, is null.
    each = each.select("chrom", "pos", "ref", "alt", "k", "sample", "fmt", F.explode(F.array(F.split("call", ":"))).alias("p"))
    field = {n: F.array_position("fmt", n).cast("int") for n in ("GT", "DP", "GQ", "AD")}
    one = F.struct(*(F.when(i > 0, F.get("p", i - 1)).alias(n) for n, i in field.items()))
    each = each.select("chrom", "pos", "ref", "alt", "k", "sample", F.explode(F.array(one)).alias("f"))
    numbers = lambda c, sep: F.transform(F.split(c, sep), lambda a: a.try_cast("int"))
    gt = F.transform(F.split("f.GT", r"[/|]"), lambda a: F.when(~a.startswith("-") & ~a.startswith("+"), a.try_cast("int")))
    return each.select("chrom", "pos", "ref", "alt", "k", "sample", gt.alias("gt"), F.contains("f.GT", F.lit("|")).alias("phased"), F.col("f.DP").try_cast("int").alias("dp"), F.col("f.GQ").try_cast("double").alias("gq"), numbers("f.AD", ",").alias("ad"))


def table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited file after its `#` lines, all columns as strings."""
    return spark.read.option("sep", sep).option("header", True).option("comment", "#").option("mode", "PERMISSIVE").csv(path)


def frequency_weight(raw: Column) -> Column:
    """Class, n/m or percentage to 0..1; 1 where none of them is stated."""
    named = F.create_map(*(x for k, v in CLASS_WEIGHT.items() for x in (F.lit(k), F.lit(v))))
    n, m = F.regexp_extract(raw, r"^(\d+)/(\d+)$", 1), F.regexp_extract(raw, r"^(\d+)/(\d+)$", 2)
    count = F.when((m != "") & (m.cast("double") > 0), F.least(F.lit(1.0), n.cast("double") / m.cast("double")))
    percent = F.when(raw.rlike(r"^[\d.]+%$"), F.least(F.lit(1.0), F.regexp_replace(raw, "%", "").try_cast("double") / 100))
    return F.coalesce(named[raw], count, percent, F.lit(1.0))


def pool_annotations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """hpoa rows of aspect P as (disease, term, weight, unstated) and curated absences (disease, term).

    Counts of a pair are pooled, else the highest stated value is kept; pairs with zero counts only are neither.
    """
    p = rows.where("aspect = 'P'").select(F.col("database_id").alias("disease"), F.col("hpo_id").alias("term"), F.upper(F.coalesce("qualifier", F.lit(""))).alias("q"), F.trim(F.coalesce("frequency", F.lit(""))).alias("f"))
    absent = (F.col("q") == "NOT") | (F.col("f") == EXCLUDED)
    n, m = (F.regexp_extract("f", r"^(\d+)/(\d+)$", i).try_cast("long") for i in (1, 2))
    counted = F.coalesce(m > 0, F.lit(False))
    stated = (F.col("f") != "") & m.isNull()
    by = p.where(~absent).groupBy("disease", "term").agg(
        F.sum(F.when(counted, F.least(n, m))).alias("n"), F.sum(F.when(counted, m)).alias("m"), F.max(F.when(stated, frequency_weight(F.col("f")))).alias("s"), F.max((~counted & ~stated).cast("int")).alias("u")
    )
    known = F.greatest(F.coalesce(F.col("n") / F.col("m"), F.lit(0.0)), F.coalesce("s", F.lit(0.0)))
    out = by.withColumn("known", known).where("known > 0 or u = 1")
    return out.select("disease", "term", F.when(F.col("known") > 0, F.col("known")).otherwise(1.0).alias("weight"), (F.col("known") <= 0).alias("unstated")), p.where(absent).select("disease", "term").distinct()


def read_ontology(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An obographs file as terms, synonyms, is_a edges and replacements, ids as CURIEs."""
    g = spark.read.option("multiLine", True).json(path).select(F.explode("graphs").alias("g"))
    curie = lambda c: F.when(c.rlike(OBO), F.concat(F.regexp_extract(c, OBO, 1), F.lit(":"), F.regexp_extract(c, OBO, 2))).otherwise(c)
    nodes = g.select(F.explode("g.nodes").alias("n"))
    meta = F.from_json(F.to_json("n.meta"), "deprecated boolean, synonyms array<struct<val:string>>, basicPropertyValues array<struct<pred:string,val:string>>")
    nodes = nodes.select(curie(F.col("n.id")).alias("term"), F.col("n.lbl").alias("label"), meta.alias("m"))
    edges = g.select(F.explode("g.edges").alias("e")).where("e.pred = 'is_a'").select(curie(F.col("e.sub")).alias("child"), curie(F.col("e.obj")).alias("parent"))
    values = nodes.select("term", F.explode("m.basicPropertyValues").alias("v"))
    return {
        "terms": nodes.select("term", "label", F.coalesce("m.deprecated", F.lit(False)).alias("obsolete")),
        "synonyms": nodes.select("term", F.explode("m.synonyms.val").alias("synonym")),
        "edges": edges.distinct(),
        "replaced": values.where("v.pred LIKE '%IAO_0100001'").select("term", curie(F.col("v.val")).alias("by")),
        "alt": values.where("v.pred LIKE '%hasAlternativeId'").select(F.col("v.val").alias("alt"), "term"),
    }


def resolve(ids: DataFrame, column: str, ontology: dict[str, DataFrame]) -> DataFrame:
    """`ids` with alternative and replaced ids brought to the ones in use."""
    known = ontology["alt"].union(ontology["replaced"]).groupBy("alt").agg(F.min("term").alias("_to"))
    return ids.join(known.withColumnRenamed("alt", column), column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    """Six columns; repeated people, own parents and parents of the wrong sex are errors."""
    rows = spark.read.text(path).where("trim(value) <> '' AND value NOT LIKE '#%'")
    c = F.split(F.trim("value"), r"\s+")
    none = lambda x: F.when(~x.isin("0", "-9", "."), x)
    p = rows.select(F.size(c).alias("_n"), F.get(c, 0).alias("fam"), F.get(c, 1).alias("iid"), none(F.get(c, 2)).alias("father"), none(F.get(c, 3)).alias("mother"), F.when(F.get(c, 4) == "1", "male").when(F.get(c, 4) == "2", "female").alias("sex"), F.when(F.get(c, 5) == "2", True).when(F.get(c, 5) == "1", False).alias("affected"))
    n, short, own, people = p.agg(F.count("*"), F.count_if(F.col("_n") < 6), F.count_if((F.col("iid") == F.col("father")) | (F.col("iid") == F.col("mother"))), F.countDistinct("iid")).first()
    sexes = p.select(F.col("iid").alias("parent"), "sex")
    roles = p.select(F.col("father").alias("parent"), F.lit("female").alias("wrong")).union(p.select("mother", F.lit("male")))
    problems = [x for x, bad in (("no people", not n), ("a line of fewer than 6 columns", short), ("their own parent", own), ("a person twice", people < n), ("a parent of the wrong sex", n and roles.join(sexes, "parent").where("sex = wrong").limit(1).count())) if bad]
    if problems:
        raise ValueError(f"{path}: {', '.join(problems)}")
    return p.drop("_n")


def gene_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """(gene, at): distinct symbols in the order of first mention; `#` starts a comment, several separators."""
    words = lines.select(F.monotonically_increasing_id().alias("l"), F.posexplode(F.split(F.regexp_replace(F.col(value), "#.*$", ""), r"[\s,;]+")).alias("p", "gene")).where("gene <> ''")
    first = words.groupBy("gene").agg(F.min(F.struct("l", "p")).alias("f"))
    return first.select("gene", F.row_number().over(W.orderBy("f")).alias("at"))


def mappings(rows: DataFrame, predicate: str = "skos:exactMatch") -> DataFrame:
    """(subject, object) of SSSOM rows, exact matches only."""
    return rows.where(F.col("predicate_id") == predicate).select(F.col("subject_id").alias("subject"), F.col("object_id").alias("object")).distinct()


def read_mappings(spark: SparkSession, path: str, predicate: str = "skos:exactMatch") -> DataFrame:
    return mappings(table(spark, path), predicate)


def read_banner_csv(spark: SparkSession, path: str, header: str) -> DataFrame:
    """A CSV whose header line (beginning with `header`) comes after banner rows; rows of dashes or plus signs are dropped."""
    whole = spark.read.text(path, wholetext=True)  # curated tables are a few MB; their order matters
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    head = lines.where(F.ltrim(F.regexp_replace("value", '"', "")).startswith(header)).orderBy("at").limit(1).collect()
    if not head:
        raise ValueError(f"{path}: no header line beginning with {header}")
    names = [x.strip().strip('"') for x in head[0].value.split(",")]
    fields = ", ".join(f"`{n}` string" for n in names)
    body = lines.where((F.col("at") > head[0]["at"]) & (F.col("value") != "")).select(F.from_csv("value", fields).alias("r")).select("r.*")
    return body.where(~F.col(f"`{names[0]}`").rlike(r"^[+\-=\s]*$"))


def survival(rows: DataFrame, time: str = "time", event: str = "event", group: str | None = None) -> DataFrame:
    """(grp, time, event 0/1): codings 0/1 and 1/2; other values, negative or missing times are errors."""
    g = F.col(group) if group else F.lit("all")
    r = rows.select(g.alias("grp"), F.col(time).try_cast("double").alias("time"), F.col(event).try_cast("int").alias("event"))
    bad, low, high = r.agg(F.count_if(F.col("time").isNull() | F.isnan("time") | (F.col("time") < 0) | F.col("event").isNull()), F.min("event"), F.max("event")).first()
    if bad or low is None or low < 0 or high > 2 or (low == 0 and high == 2):
        raise ValueError("times must be numbers of 0 or more, events 0/1 or 1/2")
    return r.withColumn("event", F.col("event") - (1 if high == 2 else 0))


def read_blast(lines: DataFrame, value: str = "value") -> DataFrame:
    """Tabular BLAST hits: twelve columns, comments left out."""
    c = F.split(value, "\t")
    names = "query subject identity length mismatches gaps q_start q_end s_start s_end evalue bits".split()
    kinds = ["string", "string", "double", *["long"] * 7, "double", "double"]
    ok = lines.where((~F.col(value).startswith("#")) & (F.size(c) >= 12))
    return ok.select(*(F.get(c, i).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))))
