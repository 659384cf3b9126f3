"""Declarations of a called file's header, and what its INFO says about each allele: CSQ and ANN entries, frequencies."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans import projections as P
from helixframe.sources import readers

# Impacts from the least, groups of populations, measures of frequency.
IMPACTS = ("MODIFIER", "LOW", "MODERATE", "HIGH")
GROUPS = ("afr", "amr", "eas", "nfe", "sas")
BOTTLENECKED = ("asj", "fin", "ami", "mid", "oth", "remaining")
MEASURES = ("af", "faf95", "faf99")

ENTRY_AF = {"_".join(x for x in (p, g, "af") if x) for p, g in product(("gnomad", "gnomade", "gnomadg"), ("", *GROUPS))}
HIGHEST = {f"{a}_{b}" for x in ("popmax", "grpmax") for a, b in (("af", x), (x, "af"))}


def declarations(lines: DataFrame, value: str = "value") -> DataFrame:
    """(kind, id, number, type, description, length, assembly) of `##kind=<ID=...>` lines; absent fields are null."""
    head = lines.where(F.col(value).rlike("^##[A-Za-z]+=<.*ID="))
    quoted = F.regexp_extract(value, 'Description="(.*)"', 1)
    bare = F.regexp_replace(value, 'Description=".*"', "")  # so that no key is looked for in a description
    field = lambda k: F.nullif(F.regexp_extract(bare, f"[<,]{k}=\"?([^,>\"]*)", 1), F.lit(""))
    return head.select(
        F.regexp_extract(value, "^##([A-Za-z]+)=", 1).alias("kind"), field("ID").alias("id"), field("Number").alias("number"), field("Type").alias("type"),
        F.nullif(quoted, F.lit("")).alias("description"), field("length").try_cast("long").alias("length"), field("assembly").alias("assembly"),
    )


def sub_fields(description: Column) -> Column:
    """Names of the parts of an entry: what a description lists with bars, after `Format:` or in single quotes."""
    listed = F.when(F.contains(description, F.lit("Format:")), F.substring_index(description, "Format:", -1)).otherwise(F.regexp_extract(description, "'([^']*[|][^']*)'", 1))
    return F.when(F.contains(listed, F.lit("|")), F.transform(F.split(F.regexp_replace(listed, "[\"']", ""), "[|]"), lambda x: F.trim(x)))  # trim alone would take the place for its second argument


def is_frequency(key: str, kind: str | None) -> bool:
    """Whether an INFO key holds a population's frequency: never the cohort's own, a count, or a bottlenecked group's."""
    low = key.lower()
    if any(b in low for b in BOTTLENECKED) or kind not in (None, "Float"):
        return False
    if low in HIGHEST:
        return True
    parts = [x for x in low.replace(".", "_").split("_") if x]
    rest = [x for x in parts if not x.startswith("gnomad")]
    if len(rest) == len(parts):
        return False
    if rest and rest[0] in ("exome", "exomes", "genome", "genomes", "joint"):
        rest = rest[1:]
    if rest and rest[0] in MEASURES:
        return True
    return len(rest) == 2 and rest[1] in MEASURES and rest[0].isalpha() and 2 <= len(rest[0]) <= 8


class Header:
    """What annotation needs of a header: names of sub-fields and of frequency keys. Made on the driver from the header's lines alone."""

    def __init__(self, lines: DataFrame, value: str = "value"):
        rows = declarations(lines, value).where("kind = 'INFO'").select("id", "type", sub_fields(F.col("description")).alias("fields")).collect()
        fields = {r.id: r.fields for r in rows}
        self.csq, self.ann = fields.get("CSQ"), fields.get("ANN")
        self.frequencies = sorted(r.id for r in rows if is_frequency(r.id, r.type))


def value_of(info: Column, key: str) -> Column:
    """The first value of `key` in INFO; null if there is none."""
    return F.substring(F.get(F.filter(F.split(info, ";"), lambda x: x.startswith(f"{key}=")), 0), F.lit(len(key) + 2), F.length(info))


def as_written(ref: Column, alts: Column, alt: Column) -> Column:
    """ALT as CSQ writes it: without the first base where all alleles of the record share it, `-` if nothing is left."""
    shared = F.forall(alts, lambda a: (a != "") & (F.left(a, F.lit(1)) == F.left(ref, F.lit(1)))) & (ref != "")
    rest = F.substring(alt, F.lit(2), F.length(alt))
    return F.when(shared, F.when(rest == "", "-").otherwise(rest)).otherwise(alt)


def _entries(text: Column, names: list[str] | None, wanted: dict[str, str], afs: list[str]) -> Column:
    """Entries as structs of the parts in `wanted` (ours: theirs) and the values of frequency parts; parts by name, absent ones ''."""
    at = {n: i for i, n in enumerate(names or [])}

    def one(e: Column) -> Column:
        p = F.split(e, "[|]", -1)
        part = lambda n: F.coalesce(F.trim(F.get(p, F.lit(at[n]))), F.lit("")) if n in at else F.lit("")
        values = F.array(*(F.struct(F.lit(n).alias("name"), part(n).alias("text")) for n in afs)) if afs else F.array().cast("array<struct<name:string,text:string>>")
        return F.struct(*(part(theirs).alias(ours) for ours, theirs in wanted.items()), values.alias("afs"))

    return F.transform(F.split(text, ","), one)


def info_annotation(records: DataFrame, header: Header) -> DataFrame:
    """A row a record and ALT (k from 1): the worst impact with its gene and consequence, the highest frequency, and their sources.

    `records` has ref, alts and info. Entries belong to an ALT by ALLELE_NUM if CSQ has it, else by the allele as written. Of
    equal impacts the first stands, CSQ before ANN. Frequencies above 1 or below 0 are refused and their fields told.
    """
    each = records.select("*", F.posexplode("alts").alias("_k", "alt")).withColumn("k", F.col("_k") + 1).drop("_k")
    afs = [n for n in header.csq or [] if n.lower() in ENTRY_AF]
    nothing = F.lit(None).cast("string")
    csq = value_of(F.col("info"), "CSQ") if header.csq else nothing
    ann = value_of(F.col("info"), "ANN") if header.ann else nothing
    found_csq = _entries(csq, header.csq, {"allele": "Allele", "num": "ALLELE_NUM", "impact": "IMPACT", "gene": "SYMBOL", "consequence": "Consequence"}, afs)
    found_ann = _entries(ann, header.ann, {"allele": "Allele", "num": "", "impact": "Annotation_Impact", "gene": "Gene_Name", "consequence": "Annotation"}, [])
    written = as_written(F.col("ref"), F.col("alts"), F.col("alt"))
    if "ALLELE_NUM" in (header.csq or []):
        mine = F.filter(found_csq, lambda e: (e["num"] == "") | (e["num"] == F.col("k").cast("string")))
    else:
        mine = F.filter(found_csq, lambda e: (e["allele"] == written) | (e["allele"] == F.col("alt")))
    none = F.array().cast("array<struct<allele:string,num:string,impact:string,gene:string,consequence:string,afs:array<struct<name:string,text:string>>>>")
    # Behind a generator, so that entries are split once.
    parts = F.struct(F.coalesce(mine, none).alias("csq"), F.coalesce(F.filter(found_ann, lambda e: e["allele"].isin("") | (e["allele"] == F.col("alt"))), none).alias("ann"))
    each = each.select("*", F.explode(F.array(parts)).alias("_e"))
    rank = lambda e: F.array_position(F.array(*map(F.lit, IMPACTS)), e["impact"])
    all_entries = F.concat("_e.csq", "_e.ann")
    top = F.array_max(F.transform(all_entries, rank))
    worst = F.when(top > 0, F.get(F.filter(all_entries, lambda e: rank(e) == top), 0))

    def frequencies(key: str) -> Column:
        values = F.split(value_of(F.col("info"), key), ",")
        values = F.when(F.size(values) == F.size("alts"), F.slice(values, F.col("k"), F.lit(1))).otherwise(values)
        return F.transform(values, lambda v: F.struct(F.lit(key).alias("name"), v.alias("text")))

    own = [frequencies(key) for key in header.frequencies]
    in_entries = F.flatten(F.transform("_e.csq", lambda e: F.flatten(F.transform(e["afs"], lambda a: F.transform(F.split(a["text"], "&"), lambda v: F.struct(a["name"].alias("name"), v.alias("text")))))))
    numbers = F.flatten(F.array(in_entries, *(F.coalesce(x, F.array().cast("array<struct<name:string,text:string>>")) for x in own)))
    numbers = F.filter(F.transform(numbers, lambda x: F.struct(x["name"].alias("name"), x["text"].try_cast("double").alias("x"))), lambda x: x["x"].isNotNull() & ~F.isnan(x["x"]))
    each = each.withColumn("_n", numbers).withColumn("_w", worst)
    plausible = lambda x: x["x"].between(0, 1)
    present = F.lit(False)
    for x in own:
        present |= x.isNotNull()
    sources = F.array_compact(F.array(F.when(F.size("_e.csq") > 0, "CSQ"), F.when(F.size("_e.ann") > 0, "ANN"), F.when(present, "INFO AF")))
    blank = lambda c: F.nullif(F.col(f"_w.{c}"), F.lit(""))
    return each.select(
        *records.columns, "k", "alt", F.col("_w.impact").alias("impact"), blank("gene").alias("gene"), blank("consequence").alias("consequence"),
        F.array_max(F.transform(F.filter("_n", plausible), lambda x: x["x"])).alias("af"), sources.alias("sources"),
        F.array_distinct(F.transform(F.filter("_n", lambda x: ~plausible(x)), lambda x: x["name"])).alias("implausible"),
    )


# --- queries -----------------------------------------------------------------------------------------------------

CSQ = 'Consequence annotations from a predictor. Format: IMPACT|Allele|gnomADe_AF|Consequence|SYMBOL'
ANN = "Functional annotations: 'Allele | Annotation | Annotation_Impact | Gene_Name'"


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header with a contig a nation, an INFO key a region, and the annotation keys."""
    n, r = P.table(spark, sf_dir, "nation"), P.table(spark, sf_dir, "region")
    contig = F.concat(F.lit("##contig=<ID=chr"), F.col("n_nationkey").cast("string"), F.lit(",length="), (1000 + F.col("n_nationkey")).cast("string"), F.when(F.col("n_regionkey") == 0, ",assembly=GRCh38").otherwise(""), F.lit(">"))
    key = F.concat(F.lit('##INFO=<ID='), F.when(F.col("r_regionkey") % 2 == 0, "gnomAD_AF").otherwise("AC_fin"), F.col("r_regionkey").cast("string"), F.lit(',Number=A,Type=Float,Description="Of region, ID=x, '), F.col("r_name"), F.lit('">'))
    fixed = [f'##INFO=<ID=CSQ,Number=.,Type=String,Description="{CSQ}">', f'##INFO=<ID=ANN,Number=.,Type=String,Description="{ANN}">', '##INFO=<ID=gnomAD_AF,Number=A,Type=Float,Description="Frequency">', '##FILTER=<ID=PASS,Description="All, passed">', "##fileformat=VCFv4.2"]
    return n.select(contig.alias("value")).unionAll(r.select(key)).unionAll(r.where("r_regionkey = 0").select(F.explode(F.array(*map(F.lit, fixed)))))


def query_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = declarations(header_lines(spark, sf_dir))
    return d.select("kind", "id", "number", "type", "length", "assembly", F.coalesce(F.size(sub_fields(F.col("description"))), F.lit(0)).alias("parts"), F.element_at(sub_fields(F.col("description")), -1).alias("last"))


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as records: CSQ in those of status F, ANN in the others, both in third lines; one or two ALTs, or a deletion."""
    li = P.table(spark, sf_dir, "lineitem")
    s = lambda e: F.expr(f"CAST({e} AS STRING)")
    gone, two = F.col("l_linenumber") == 5, F.col("l_returnflag") == "R"
    ref, alts = F.when(gone, "AC").otherwise("A"), F.when(gone, "A").when(two, "C,T").otherwise("C")
    shown = F.when(gone, "-").otherwise("C")
    impact = lambda e: F.element_at(F.array(*map(F.lit, (*IMPACTS, ""))), F.expr(f"CAST({e} AS INT) + 1"))
    af = F.when(F.col("l_partkey") % 50 == 0, s("l_partkey + 2")).otherwise(F.concat(F.lit("0.0"), s("l_suppkey % 90 + 10")))
    entry = F.concat_ws(",", F.concat_ws("|", impact("l_suppkey % 4"), shown, af, F.lit("c1"), F.concat(F.lit("G"), s("l_suppkey"))), F.concat_ws("|", impact("l_partkey % 5"), F.lit("T"), F.lit("0.5&0.25"), F.lit("c2")), F.concat_ws("|", impact("l_orderkey % 5"), shown, F.lit(""), F.lit("c3"), F.lit("")))
    ann = F.concat_ws(",", F.concat_ws(" | ", F.split(alts, ",")[0], F.lit("c4"), impact("l_orderkey % 4"), F.lit("K")), F.concat_ws("|", F.lit("T"), F.lit("c5"), F.lit("HIGH"), F.lit("L")))
    with_csq, with_ann = (F.col("l_linestatus") == "F") | (F.col("l_linenumber") == 3), (F.col("l_linestatus") != "F") | (F.col("l_linenumber") == 3)
    own = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("gnomAD_AF=0.125"), F.when(two & ~gone, ",-1").otherwise("")))
    info = F.concat_ws(";", F.lit("DP=3"), F.when(with_csq, F.concat(F.lit("CSQ="), entry)), F.when(with_ann, F.concat(F.lit("ANN="), ann)), own)
    pos = s("l_orderkey * 8 + l_linenumber + 1")
    return li.select(F.concat_ws("\t", F.lit("chr1"), pos, F.lit("."), ref, alts, F.lit("50"), F.lit("PASS"), info).alias("value"))


def query_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = Header(header_lines(spark, sf_dir))
    found = info_annotation(readers.parse_vcf(record_lines(spark, sf_dir)).where("why IS NULL"), header)
    return found.groupBy("alt", "k", "impact", "gene", "consequence", "af", F.array_join("sources", "+").alias("sources"), F.array_join("implausible", "+").alias("implausible")).agg(F.count("*").alias("n"))


_I = ", ".join(f"'{x}'" for x in (*IMPACTS, ""))
SQL = {
    "src02_header": """SELECT 'contig' AS kind, 'chr' || n_nationkey AS id, NULL AS number, NULL AS type, 1000 + n_nationkey AS length, CASE WHEN n_regionkey = 0 THEN 'GRCh38' END AS assembly, 0 AS parts, NULL AS last FROM nation
UNION ALL SELECT 'INFO', CASE WHEN r_regionkey % 2 = 0 THEN 'gnomAD_AF' ELSE 'AC_fin' END || r_regionkey, 'A', 'Float', NULL, NULL, 0, NULL FROM region
UNION ALL SELECT * FROM (VALUES ('INFO', 'CSQ', '.', 'String', NULL, NULL, 5, 'SYMBOL'), ('INFO', 'ANN', '.', 'String', NULL, NULL, 4, 'Gene_Name'), ('INFO', 'gnomAD_AF', 'A', 'Float', NULL, NULL, 0, NULL), ('FILTER', 'PASS', NULL, NULL, NULL, NULL, 0, NULL)) AS t""",
    "prj13_info": f"""WITH a AS (SELECT *, CASE WHEN l_linenumber = 5 THEN ['A'] WHEN l_returnflag = 'R' THEN ['C', 'T'] ELSE ['C'] END AS alts,
  l_linestatus = 'F' OR l_linenumber = 3 AS csq, l_linestatus <> 'F' OR l_linenumber = 3 AS ann FROM lineitem),
e AS (SELECT *, unnest(range(1, len(alts) + 1)) AS k FROM a),
r AS (SELECT *, alts[k] AS alt, alts[k] = 'T' AS second, [{_I}] AS i,
  CASE WHEN l_partkey % 50 = 0 THEN l_partkey + 2 ELSE (l_suppkey % 90 + 10) / 1000e0 END AS f1 FROM e),
-- what belongs to the allele, in the order of the file: (rank, gene, consequence)
c AS (SELECT *, CASE WHEN NOT csq THEN [] WHEN second THEN [{{'r': l_partkey % 5, 'g': NULL, 'c': 'c2'}}]
    ELSE [{{'r': l_suppkey % 4, 'g': 'G' || l_suppkey, 'c': 'c1'}}, {{'r': l_orderkey % 5, 'g': NULL, 'c': 'c3'}}] END
  || CASE WHEN NOT ann THEN [] WHEN second THEN [{{'r': 3, 'g': 'L', 'c': 'c5'}}] ELSE [{{'r': l_orderkey % 4, 'g': 'K', 'c': 'c4'}}] END AS x FROM r),
w AS (SELECT *, list_filter(x, lambda z: z.r < 4) AS y FROM c),
t AS (SELECT *, list_max(list_transform(y, lambda z: z.r)) AS top FROM w),
b AS (SELECT *, list_filter(y, lambda z: z.r = top)[1] AS best,
  list_filter([CASE WHEN csq AND second THEN 0.5e0 WHEN csq THEN f1 END, CASE WHEN l_suppkey % 3 = 0 THEN CASE WHEN second THEN -1e0 ELSE 0.125e0 END END], lambda z: z BETWEEN 0 AND 1) AS afs,
  CASE WHEN csq AND NOT second AND f1 > 1 THEN 'gnomADe_AF' END AS bad1, CASE WHEN l_suppkey % 3 = 0 AND second THEN 'gnomAD_AF' END AS bad2 FROM t)
SELECT alt, CAST(k AS INTEGER) AS k, i[best.r + 1] AS impact, best.g AS gene, best.c AS consequence, list_max(afs) AS af,
  concat_ws('+', CASE WHEN csq THEN 'CSQ' END, CASE WHEN ann THEN 'ANN' END, CASE WHEN l_suppkey % 3 = 0 THEN 'INFO AF' END) AS sources, concat_ws('+', bad1, bad2) AS implausible, count(*) AS n FROM b GROUP BY ALL""",
}
QUERIES = {"src02_header": query_header, "prj13_info": query_info}
