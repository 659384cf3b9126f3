"""Text operators: label normalisation and search, bigram Dice, mentions, privacy gate, markup, sequences, dates and ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.plans import projections as P


def normalise(label: Column) -> Column:
    """Lower case, other characters to blanks, simple plurals to singulars."""
    words = F.split(F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " ")), " ")
    single = lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.rlike("(ss|is|us)$"), F.substring(w, 1, F.length(w) - 1)).otherwise(w)
    return F.array_join(F.transform(words, single), " ")


def query_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    return p.groupBy(normalise(F.concat_ws("-", F.col("p_name"), F.col("p_type"), F.lit("Lists & ISS"))).alias("label")).agg(F.count("*").alias("n"))


def query_label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names and their beginnings and insides as queries against all part names: rank 0 exact, 1 prefix, 2 word, 3 substring; first five of each."""
    p = P.table(spark, sf_dir, "part")
    names = p.select(normalise(F.col("p_name")).alias("label")).distinct()
    words = names.select(F.explode(F.split("label", " ")).alias("w")).distinct()
    asked = words.select(F.explode(F.array("w", F.substring("w", 1, 2), F.expr("substring(w, 2, 3)"))).alias("q")).where("q <> ''").distinct()
    # Whatever contains a query contains its first piece of up to three letters at some place, an equi-join.
    places = names.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("i"))
    pieces = places.select("label", F.explode(F.array(*(F.substring("label", F.col("i"), F.lit(n)) for n in (1, 2, 3)))).alias("k")).distinct()
    hits = asked.withColumn("k", F.substring("q", 1, 3)).join(pieces, "k").where(F.contains("label", "q")).select("q", "label").distinct()
    rank = F.when(F.col("label") == F.col("q"), 0).when(F.startswith("label", "q"), 1).when(F.array_contains(F.split("label", " "), F.col("q")), 2).otherwise(3)
    order = W.partitionBy("q").orderBy("rank", F.length("label") - F.length("q"), "label")
    return hits.withColumn("rank", rank).withColumn("n", F.row_number().over(order).cast("long")).where("n <= 5")


def bigrams(s: Column) -> Column:
    return F.when(F.length(s) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def query_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that resemble another by bigram Dice of 0.6 or more; candidates meet by shared bigrams."""
    names = P.table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    grams = names.withColumn("g", bigrams(F.col("a")))
    one = grams.select("a", F.size("g").alias("na"), F.explode("g").alias("x"))
    two = one.select(F.col("a").alias("b"), F.col("na").alias("nb"), "x")
    common = one.join(two, "x").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return common.select("a", "b", F.round(2.0 * F.col("c") / (F.col("na") + F.col("nb")), 6).alias("dice")).where("dice >= 0.6")


def mentions(text: Column, word: str) -> Column:
    """Whether a text names a word between word borders, whatever its case; null for a null text."""
    return F.lower(text).rlike(f"(^|[^a-z0-9]){word}([^a-z0-9]|$)")


def query_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents that name, that don't, and whose text is unknown, for three words."""
    d = P.table(spark, sf_dir, "documents")
    out = None
    for w in ("the", "license", "token"):
        m = mentions(F.col("text"), w)
        by = d.groupBy("lang").agg(F.count_if(m).alias("named"), F.count_if(~m).alias("not_named"), F.count_if(m.isNull()).alias("unknown")).withColumn("word", F.lit(w))
        out = by if out is None else out.union(by)
    return out


#: what the gate looks for (fixed values): reason and pattern
PII = (
    ("email", r"[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+"),
    ("card", r"(^|[^0-9])[0-9]{16}([^0-9]|$)"),
    ("phone", r"(^|[^0-9])[0-9]{3}-[0-9]{4}([^0-9]|$)"),
    ("ip", r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.]|$)"),
    ("secret", r"(password|token|secret) *[:=]"),
    ("resident_id", r"(^|[^0-9])[1-9][0-9]{16}[0-9x]([^0-9x]|$)"),
)


#: what finds the same texts faster: words that must be there, and a pattern that fails at the first character of most places
PII_FAST = {
    "email": (("@",), r"[a-z0-9._%+-]@[a-z0-9-]+\.[a-z0-9-]"),
    "card": ((), r"[0-9](?<![0-9]{2})[0-9]{15}(?![0-9])"),
    "phone": (("-",), r"[0-9](?<![0-9]{2})[0-9]{2}-[0-9]{4}(?![0-9])"),
    "ip": ((), r"[0-9](?<![0-9.][0-9])[0-9]{0,2}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9.])"),
    "secret": (("password", "token", "secret"), r"(?:password|token|secret) *[:=]"),
    "resident_id": ((), r"[1-9](?<![0-9][1-9])[0-9]{16}[0-9x](?![0-9x])"),
}


def privacy_reasons(text: Column) -> Column:
    """The kinds of PII that a text has, in their order."""
    folded = F.lower(F.replace(text, F.lit("%40"), F.lit("@")))

    def has(t: Column, kind: str) -> Column:
        words, pattern = PII_FAST[kind]
        any_word = None
        for w in words:
            any_word = F.contains(t, F.lit(w)) if any_word is None else any_word | F.contains(t, F.lit(w))
        return t.rlike(pattern) if any_word is None else any_word & t.rlike(pattern)

    # A lambda's argument is made once, so a text is folded once and not for each pattern.
    return F.get(F.transform(F.array(folded), lambda t: F.array_compact(F.array(*(F.when(has(t, k), F.lit(k)) for k, _ in PII)))), F.lit(0))


def query_privacy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.table(spark, sf_dir, "documents")
    r = privacy_reasons(F.coalesce("text", F.lit("")))
    verdict = F.when(F.array_contains("r", "secret") | F.array_contains("r", "resident_id") | (F.size("r") >= 2), "deny").when(F.size("r") == 1, "ask").otherwise("none")
    return d.select("doc_id", r.alias("r")).select("doc_id", F.concat_ws(",", "r").alias("reasons"), verdict.alias("verdict"))


def query_strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without scripts and tags, basic references decoded, white space folded."""
    t = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(ch))
    return P.table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(t, r"\s+", " ")).alias("text"))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def _sequence(key: str) -> Column:
    """A DNA string made of the letters of an md5."""
    return F.translate(F.substring(F.md5(F.col(key).cast("string")), 1, 24), "0123456789abcdef", "ACGTACGTACGTACGT")


def query_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 9 with NGG right after them on both strands of each part's sequence, with GC share and longest run."""
    s = P.table(spark, sf_dir, "part").select("p_partkey", _sequence("p_partkey").alias("s"))
    strands = s.select("p_partkey", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("s")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("s")).alias("s")))).alias("x")).select("p_partkey", "x.*")
    w = strands.select("p_partkey", "strand", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 11)).alias("at"))
    w = w.select("p_partkey", "strand", "at", F.substring("s", F.col("at"), F.lit(9)).alias("guide"), F.substring("s", F.col("at") + 9, F.lit(3)).alias("pam")).where(F.substring("pam", 2, 2) == "GG")
    gc = F.length(F.regexp_replace("guide", "[AT]", "")) / 9.0
    run = F.coalesce(*(F.when(F.col("guide").rlike("A{%d}|C{%d}|G{%d}|T{%d}" % (n, n, n, n)), F.lit(n)) for n in range(9, 1, -1)), F.lit(1))
    return w.select("p_partkey", "strand", "at", "guide", "pam", F.round(gc, 4).alias("gc"), run.alias("longest_run"))


def query_allele_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF and ALT without their common ending and beginning, one base of each kept."""
    p = P.table(spark, sf_dir, "part").select("p_partkey", F.substring(_sequence("p_partkey"), 1, 8).alias("r"))
    v = p.select("p_partkey", "r", F.concat(F.substring("r", 1, 3), F.when(F.col("p_partkey") % 2 == 0, "T").otherwise(""), F.substring("r", 6, 3)).alias("a"))
    same_end = F.aggregate(F.sequence(F.lit(1), F.least(F.length("r"), F.length("a")) - 1), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.right("r", i) == F.right("a", i)), i).otherwise(n))
    v = v.withColumn("e", same_end).select("p_partkey", F.substring(F.col("r"), F.lit(1), F.length("r") - F.col("e")).alias("r"), F.substring(F.col("a"), F.lit(1), F.length("a") - F.col("e")).alias("a"))
    same_start = F.aggregate(F.sequence(F.lit(0), F.least(F.length("r"), F.length("a")) - 1), F.lit(0), lambda n, i: F.when((i > 0) & (n == i - 1) & (F.left("r", i) == F.left("a", i)), i).otherwise(n))
    v = v.withColumn("b", same_start)
    return v.select("p_partkey", F.col("b").alias("shift"), F.substring(F.col("r"), F.col("b") + 1, F.length("r")).alias("ref"), F.substring(F.col("a"), F.col("b") + 1, F.length("a")).alias("alt"))


def query_partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in three precisions, read back; stale if more than 730 days before the end of 2000."""
    o = P.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise("unknown")
    d = F.coalesce(F.when(F.length(s) == 10, F.try_to_date(s, "yyyy-MM-dd")), F.when(F.length(s) == 7, F.try_to_date(F.concat(s, F.lit("-01")), "yyyy-MM-dd")))
    stale = F.datediff(F.lit("2000-12-31").cast("date"), d) > 730
    return o.select(F.length(s).cast("long").alias("precision"), d.alias("d"), stale.alias("stale")).groupBy("precision", "stale").agg(F.count("*").alias("n"), F.date_format(F.min("d"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("last"))


def query_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages in words to ISO-8601 durations; bare numbers are ambiguous and stay null."""
    p = P.table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" years"))).when(F.col("p_size") % 4 == 1, F.concat(F.col("p_size").cast("string"), F.lit(" months"))).when(F.col("p_size") % 4 == 2, F.concat(F.col("p_size").cast("string"), F.lit(".5 years"))).otherwise(F.col("p_size").cast("string"))
    n, unit = F.regexp_extract(text, r"^([0-9]+)", 1), F.regexp_extract(text, "([a-z]+)$", 1)
    iso = F.when(text.rlike(r"^[0-9]+ years$"), F.concat(F.lit("P"), n, F.lit("Y"))).when(text.rlike(r"^[0-9]+ months$"), F.concat(F.lit("P"), n, F.lit("M"))).when(text.rlike(r"^[0-9]+\.5 years$"), F.concat(F.lit("P"), (n.cast("int") * 12 + 6).cast("string"), F.lit("M")))
    return p.groupBy(text.alias("age"), unit.alias("unit"), iso.alias("duration")).agg(F.count("*").alias("n"))


def _dna(key: str) -> str:
    return f"translate(substr(md5(CAST({key} AS VARCHAR)), 1, 24), '0123456789abcdef', 'ACGTACGTACGTACGT')"


SQL = {
    "str01_normalise": """WITH w AS (SELECT string_split(trim(regexp_replace(lower(p_name || '-' || p_type || '-Lists & ISS'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM part)
SELECT array_to_string(list_transform(w, lambda x: CASE WHEN length(x) > 3 AND x LIKE '%s' AND NOT regexp_matches(x, '(ss|is|us)$') THEN x[:-2] ELSE x END), ' ') AS label, count(*) AS n FROM w GROUP BY 1""",
    "str02_label_search": """WITH w AS (SELECT DISTINCT string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM part),
l AS (SELECT DISTINCT array_to_string(list_transform(w, lambda x: CASE WHEN length(x) > 3 AND x LIKE '%s' AND NOT regexp_matches(x, '(ss|is|us)$') THEN x[:-2] ELSE x END), ' ') AS label FROM w),
v AS (SELECT DISTINCT unnest(string_split(label, ' ')) AS v FROM l),
q AS (SELECT v AS q FROM v UNION SELECT v[1:2] FROM v UNION SELECT v[2:4] FROM v WHERE v[2:4] <> ''),
h AS (SELECT q, label, CASE WHEN label = q THEN 0 WHEN starts_with(label, q) THEN 1 WHEN list_contains(string_split(label, ' '), q) THEN 2 ELSE 3 END AS rank FROM q JOIN l ON contains(label, q) WHERE q <> '')
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, length(label) - length(q), label) AS n FROM h) WHERE n <= 5""",
    "str06_dice": """WITH a AS (SELECT DISTINCT p_name AS a FROM part), g AS (SELECT a, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS g FROM a),
d AS (SELECT x.a, y.a AS b, round(2e0 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)), 6) AS dice FROM g x JOIN g y ON x.a < y.a) SELECT * FROM d WHERE dice >= 0.6""",
    "agg30_mentions": """WITH w(word) AS (VALUES ('the'), ('license'), ('token')), m AS (SELECT lang, word, regexp_matches(lower(text), '(^|[^a-z0-9])' || word || '([^a-z0-9]|$)') AS m FROM documents, w)
SELECT lang, word, count(*) FILTER (m) AS named, count(*) FILTER (NOT m) AS not_named, count(*) FILTER (m IS NULL) AS unknown FROM m GROUP BY 1, 2""",
    "str14_privacy_gate": "WITH t AS (SELECT doc_id, lower(replace(coalesce(text, ''), '%40', '@')) AS t FROM documents), r AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{k}' END" for k, p in PII) + """], lambda x: x IS NOT NULL) AS r FROM t)
SELECT doc_id, coalesce(array_to_string(r, ','), '') AS reasons, CASE WHEN list_contains(r, 'secret') OR list_contains(r, 'resident_id') OR len(r) >= 2 THEN 'deny' WHEN len(r) = 1 THEN 'ask' ELSE 'none' END AS verdict FROM r""",
    "str12_strip_markup": """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM a""",
    "prj27_guides": f"""WITH s AS (SELECT p_partkey, '+' AS strand, {_dna('p_partkey')} AS s FROM part UNION ALL SELECT p_partkey, '-', reverse(translate({_dna('p_partkey')}, 'ACGT', 'TGCA')) FROM part),
w AS (SELECT p_partkey, strand, CAST(i AS INTEGER) AS "at", substr(s, i, 9) AS guide, substr(s, i + 9, 3) AS pam FROM s, range(1, 14) t(i))
SELECT *, round(length(regexp_replace(guide, '[AT]', '', 'g')) / 9e0, 4) AS gc, CASE {' '.join(f"WHEN regexp_matches(guide, 'A{{{n}}}|C{{{n}}}|G{{{n}}}|T{{{n}}}') THEN {n}" for n in range(9, 1, -1))} ELSE 1 END AS longest_run FROM w WHERE substr(pam, 2, 2) = 'GG'""",
    "prj02_allele_trim": f"""WITH r AS (SELECT p_partkey, substr({_dna('p_partkey')}, 1, 8) AS r FROM part), v AS (SELECT p_partkey, r, substr(r, 1, 3) || CASE WHEN p_partkey % 2 = 0 THEN 'T' ELSE '' END || substr(r, 6, 3) AS a FROM r),
e AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(r), length(a))), lambda i: right(r, i) = right(a, i))), 0) AS e FROM v),
t AS (SELECT p_partkey, substr(r, 1, length(r) - e) AS r, substr(a, 1, length(a) - e) AS a FROM e),
b AS (SELECT *, coalesce(list_max(list_filter(range(1, least(length(r), length(a))), lambda i: left(r, i) = left(a, i))), 0) AS b FROM t)
SELECT p_partkey, CAST(b AS INTEGER) AS shift, substr(r, b + 1) AS ref, substr(a, b + 1) AS alt FROM b""",
    "scl01_partial_dates": """WITH s AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE 'unknown' END AS s FROM orders),
d AS (SELECT s, CASE length(s) WHEN 10 THEN try_cast(s AS DATE) WHEN 7 THEN try_cast(s || '-01' AS DATE) END AS d FROM s), t AS (SELECT length(s) AS precision, d, date_diff('day', d, DATE '2000-12-31') > 730 AS stale FROM d)
SELECT precision, stale, count(*) AS n, strftime(min(d), '%Y-%m-%d') AS first, strftime(max(d), '%Y-%m-%d') AS last FROM t GROUP BY 1, 2""",
    "scl02_ages": """WITH t AS (SELECT p_size AS n, CASE p_size % 4 WHEN 0 THEN p_size || ' years' WHEN 1 THEN p_size || ' months' WHEN 2 THEN p_size || '.5 years' ELSE CAST(p_size AS VARCHAR) END AS age FROM part)
SELECT age, CASE n % 4 WHEN 0 THEN 'years' WHEN 1 THEN 'months' WHEN 2 THEN 'years' ELSE '' END AS unit, CASE n % 4 WHEN 0 THEN 'P' || n || 'Y' WHEN 1 THEN 'P' || n || 'M' WHEN 2 THEN 'P' || (n * 12 + 6) || 'M' END AS duration, count(*) AS n FROM t GROUP BY ALL""",
}
QUERIES = {
    "str01_normalise": query_normalise, "str02_label_search": query_label_search, "str06_dice": query_dice, "agg30_mentions": query_mentions, "str14_privacy_gate": query_privacy_gate, "str12_strip_markup": query_strip_markup,
    "prj27_guides": query_guides, "prj02_allele_trim": query_allele_trim, "scl01_partial_dates": query_partial_dates, "scl02_ages": query_ages,
}
