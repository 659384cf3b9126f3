"""Spellings: protein changes, credentials in addresses, whether a trial names a condition, terms most trials share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans import projections as P

#: amino acids by letter (fixed values)
AMINO = {
    "A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu",
    "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "Ter",
}
SECRET_KEYS = ("api_key", "key", "token", "email")  #: address parameters that are dropped
STEM = 6  #: words from this length on may differ in their last two letters


def comparable_change(raw: Column) -> Column:
    """An HGVS change as it is compared: no accession, no brackets or blanks, three-letter residues, upper case. `p.=` names nothing."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"\s", ""), r"^[^:]*:", "")
    text = F.regexp_replace(bare, r"[()]", "")
    text = F.when(text.rlike(r"^[A-Z*]\d+([A-Z*]|=)$"), F.concat(F.lit("p."), text)).otherwise(text)
    shape = r"^(?i)p\.([A-Z]{3}|[A-Z*])(\d+)([A-Z]{3}|[A-Z*]|=)?$"
    part = lambda i: F.upper(F.regexp_extract(text, shape, i))
    long = F.create_map(*(F.lit(x) for a, b in AMINO.items() for x in (a, b.upper())))
    three = lambda c: F.coalesce(long[c], c)
    return F.when(text.isin("", "p.=", "p."), None).when(text.rlike(shape), F.concat(F.lit("P."), three(part(1)), part(2), three(part(3)))).otherwise(F.upper(text))


def query_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "part")
    letters = list(AMINO)
    at = lambda c: (c % len(letters) + 1).cast("int")
    short, full = F.array(*map(F.lit, letters)), F.array(*map(F.lit, AMINO.values()))
    k, a, b = F.col("p_size").cast("string"), at(F.col("p_partkey")), at(F.col("p_size").cast("long"))
    forms = F.array(
        F.concat(short[a - 1], k, short[b - 1]), F.concat(F.lit("NP_1.1:p.("), full[a - 1], k, full[b - 1], F.lit(")")), F.concat(F.lit("p. "), full[a - 1], k, F.lit("=")),
        F.lit("p.(=)"), F.concat(F.lit("NM_2.3:c."), k, F.lit("a>g")),
    )
    return p.select("p_partkey", F.posexplode(forms).alias("form", "raw")).select("p_partkey", "form", comparable_change(F.col("raw")).alias("change"))


def public_url(url: Column) -> Column:
    """The address without credential parameters; all else stays as it is."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~F.lower(F.split_part(x, F.lit("="), F.lit(1))).isin(*SECRET_KEYS)), "&")
    return F.when(query == "", url).otherwise(F.concat(F.split_part(url, F.lit("?"), F.lit(1)), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), F.regexp_extract(url, r"#.*$", 0)))


def query_public_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "pages")
    k = F.col("page_id").cast("string")
    more = F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 == 1, F.concat(F.lit("?Token="), k)).otherwise(F.concat(F.lit("?id="), k, F.lit("&api_key=x&n=&email=a")))
    made = F.concat(F.regexp_replace("url", r"[?#].*$", ""), more, F.when(F.col("page_id") % 3 == 0, "#top").otherwise(""))
    return p.select("page_id", public_url(made).alias("url"))


def same_word(a: Column, b: Column) -> Column:
    """Equal, or of at least STEM letters with a common start that lacks no more than two letters of the shorter."""
    n = F.greatest(F.lit(STEM), F.least(F.length(a), F.length(b)) - 2)
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= STEM) & (F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)))


def names_condition(words: Column, condition: Column) -> Column:
    """Every word of the condition is among the words, but for a slip at its end."""
    return F.forall(condition, lambda w: F.exists(words, lambda h: same_word(w, h)))


def query_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as trials that were answered for the two first words of a part of their type, the second without its last letter."""
    p = P.table(spark, sf_dir, "part")
    words = F.split(F.lower("p_name"), r"\s+")
    first = p.groupBy("p_type").agg(F.min(F.lower("p_name")).alias("asked"))
    w = F.split("asked", r"\s+")
    asked = first.select("p_type", F.transform(F.slice(w, 1, 2), lambda x, i: F.when(i == 0, x).otherwise(F.substr(x, F.lit(1), F.length(x) - 1))).alias("condition"))
    j = p.select("p_type", words.alias("words")).join(asked, "p_type")
    named = names_condition(F.col("words"), F.col("condition"))
    by = j.groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(named).alias("named"))
    return by.withColumn("kept", F.when(F.col("named") * 2 < F.col("n"), F.col("n")).otherwise(F.col("named")))


def query_core_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name words that at least half of a brand's parts of one size carry."""
    p = P.table(spark, sf_dir, "part").select("p_brand", "p_size", F.array_distinct(F.split("p_name", " ")).alias("terms"))
    total = p.groupBy("p_brand", "p_size").agg(F.count("*").alias("total"))
    by = p.select("p_brand", "p_size", F.explode("terms").alias("term")).groupBy("p_brand", "p_size", "term").agg(F.count("*").alias("n"))
    return by.join(total, ["p_brand", "p_size"]).where(F.col("n") * 2 >= F.col("total"))


_LETTERS, _FULL = list(AMINO), [x.upper() for x in AMINO.values()]
SQL = {
    "str11_changes": f"""WITH p AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS k, {_FULL}[p_partkey % {len(AMINO)} + 1] AS a, {_FULL}[p_size % {len(AMINO)} + 1] AS b FROM part)
SELECT p_partkey, CAST(unnest(range(5)) AS INTEGER) AS form, unnest(['P.' || a || k || b, 'P.' || a || k || b, 'P.' || a || k || '=', NULL, 'C.' || k || 'A>G']) AS change FROM p""",
    "scl10_public_url": r"""SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE WHEN page_id % 4 > 1 THEN '?id=' || page_id || '&n=' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN '#top' ELSE '' END AS url FROM pages""",
    "str08_relevance": f"""WITH f AS (SELECT p_type, string_split(min(lower(p_name)), ' ') AS w FROM part GROUP BY 1),
q AS (SELECT p_type, w[1] AS a, left(w[2], length(w[2]) - 1) AS b, length(w) AS n FROM f),
j AS (SELECT part.p_type, q.n, a, b, unnest(string_split(lower(p_name), ' ')) AS h, p_partkey FROM part JOIN q USING (p_type)),
k AS (SELECT p_type, p_partkey, any_value(n) AS nw, bool_or(a = h OR (least(length(a), length(h)) >= {STEM} AND left(a, greatest({STEM}, least(length(a), length(h)) - 2)) = left(h, greatest({STEM}, least(length(a), length(h)) - 2)))) AS x,
  bool_or(b = h OR (least(length(b), length(h)) >= {STEM} AND left(b, greatest({STEM}, least(length(b), length(h)) - 2)) = left(h, greatest({STEM}, least(length(b), length(h)) - 2)))) AS y FROM j GROUP BY 1, 2),
s AS (SELECT p_type, count(*) AS n, count(*) FILTER (x AND (nw < 2 OR y)) AS named FROM k GROUP BY 1) SELECT *, CASE WHEN named * 2 < n THEN n ELSE named END AS kept FROM s""",
    "agg31_core_terms": """WITH p AS (SELECT p_partkey, p_brand, p_size, string_split(p_name, ' ') AS w FROM part), t AS (SELECT p_brand, p_size, count(*) AS total FROM p GROUP BY 1, 2),
u AS (SELECT DISTINCT p_partkey, p_brand, p_size, unnest(w) AS term FROM p) SELECT p_brand, p_size, term, count(*) AS n, any_value(total) AS total FROM u JOIN t USING (p_brand, p_size) GROUP BY 1, 2, 3 HAVING count(*) * 2 >= any_value(total)""",
}
QUERIES = {"str11_changes": query_changes, "scl10_public_url": query_public_url, "str08_relevance": query_relevance, "agg31_core_terms": query_core_terms}
