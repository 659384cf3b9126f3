"""Phrases of a dictionary in running text, the longest first, with negation; names of drugs in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans import projections as P
from helixframe.sources.scratch import keep

BROADCAST_ROWS = 500_000  #: of a dictionary of more phrases the rest is shuffled
BITS = 1 << 26  #: bits of the bitmap of that rest
CHARS = 4_000_000  #: characters of text that a task takes
#: words that negate what comes after them in their clause
NEGATIONS = ("no", "not", "never", "without", "denies", "cannot", "nicht", "kein", "keine", "ohne", "ne", "pas", "sans", "sin", "nunca")
#: words that end the scope of a negation before the clause does
TURNS = ("but", "aber", "mais", "pero")


def clauses(texts: DataFrame) -> DataFrame:
    """(id, clause, words) of (id, text): lower-case words of letters and digits, clauses between punctuation marks and line ends; other columns stay."""
    kept = [c for c in texts.columns if c != "text"]
    parts = texts.select(*kept, F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[.,;:!?\n]")).alias("clause", "part"))
    return parts.select(*kept, "clause", F.regexp_extract_all(F.lower("part"), F.lit(r"[\p{L}\p{N}']+"), F.lit(0)).alias("words")).where(F.size("words") > 0)


def _narrow(t: DataFrame) -> DataFrame:
    return F.broadcast(t) if t.count() <= BROADCAST_ROWS else t


def _runs(texts: DataFrame, first: DataFrame, negations: tuple[str, ...], turns: tuple[str, ...]) -> DataFrame:
    """(home, id, clause, at, n, phrase, negated, ...): the runs of words that may be phrases, one row each.

    Negating and turning words of a clause are few; a word asks the last of them before it, and takes along as many words as it begins.
    """
    kept = [c for c in texts.columns if c != "text"]
    flag = lambda w, i: F.struct(i.alias("i"), F.when(w.isin(*negations), 1).when(w.isin(*turns), -1).otherwise(0).alias("s"))
    marked = clauses(texts).withColumn("marks", F.filter(F.transform("words", flag), lambda m: m["s"] != 0))
    longest = first.agg(F.max(F.array_max("lengths"))).first()[0] or 1
    own = lambda w, i: F.struct(
        i.alias("at"), w.alias("word"), F.slice("words", i + 1, F.lit(longest)).alias("run"),
        F.when(F.size("marks") > 0, F.coalesce(F.get(F.reverse(F.filter("marks", lambda m: m["i"] < i)), 0)["s"] == 1, F.lit(False))).otherwise(False).alias("negated"),
    )
    begins = marked.select(*kept, "clause", F.explode(F.transform("words", own)).alias("w")).select(*kept, "clause", "w.*").join(_narrow(first), "word")
    runs = begins.select(*kept, "clause", "at", F.explode("lengths").alias("n"), "run", "negated").where(F.col("n") <= F.size("run"))
    return runs.select(*kept, "clause", "at", "n", F.array_join(F.slice("run", F.lit(1), F.col("n")), " ").alias("phrase"), "negated")


def _sieve(runs: DataFrame, phrases: DataFrame) -> DataFrame:
    """The runs whose hash is that of a phrase, by a bitmap of BITS bits: at most BITS / 64 rows are broadcast, whatever the dictionary."""
    h = F.pmod(F.xxhash64("phrase"), F.lit(BITS))
    bitmap = phrases.select(h.alias("h")).groupBy(F.expr("h DIV 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, CAST(h % 64 AS INT)))").alias("bits"))
    met = runs.withColumn("h", h).withColumn("cell", F.expr("h DIV 64")).join(F.broadcast(bitmap), "cell")
    return met.where(F.expr("shiftright(bits, CAST(h % 64 AS INT)) & 1 = 1")).drop("h", "cell", "bits")


def _hits(texts: DataFrame, dictionary: DataFrame, negations: tuple[str, ...], turns: tuple[str, ...]) -> DataFrame:
    """`phrase_hits` with `home`, the hash of the id that rows are dealt to tasks by.

    The text is the only thing that is shuffled in full: its words, runs and hits are made, judged and put in order where it lies.
    The BROADCAST_ROWS phrases that most rows of the dictionary name are sent to the tasks. Runs that may be one of the others, by a bitmap, are
    looked up in a join, once for each text, and what is found goes back to it.
    """
    phrases = keep(dictionary.select(F.array_join(F.regexp_extract_all(F.lower("phrase"), F.lit(r"[\p{L}\p{N}']+"), F.lit(0)), " ").alias("phrase")).where("phrase <> ''").groupBy("phrase").agg(F.count("*").alias("told")), "phrases")
    first = keep(phrases.groupBy(F.substring_index("phrase", " ", 1).alias("word")).agg(F.collect_set(F.size(F.split("phrase", " "))).alias("lengths")), "first")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    part = 1 + chars // CHARS
    homes = texts.select("id", "text", F.xxhash64("id").alias("home")).repartition(part, "home")
    if phrases.count() <= BROADCAST_ROWS:
        hits = _runs(homes, first, negations, turns).join(F.broadcast(phrases.select("phrase")), "phrase")
    else:
        frequent = keep(phrases.orderBy(F.desc("told"), "phrase").limit(BROADCAST_ROWS).select("phrase"), "frequent")
        rare = keep(phrases.select("phrase").join(F.broadcast(frequent), "phrase", "left_anti"), "rare")
        asked = _sieve(_runs(homes, first, negations, turns).select("home", "phrase"), rare).groupBy("home", "phrase").agg(F.lit(1).alias("one"))
        told = asked.join(rare, "phrase", "left_semi").repartition(part, "home").groupBy("home").agg(F.collect_set("phrase").alias("rare"))
        runs = _runs(homes.join(told, "home", "left"), first, negations, turns)
        runs = runs.join(F.broadcast(frequent.withColumn("sent", F.lit(True))), "phrase", "left")
        hits = runs.where(F.coalesce("sent", F.array_contains("rare", F.col("phrase")), F.lit(False))).drop("sent", "rare")
    hit = F.struct("at", (-F.col("n")).alias("less"), "n", "phrase", "negated")
    rows = hits.groupBy("home", "id", "clause").agg(F.sort_array(F.collect_list(hit)).alias("hits"))  # as many as a clause's words and their lengths
    # The end of what stands so far is carried along; a hit stands if it begins at or after it.
    none = F.slice("hits", 1, 0)
    start = F.struct(F.lit(0).alias("end"), none.alias("kept"))

    def step(acc: Column, h: Column) -> Column:
        free = h["at"] >= acc["end"]
        return F.when(free, F.struct((h["at"] + h["n"]).alias("end"), F.concat(acc["kept"], F.array(h)).alias("kept"))).otherwise(acc)

    kept = rows.select("home", "id", "clause", F.explode(F.aggregate("hits", start, step)["kept"]).alias("h"))
    return kept.select("home", "id", "clause", "h.at", "h.n", "h.phrase", "h.negated")


def phrase_hits(texts: DataFrame, dictionary: DataFrame, negations: tuple[str, ...] = NEGATIONS, turns: tuple[str, ...] = TURNS) -> DataFrame:
    """(id, clause, at, n, phrase, negated) of the phrases of `dictionary` (phrase) in (id, text).

    At each word the longest phrase that begins there stands, from left to right, and words it covers begin no other. It is
    negated if a negating word stands before it in its clause with no turn between. Only words that begin some phrase
    make candidates, each joined with the dictionary as a run of as many words as phrases with that beginning have.
    """
    return _hits(texts, dictionary, negations, turns).drop("home")


# --- drugs -------------------------------------------------------------------------------------------------------

# Salts and forms that don't make another drug.
SALTS = "hydrochloride hydrobromide sodium potassium calcium magnesium sulfate sulphate phosphate acetate citrate tartrate maleate fumarate mesylate besylate tosylate succinate nitrate bromide chloride lactate malate".split()
FORMS = "tablet tablets capsule capsules injection injectable solution suspension oral for of in film-coated coated extended-release prolonged-release powder concentrate infusion vial kit".split()
COMMON = ("acid", "factor", "human", "vitamin", "alpha", "beta", "combination")  #: words that name no drug by themselves


def drug_key(name: Column) -> Column:
    """The moiety of a drug's name: lower-case words without salts, forms, strengths and what is in brackets, in order; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\([^)]*\)|\b[0-9][0-9.,]*\s*(?:mg|g|mcg|ml|iu|%)?(?:/[0-9.]*\s*[a-z]+)?", " ")
    words = F.filter(F.regexp_extract_all(bare, F.lit(r"[\p{L}][\p{L}\p{N}-]*"), F.lit(0)), lambda w: ~w.isin(*SALTS, *FORMS))
    words = F.when(F.size(words) > 1, words).otherwise(F.filter(words, lambda w: ~w.isin(*COMMON) & (F.length(w) > 3)))
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def drug_mentions(texts: DataFrame, drugs: DataFrame) -> DataFrame:
    """(id, drug, name) of `drugs` (drug, name) named in (id, text), on word borders and whatever the salt or form.

    A text is read like a name, salts and forms left out, so its runs of words can be joined with the moieties: an
    equi-join on as many words as they have, no comparison of every text with every drug.
    """
    keys = drugs.select("drug", "name", drug_key(F.col("name")).alias("phrase")).where("phrase IS NOT NULL")
    drop = lambda w: w.isin(*SALTS, *FORMS)
    read = texts.select("id", F.array_join(F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}][\p{L}\p{N}-]*|[.,;:!?\n]"), F.lit(0)), lambda w: ~drop(w)), " ").alias("words"))
    first = keys.groupBy(F.substring_index("phrase", " ", 1).alias("word")).agg(F.collect_set(F.size(F.split("phrase", " "))).alias("lengths"))
    words = read.select("id", F.split("words", " ").alias("words"))
    # A word takes along as many words as the longest moiety has, not its text.
    longest = keys.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    begins = words.select("id", "words", F.posexplode("words").alias("at", "word")).select("id", "word", F.slice("words", F.col("at") + 1, F.lit(longest)).alias("run"))
    begins = begins.join(_narrow(first), "word")
    runs = begins.select("id", F.explode("lengths").alias("n"), "run").where(F.col("n") <= F.size("run"))
    runs = runs.select("id", F.array_join(F.slice("run", F.lit(1), F.col("n")), " ").alias("phrase")).distinct()
    return runs.join(_narrow(keys), "phrase").select("id", "drug", "name")


# --- queries -----------------------------------------------------------------------------------------------------


def query_lay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each document (one to three, by its id) as a dictionary, looked for in all whole texts."""
    docs = P.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    begin = F.regexp_extract(F.lower("text"), r"^(?:[^\p{L}\p{N}']*+[\p{L}\p{N}']++){0,3}", 0)  # not all words of a text for its first
    head = F.slice(F.regexp_extract_all(begin, F.lit(r"[\p{L}\p{N}']+"), F.lit(0)), F.lit(1), (1 + F.pmod("id", F.lit(3))).cast("int"))
    hits = _hits(docs, docs.select(F.array_join(head, " ").alias("phrase")), NEGATIONS, TURNS)
    # A document's hits lie together, so they are counted there before phrases are shuffled.
    own = hits.groupBy("home", "id", "phrase").agg(F.count("*").alias("n"), F.count_if("negated").alias("negated"), F.sum("at").alias("places"))
    return own.groupBy("phrase").agg(F.sum("n").alias("n"), F.sum("negated").alias("negated"), F.count("id").alias("texts"), F.sum("places").cast("long").alias("places"))


def query_drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as drugs with salts, forms and strengths; line comments made of other lines' parts, half of them with another salt."""
    part, li = P.table(spark, sf_dir, "part"), P.table(spark, sf_dir, "lineitem")
    word = F.concat(F.lit("zyl"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "abcdefghij"))
    name = F.concat(F.initcap(word), F.when(F.col("p_partkey") % 3 == 0, " HYDROCHLORIDE").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), F.split("p_name", " ")[0], F.lit(" sodium (oral)"))).otherwise(" 10 mg tablets"))
    drugs = part.select(F.col("p_partkey").alias("drug"), name.alias("name"))
    told = F.concat(F.lit("zyl"), F.translate(F.col("l_partkey").cast("string"), "0123456789", "abcdefghij"))
    text = F.concat_ws(" ", F.lit("Given"), told, F.when((F.col("l_linenumber") % 2 == 0) | (F.col("l_linenumber") == 3), "sulfate").otherwise("and"), F.when(F.col("l_linenumber") == 3, "cold").otherwise("more,"), F.concat(told, F.lit("y")))
    texts = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(text)), ". ").alias("text"))
    return drug_mentions(texts, drugs).groupBy("drug").agg(F.count("*").alias("n"), F.min("id").alias("first"))


_WORDS = r"[\p{L}\p{N}'']+"
_NEG, _TURN = (", ".join(f"'{w}'" for w in x) for x in (NEGATIONS, TURNS))
SQL = {
    "str04_lay": rf"""WITH RECURSIVE w AS (SELECT doc_id AS id, text, regexp_extract_all(lower(text), '{_WORDS}') AS ws FROM documents),
d AS (SELECT DISTINCT array_to_string(ws[1:1 + id % 3], ' ') AS phrase FROM w WHERE len(ws) > 0),
d2 AS MATERIALIZED (SELECT phrase, len(string_split(phrase, ' ')) AS n FROM d WHERE phrase <> ''),
c AS (SELECT id, unnest(string_split_regex(coalesce(text, ''), '[.,;:!?\n]')) AS part, generate_subscripts(string_split_regex(coalesce(text, ''), '[.,;:!?\n]'), 1) AS clause FROM w),
k AS (SELECT id, clause, unnest(regexp_extract_all(lower(part), '{_WORDS}')) AS word, generate_subscripts(regexp_extract_all(lower(part), '{_WORDS}'), 1) AS i FROM c),
r3 AS (SELECT id, clause, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3, CASE WHEN word IN ({_NEG}) THEN 1 WHEN word IN ({_TURN}) THEN -1 END AS flag FROM k WINDOW o AS (PARTITION BY id, clause ORDER BY i)),
p AS (SELECT id, clause, i, word, word || ' ' || w2 AS two, word || ' ' || w2 || ' ' || w3 AS three, last_value(flag IGNORE NULLS) OVER (PARTITION BY id, clause ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM r3),
m AS (SELECT id, clause, i, s, 1 AS n, word AS phrase FROM p UNION ALL SELECT id, clause, i, s, 2, two FROM p UNION ALL SELECT id, clause, i, s, 3, three FROM p),
h AS (SELECT id, clause, i, any_value(s) AS s, max(n) AS n, arg_max(phrase, n) AS phrase FROM m JOIN d2 USING (phrase, n) GROUP BY 1, 2, 3),
x AS MATERIALIZED (SELECT a.id, a.clause, a.i, a.n, a.phrase, a.s, b.i AS after FROM h a ASOF LEFT JOIN h b ON a.id = b.id AND a.clause = b.clause AND b.i >= a.i + a.n),
v AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id, clause ORDER BY i) = 1
  UNION ALL SELECT x.* FROM v JOIN x ON x.id = v.id AND x.clause = v.clause AND x.i = v.after)
SELECT phrase, count(*) AS n, count(*) FILTER (s = 1) AS negated, count(DISTINCT id) AS texts, CAST(sum(i - 1) AS BIGINT) AS places FROM v GROUP BY 1""",
    # A drug of the second kind has two words, and is named only where both stand together.
    "jn18_drug_names": """WITH l AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS drug, l_linenumber AS ln FROM lineitem),
m AS (SELECT DISTINCT l.id, p_partkey AS drug FROM l JOIN part ON p_partkey = l.drug WHERE p_partkey % 3 <> 1 OR (ln = 3 AND split_part(p_name, ' ', 1) = 'cold'))
SELECT drug, count(*) AS n, min(id) AS first FROM m GROUP BY 1""",
}
QUERIES = {"str04_lay": query_lay, "jn18_drug_names": query_drugs}
