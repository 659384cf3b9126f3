"""Line dedup by overlapping three-line windows.

A text's lines are its parts between line feeds, compared exactly. Each run of three
consecutive lines is a window, known by two 64-bit hashes. Of all equal windows in the corpus the one
with the smallest (doc_id, position) is the first occurrence; lines covered by any later
occurrence are removed, overlapping windows being merged by taking the union of their positions.

Null texts and texts of fewer than three lines have no window and stay as they are. Rows that
share a doc_id are told apart by a hash of their text; rows equal in both stand or fall
together, as one document; rows with a null doc_id are compared like others (they come first), but
never shortened. Empty lines count as lines. Other columns are carried along; `text` and columns that
have the names of the two counts are replaced.
Windows are sorted by their hashes and compared with their neighbours, so a window in a third of all
documents is spread over many tasks; positions are gathered per document, which is one row anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, fresh, read_table, sorted_groups

WINDOW = 3
NO_ID = -(1 << 63)  #: stands for a null doc_id in comparisons


def windows(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, _t, pos, k1, k2): every run of k lines, with two hashes of it."""
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("_t"), F.split("text", "\n").alias("_l")).where(F.size("_l") >= k)
    part = lambda i: F.slice("_l", i, k)
    keys = F.transform(F.sequence(F.lit(1), F.size("_l") - (k - 1)), lambda i: F.struct(F.xxhash64(part(i)).alias("k1"), F.xxhash64(F.lit(1), part(i)).alias("k2")))
    return lines.select("doc_id", "_t", F.posexplode(keys).alias("pos", "key")).select("doc_id", "_t", F.col("pos").cast("long").alias("pos"), "key.k1", "key.k2")


def covered(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(doc_id, _t, _cut): sorted 1-based positions of the lines that later occurrences cover."""
    order = ["doc_id", "_t", "pos"]
    w = sorted_groups(Scratch(docs.sparkSession, "lines"), windows(docs, k), ["k1", "k2"], order, "windows")
    later = w.where("repeated").where(F.struct(*order) != F.struct(*(f"first_{c}" for c in order))).where(F.col("doc_id") != NO_ID)
    spans = later.select("doc_id", "_t", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + k)).alias("_at"))
    return spans.groupBy("doc_id", "_t").agg(F.sort_array(F.collect_set(F.col("_at").cast("int"))).alias("_cut"))


def line_dedup(docs: DataFrame, k: int = WINDOW, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """`docs` with `text` shortened, plus the numbers of lines and of removed lines (both 0 for a null text)."""
    t, gone = fresh(docs, "_t"), fresh(docs, "_cut")
    cut = covered(docs, k).select(F.col("doc_id").alias(fresh(docs, "_id")), F.col("_t").alias(f"{t}2"), F.col("_cut").alias(gone))
    keyed = docs.withColumn(t, F.xxhash64("text"))
    joined = keyed.join(cut, (F.col("doc_id") == F.col(fresh(docs, "_id"))) & (F.col(t) == F.col(f"{t}2")), "left")
    lines = F.split("text", "\n")
    places = F.array_except(F.sequence(F.lit(1), F.size(lines)), gone)  # by hashing, so in time linear in a text's lines
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i - 1)), "\n")
    out = joined.withColumns(
        {
            n_lines: F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
            n_removed: F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"),
            "text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept),
        }
    )
    return out.drop(t, f"{t}2", gone, fresh(docs, "_id"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shortens texts; documents of which no line is left are copies of earlier ones and go."""
    names, lines, removed = docs.columns, fresh(docs, "_lines"), fresh(docs, "_removed")
    out = line_dedup(docs, n_lines=lines, n_removed=removed)
    out = out.where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*names)


ORACLE = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i AS pos, md5(concat_ws(chr(10), lines[i], lines[i+1], lines[i+2])) AS key
      FROM l, LATERAL unnest(range(1, len(lines) - 1)) AS t(i) WHERE len(lines) >= 3),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS rn FROM w),
c AS (SELECT DISTINCT doc_id, pos + d AS ln FROM f, (VALUES (0), (1), (2)) AS v(d) WHERE rn > 1),
a AS (SELECT doc_id, list(ln) AS cut FROM c GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(len(a.cut), 0) AS n_removed,
       CASE WHEN a.cut IS NULL THEN d.text
            ELSE coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(a.cut, i)), chr(10)), '') END AS text
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""
