"""Mixing sources to target weights by Poisson replication.

Each source has a target weight; its repetition rate is the target share of the corpus over the
share it has now (measured in documents or characters). A document's count is the inverse of the
Poisson distribution with that mean at a number in [0, 1) made from the md5 of its id, so equal
seeds give equal mixes on any cluster; it is repeated by its count, and all copies are dealt
over the partitions by the md5 of (seed, id, copy) and sorted by it: a global shuffle. Rates have
no upper limit: one above MOST_RATE is split evenly into draws of that mean or less, each with an
md5 of its own, and the count is their sum, which is Poisson with the whole rate. Where ids repeat or are
null, the row's number decides which partition its copies go to, so one id never fills one task.

Null sources are one source of their own (named by ''), null texts have no characters, null ids
count as ''. Rows that share a doc_id get the same count. Sources that are absent from `weights`
get weight 0 and their documents none; with no weights given, all sources weigh the same. An
empty table stays empty. Extra columns are carried along; `copy` and `shuffle_key` are added, with
underscores at the end where the input has columns so named.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import BROADCAST_ROWS, fresh, read_table

SEED = "mix-1"
MOST_RATE = 20.0  #: the largest mean of one Poisson draw; a larger rate takes several


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", unit: str = "docs") -> DataFrame:
    """(_source, rate): target share over present share."""
    amount = F.count("*").cast("double") if unit == "docs" else F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double")
    by = docs.groupBy(F.coalesce(source, F.lit("")).alias("_source")).agg(amount.alias("_amount"))
    if weights is None:
        by = by.withColumn("_w", F.lit(1.0))
    else:
        pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
        by = by.withColumn("_w", F.coalesce(F.create_map(*pairs)[F.col("_source")], F.lit(0.0)) if pairs else F.lit(0.0))
    total = by.agg(F.sum("_amount").alias("_all"), F.sum("_w").alias("_weights"))
    rate = F.when((F.col("_amount") > 0) & (F.col("_weights") > 0), F.col("_w") * F.col("_all") / (F.col("_weights") * F.col("_amount"))).otherwise(0.0)
    return by.join(F.broadcast(total)).select("_source", F.round(rate, 9).alias("rate"))


def most_copies(most: float = MOST_RATE) -> int:
    """A count that a Poisson number of mean `most` exceeds with probability under 1e-12."""
    return math.ceil(most + 9 * math.sqrt(most) + 12)


def unit_hash(*parts: F.Column) -> F.Column:
    """The first 52 bits of an md5, as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(u: F.Column, rate: F.Column, most: int) -> F.Column:
    """Smallest k with u < P(X <= k): the terms are added up one after the other, all in the JVM."""
    term = F.exp(-rate)
    start = F.struct(F.lit(0).alias("k"), term.alias("t"), term.alias("c"))

    def step(acc, k):
        t = acc["t"] * rate / k
        return F.when(u < acc["c"], acc).otherwise(F.struct(k.alias("k"), t.alias("t"), (acc["c"] + t).alias("c")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["k"]


def copies_of(seed: str, ids: F.Column, rate: F.Column, most: float = MOST_RATE) -> F.Column:
    """Poisson number of mean `rate`: one draw up to `most`, else the sum of equal draws of `most` or less."""
    last = most_copies(most)
    parts = F.ceil(rate / F.lit(most)).cast("int")
    draw = lambda j: poisson_count(unit_hash(F.lit(seed), F.lit("draw"), j.cast("string"), ids), rate / parts, last)
    several = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, j: n + draw(j))
    return F.when(rate <= most, poisson_count(unit_hash(F.lit(seed), ids), rate, last)).otherwise(several)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: str = SEED, source: str = "source", unit: str = "docs", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`docs` repeated by their counts, with `copy` (from 1) and `shuffle_key`, dealt globally by that key."""
    name, at, salt, n, row, copy, key = (fresh(docs, x) for x in ("_source", "_rate", "_salt", "_n", "_row", "copy", "shuffle_key"))
    rate = rates(docs, weights, source, unit).toDF(name, at)
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = docs.withColumn(name, F.coalesce(source, F.lit("")))
    if rate.count() <= broadcast_rows:
        keyed = keyed.join(F.broadcast(rate), name)
    else:  # more sources than a task should hold: the hot ones are salted, both sides alike
        salts = 64
        keyed = keyed.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        keyed = keyed.join(rate.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))), [name, salt]).drop(salt)
    counted = keyed.withColumn(n, copies_of(seed, ids, F.col(at))).where(F.col(n) > 0).withColumn(row, F.monotonically_increasing_id())
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n, name, at)
    dealt = copies.withColumn(key, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), ids, F.col(copy).cast("string"))))
    return dealt.repartition(key, row).sortWithinPartitions(key, row).drop(row)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy", "shuffle_key", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's mix: sources are brought to equal weights, copies are numbered by `copy`."""
    return mix(docs)


def mixed_sql(table: str, columns: str = "doc_id, source, copy, shuffle_key, text") -> str:
    """DuckDB SQL of `mix` with its defaults over `table`."""
    return f"""
WITH RECURSIVE d AS (SELECT *, coalesce(source, '') AS _s, coalesce(CAST(doc_id AS VARCHAR), '') AS _id, row_number() OVER () AS _row FROM {table}),
a AS (SELECT _s, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY _s),
q AS (SELECT _s, round(1e0 * (SELECT sum(n) FROM a) / (CAST((SELECT count(*) FROM a) AS DOUBLE) * n), 9) AS rate FROM a),
r AS (SELECT _s, rate, greatest(1, CAST(ceil(rate / {MOST_RATE}e0) AS BIGINT)) AS parts FROM q),
p AS (SELECT _s, rate / parts AS mean, 0 AS k, exp(-(rate / parts)) AS t, exp(-(rate / parts)) AS c FROM r
      UNION ALL SELECT _s, mean, k + 1, t * mean / (k + 1), c + t * mean / (k + 1) FROM p WHERE k < {most_copies()}),
j AS (SELECT _row, d._s, _id, parts, unnest(range(1, parts + 1)) AS part FROM d JOIN r ON r._s = d._s),
u AS (SELECT *, CAST(CAST('0x' || substr(md5('{SEED}:' || CASE WHEN parts = 1 THEN '' ELSE 'draw:' || part || ':' END || _id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0 AS _u FROM j),
c AS (SELECT _row, sum(least((SELECT count(*) FROM p WHERE p._s = u._s AND p.c <= u._u), {most_copies()})) AS _n FROM u GROUP BY _row),
x AS (SELECT d.*, unnest(range(1, CAST(_n AS BIGINT) + 1)) AS _copy FROM d JOIN c ON c._row = d._row WHERE _n > 0)
SELECT {columns} FROM (SELECT *, CAST(_copy AS INTEGER) AS copy, md5('{SEED}:order:' || _id || ':' || CAST(_copy AS VARCHAR)) AS shuffle_key FROM x)
"""


ORACLE = mixed_sql("documents")
