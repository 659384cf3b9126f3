import math

import pytest
from pyspark.sql import functions as F

from helixframe.llm import mixing as M
from helixframe.llm import queries
from tests.oracle import compare


def test_poisson_inverse(spark):
    us = [0.0, 0.1, 0.36, 0.37, 0.73, 0.74, 0.9999, 1 - 1e-15]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(M.poisson_count(F.col("u"), F.lit(1.0), 40)).collect()]

    def inverse(u):
        k, c = 0, math.exp(-1)
        while u >= c and k < 40:
            k += 1
            c += math.exp(-1) / math.factorial(k)
        return k

    assert got[:-1] == [inverse(u) for u in us[:-1]]
    assert 10 < got[-1] <= 40


def test_shares_come_to_the_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 6 < 4, "a").when(F.col("id") % 6 == 4, "b").otherwise(None).alias("source"), F.lit("t").alias("text"))
    n = {r.source: r.n for r in M.mix(docs, {"a": 1, "b": 3}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(n) == {"a", "b"}
    assert n["b"] / (n["a"] + n["b"]) == pytest.approx(0.75, abs=0.03)
    assert M.mix(docs, {}).count() == 0
    assert M.mix(docs.limit(0)).count() == 0


def test_rare_sources_come_to_the_weights_too(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 200 == 0, "b").otherwise("a").alias("source"), F.lit("t").alias("text"))
    for weights in (None, {"a": 1, "b": 3}):
        n = {r.source: r.n for r in M.mix(docs, weights).groupBy("source").agg(F.count("*").alias("n")).collect()}
        assert n["b"] / (n["a"] + n["b"]) == pytest.approx(0.5 if weights is None else 0.75, abs=0.02)
    one = docs.where("doc_id < 4000").withColumn("source", F.when(F.col("doc_id") == 7, "b").otherwise("a"))  # exp(-2000) is 0
    copies = [r.copy for r in M.mix(one).where("source = 'b'").collect()]
    assert len(copies) == pytest.approx(2000, abs=225) and sorted(copies) == list(range(1, len(copies) + 1))


@pytest.mark.parametrize("rate", [20.0, 50.0])
def test_counts_have_the_mean_and_variance_of_a_poisson_number(spark, rate):
    m, v = spark.range(20000).select(M.copies_of("s", F.col("id").cast("string"), F.lit(rate)).alias("n")).agg(F.avg("n"), F.variance("n")).first()
    assert m == pytest.approx(rate, rel=0.01) and v == pytest.approx(rate, rel=0.05)


def test_same_seed_same_mix_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "s", "t", 1, "r") for i in range(50)] + [(None, None, None, 2, None)], "doc_id long, source string, text string, copy int, rate string")
    a, b = ([tuple(r) for r in M.mix(docs).orderBy("shuffle_key").collect()] for _ in range(2))
    assert a == b
    assert M.mix(docs).columns == [*docs.columns, "copy_", "shuffle_key"]
    assert {r["copy"] for r in M.mix(docs).collect()} <= {1, 2} and {r.copy_ for r in M.mix(docs).collect()} >= {1, 2}


def test_one_null_id_is_dealt_over_partitions(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('s', id % 2) as source", "'t' as text")
    sizes = M.mix(docs).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in M.mix(docs).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert not sizes or max(sizes) < 0.5 * sum(sizes)


def test_salted_join_and_shares_by_characters(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('s', if(id % 3 = 0, 0, id % 7)) as source", "repeat('x', cast(1 + id % 5 as int)) as text")
    plain, salted = (sorted(tuple(r) for r in M.mix(docs, broadcast_rows=n).collect()) for n in (1000, 0))
    assert plain == salted and plain
    by = M.mix(docs, {"s0": 1, "s1": 3}, unit="chars").groupBy("source").agg(F.sum(F.length("text")).alias("n"))
    n = {r.source: r.n for r in by.collect()}
    assert set(n) == {"s0", "s1"} and n["s1"] / sum(n.values()) == pytest.approx(0.75, abs=0.05)


def test_query_equals_sql(spark):
    compare(queries.QUERIES["op5_mixing"](spark, "/root/testdata/sf0.001"), queries.ORACLE_SQL["op5_mixing"], "/root/testdata/sf0.001")


def test_sql_splits_large_rates_too(spark):
    import duckdb

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 500 == 0, "rare").otherwise("much").alias("source"), F.lit("t").alias("text"))
    assert max(r.rate for r in M.rates(docs).collect()) > 5 * M.MOST_RATE
    t = docs.toPandas()  # noqa: F841  (read by name)
    want = duckdb.sql(M.mixed_sql("t", "doc_id, source, copy, shuffle_key")).fetchall()
    got = [tuple(r) for r in M.mix(docs).select("doc_id", "source", "copy", "shuffle_key").collect()]
    assert sorted(got) == sorted(want) and len(got) > 2000


def test_empty_table_and_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "s", "x" * 3_000_000), (2, "s", None)], "doc_id long, source string, text string")
    assert {len(r.text) for r in M.mix(docs).collect() if r.text} <= {3_000_000}
    assert M.mix(docs.limit(0)).collect() == []
