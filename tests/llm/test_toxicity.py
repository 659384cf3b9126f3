import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.llm import toxicity as T
from helixframe.llm.common import read_table


def test_grammar_scores_clauses_not_words():
    g = T.Grammar({"idiot": 3.0, "^vequ": 4.0})
    plain, aimed = g.clause("an idiot".split()), g.clause("you are an idiot".split())
    denied, reported = g.clause("not an idiot".split()), g.clause("he said idiot".split())
    assert aimed > plain > reported > denied > 0
    assert g.clause("vequance".split()) == 4.0
    assert g.clause("kill you".split()) > 0 and g.clause("kill time".split()) == 0
    assert g.features("") == (0.0, 0.0, 0.0) and g.features("All is well. Not at all!") == (0.0, 0.0, 0.0)


def all_paths(grammar, words):
    """The heaviest of all readings of a clause, each machine stepped on its own."""
    best = 0.0
    for path in itertools.product(*(grammar.readings(w) for w in words)):
        total, states = 0.0, [0] * len(T.MACHINES)
        for symbol, weight in path:
            ways = [m.arcs[q, symbol] for m, q in zip(T.MACHINES, states, strict=True)]
            assert all(len(w) == 1 for w in ways)
            states = [w[0][0] for w in ways]
            total += math.prod(w[0][1] for w in ways) * (weight + sum(w[0][2] for w in ways))
        best = max(best, total)
    return best


def test_best_path_equals_enumeration_of_all_paths():
    g = T.Grammar({"idiot": 3.0, "^vequ": 4.0, "kill": 1.0, "^kil": 0.5, "burn": 6.0, "fool": 0.3})
    r = random.Random(2)
    words = ["idiot", "vequance", "kill", "killer", "burn", "fool", "you", "them", "not", "said", "plain", "other", "hurt"]
    for _ in range(2000):
        clause = r.choices(words, k=r.randint(0, 9))
        assert g.clause(clause) == pytest.approx(all_paths(g, clause)), clause
    assert len({q for q, _ in g.arcs}) > 50 and all(len(v) == 1 for v in g.arcs.values())


def test_machines_one_by_one():
    g = T.Grammar({"idiot": 4.0})
    assert g.clause(["idiot"]) == 4.0 and g.clause(["idiot", "you"]) == 4.5 and g.clause(["you", "a", "b", "idiot"]) == 5.0 and g.clause(["you", "a", "b", "c", "idiot"]) == 4.0
    assert g.clause("kill a b c you".split()) == 2.0 and g.clause("kill a b c d you".split()) == 0.0
    assert g.clause("not idiot".split()) == 1.0 and g.clause("not a b c idiot".split()) == 4.0
    assert g.clause("he said kill you".split()) == 1.0


def test_learns_words_and_beginnings(spark):
    rows = [(i, f"some words zlor{'abcdefgh'[i % 8]}x stand{i} here" if i % 4 == 0 else f"some other words stand{i} here") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    out = T.Model.train(docs, labels).score(docs).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in out)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "you idiot, you scum", "y"), (None, "hello", "z")], "doc_id long, text string, lang string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = T.Model.train(docs, empty).score(docs).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert sorted(r.score for r in got)[-1] > 0.5 and sum(r.score < 0.5 for r in got) == 3
    assert T.Model.train(docs.limit(0), empty).score(docs.limit(0)).count() == 0
    assert [r[0] for r in docs.select(T.held_out()).collect()].count(None) == 0


def test_clashing_columns_and_very_long_texts(spark):
    long = "plain words of no interest. " * 40_000
    docs = spark.createDataFrame([(1, long, 5, 1), (2, long + "you idiot, you scum", 6, 2)], "doc_id long, text string, score int, toxic int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.Model.train(docs, labels).score(docs).collect()}
    assert got[1].score < 0.5 < got[2].score and (got[1].toxic, got[2].toxic) == (1, 2)
    assert T.Model.train(docs, labels).score(docs, score="s").columns == [*docs.columns, "s"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = T.op6_toxicity(spark, sf).join(read_table(spark, sf, "labels"), "doc_id").where("held_out")
    n, right, flagged, caught, toxic = out.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("toxic")), F.count_if(F.col("predicted") == 1), F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)), F.sum("toxic")).first()
    assert right / n >= 0.97 and caught / toxic >= 0.9 and caught / flagged >= 0.9


def test_only_equal_sets_of_words_are_copies(spark):
    # All texts share their rarest hash: nothing but the copies may collapse.
    rows = [(i, f"common zlorn word{i} text" if i < 40 else f"common plain word{i} text") for i in range(240)] + [(1000 + i, "common onlyhere copied text") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = docs.select("text", ((F.col("doc_id") < 40) | (F.col("doc_id") >= 1000)).cast("int").alias("toxic"))
    weights = T.learn_arcs(sample)
    assert weights["zlorn"] > 3 and "onlyhere" not in weights  # 40 copies are one document, 40 texts are forty
    counted = sample.mapInPandas(T._with_words, "text string, toxic int, words string").groupBy("toxic", "words").count().groupBy("toxic").count().collect()
    assert {r.toxic: r["count"] for r in counted} == {0: 200, 1: 41}


def test_threatening_words_are_learned_before_targets(spark):
    rows = [(i, f"ich werde plain{i} zerstoere dich heute" if i < 60 else f"ich zerstoere plain{i} den text und dich") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = T.learn_arcs(docs.select("text", (F.col("doc_id") < 60).cast("int").alias("toxic")))
    g = T.Grammar(weights)
    assert T.BEFORE + "zerstoere" in weights and g.clause("zerstoere euch".split()) == 2.0 and g.clause("zerstoere text".split()) == 0.0
    assert T.before_targets("a b c d e dich".split()) == set("bcde") and T.before_targets("not dich".split()) == set()
