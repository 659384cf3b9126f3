"""Phrases with negation and drug names, on planted texts and against a plain search."""

import random
import re

from pyspark.sql import functions as F

from helixframe.operators import phrases


def hits(spark, texts, words):
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    d = spark.createDataFrame([(w,) for w in words], "phrase string")
    return {(r.id, r.clause, r.at, r.phrase, r.negated) for r in phrases.phrase_hits(t, d).collect()}


def test_longest_first_left_to_right_and_negation(spark):
    found = hits(spark, ["My son walked late. No speech delay, walked late", "walked late walked", "without fever but seizures; fever", "Not walking", "late late walked late", None, ""], ["walked", "Walked  late", "late walked", "speech delay", "fever", "seizures", "not walking", "absent phrase"])
    assert found == {
        (0, 0, 2, "walked late", False), (0, 1, 1, "speech delay", True), (0, 2, 0, "walked late", False), (1, 0, 0, "walked late", False), (1, 0, 2, "walked", False),
        (2, 0, 1, "fever", True), (2, 0, 3, "seizures", False), (2, 1, 0, "fever", False), (3, 0, 0, "not walking", False), (4, 0, 1, "late walked", False),
    }


def test_equals_a_plain_search(spark):
    random.seed(3)
    texts = [" ".join(random.choices(["a", "b", "c", "no", "but", "d.", "e,"], k=random.randint(0, 30))) for _ in range(150)]
    words = {" ".join(random.choices("abcde", k=random.randint(1, 4))) for _ in range(40)}
    want = set()
    for i, t in enumerate(texts):
        for c, part in enumerate(re.split(r"[.,;:!?\n]", t)):
            w, at, negated = re.findall(r"\w+", part), 0, False
            while at < len(w):
                n = next((n for n in (4, 3, 2, 1) if at + n <= len(w) and " ".join(w[at : at + n]) in words), 0)
                if n:
                    want.add((i, c, at, " ".join(w[at : at + n]), negated))
                for x in w[at : at + max(n, 1)]:
                    negated = True if x == "no" else False if x == "but" else negated
                at += max(n, 1)
    assert hits(spark, texts, words) == want and len(want) > 300


def test_plan_compares_no_text_with_all_phrases(spark):
    t, d = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([("a",)], "phrase string")
    for df in (phrases.phrase_hits(t, d), phrases.drug_mentions(t, d.select(F.lit(1).alias("drug"), F.col("phrase").alias("name")))):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_drug_keys(spark):
    names = ["Imatinib Mesylate Tablets 400 mg", "IMATINIB", "sodium phenylbutyrate", "Sodium chloride injection", "Folic acid", "Acid", "Factor VIII (human)", "nusinersen 12 mg/5 ml solution", "", None]
    found = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").coalesce(1).select(phrases.drug_key(F.col("n"))).collect()]
    assert found == ["imatinib", "imatinib", "phenylbutyrate", None, "folic acid", None, "factor viii", "nusinersen", None, None]


def test_drug_mentions_on_borders_and_across_salts(spark):
    texts = ["Treated with imatinib mesylate.", "imatinibum only", "Folic, acid", "folic ACID 5 mg", "Nusinersen sodium given; imatinib", "chloride", None]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    d = spark.createDataFrame([(1, "Imatinib hydrochloride"), (2, "Folic acid tablets"), (3, "nusinersen"), (4, "sodium chloride")], "drug long, name string")
    assert {(r.id, r.drug) for r in phrases.drug_mentions(t, d).collect()} == {(0, 1), (3, 2), (4, 3), (4, 1)}


def test_words_of_drugs_take_no_texts_along(spark, monkeypatch):
    from pyspark.sql import functions as F

    from helixframe.operators import phrases

    seen = []
    monkeypatch.setattr(phrases, "_narrow", lambda t: t)
    texts = spark.createDataFrame([(1, "given alpha beta gamma and more words of a long text, alpha sulfate")], "id long, text string")
    drugs = spark.createDataFrame([(7, "Alphazol"), (8, "Gamma Delta"), (9, "beta gamma")], "drug long, name string")
    df = phrases.drug_mentions(texts, drugs)
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        seen += [line] if "SortMergeJoin [word" in line else []
    joined = df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner, (word")[1]
    assert seen and "slice(words" in joined  # cut before the join
    assert [tuple(r) for r in df.collect()] == [(1, 9, "beta gamma")]


def test_hits_are_made_where_the_text_lies(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(phrases, "CHARS", 20)
    t = spark.createDataFrame([(1, "no fever but late walked late"), (None, "walked late. Fever"), (3, "walked"), (4, None)], "id long, text string")
    d = spark.createDataFrame([(w,) for w in ["fever", "fever", "walked", "walked", "walked late", "late walked"]], "phrase string")
    df = phrases.phrase_hits(t, d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "hashpartitioning(word" not in plan  # neither words nor hits are shuffled
    found = {(r.id, r.clause, r.at, r.phrase, r.negated) for r in df.collect()}
    assert found == {(1, 0, 1, "fever", True), (1, 0, 3, "late walked", False), (None, 0, 0, "walked late", False), (None, 1, 0, "fever", False), (3, 0, 0, "walked", False)}


def test_rare_phrases_equal_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(phrases, "BITS", 64)
    test_equals_a_plain_search(spark)
