"""Domain rules on small planted inputs, with published or hand-made numbers."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from helixframe.functions import special
from helixframe.operators import acmg, consensus, genotype, intervals, ontology, statistics, text, triage
from helixframe.streaming import events


def one(df):
    return df.first()[0]


def test_king_hand_example_and_degrees(spark):
    df = spark.createDataFrame([(3, 2, 5, 4)], "hethet long, opposite long, het_a long, het_b long")
    assert one(df.select(genotype.king_robust())) == pytest.approx(-0.1875)
    phis = spark.createDataFrame([(x,) for x in (0.177, 0.354, 0.3541, 0.0884, 0.0442, 0.01)], "phi double")
    assert [r[0] for r in phis.select(genotype.degree(F.col("phi"))).collect()] == ["first", "first", "duplicate", "second", "third", "unrelated"]


def test_mendel_table_of_27(spark):
    rows = [(c, m, f) for c in range(3) for m in range(3) for f in range(3)]
    got = {(r.c, r.m, r.f): r.cls for r in genotype.with_classes(spark.createDataFrame(rows, "c int, m int, f int")).collect()}
    assert sum(v == "ok" for v in got.values()) == 15
    assert {k for k, v in got.items() if v == "pat_absent"} == {(2, 2, 0), (0, 0, 2), (2, 1, 0), (0, 1, 2)}
    assert {k for k, v in got.items() if v == "mat_absent"} == {(0, 2, 0), (2, 0, 2), (2, 0, 1), (0, 2, 1)}
    assert {k for k, v in got.items() if v == "de_novo_like"} == {(1, 0, 0), (2, 0, 0), (1, 2, 2), (0, 2, 2)}


def test_one_run_of_homozygosity_with_one_het(spark):
    sites = [(1, 1_000_000 + 100_000 * i, int((i % 2 == 0 and not 200 <= i < 400) or i == 300)) for i in range(600)]
    got = genotype.runs_of_homozygosity(spark.createDataFrame(sites, "chrom int, pos long, het int")).collect()
    assert len(got) == 1
    assert 19.5e6 <= got[0].end - got[0].start <= 20.8e6


def test_fisher_golden(spark):
    tables = spark.createDataFrame([("a", 3, 1, 1, 3), ("b", 8, 2, 1, 5), ("c", 0, 10, 5, 20)], "k string, a long, b long, c long, d long")
    got = {r.k: r for r in statistics.fisher(tables, "k").collect()}
    assert got["a"].p_two == pytest.approx(0.485714, abs=1e-6)
    assert got["b"].p_two == pytest.approx(0.034965, abs=1e-6)
    assert got["b"].p_greater == pytest.approx(0.024476, abs=1e-6)
    assert got["c"].p_two == pytest.approx(0.291505, abs=1e-6)


def test_tails():
    assert special.t_two_sided(2.3, 7) == pytest.approx(0.0549910952, abs=1e-8)
    assert math.erfc(math.sqrt(3.84 / 2)) == pytest.approx(0.0500435212, abs=1e-9)
    assert special.max_credible_af(1e-3, 1, 0.1, 0.5, False) == pytest.approx(1e-4)


def test_wilson(spark):
    low, high = genotype.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(5.0, 10.0), (0.0, 0.0)], "k double, n double").select(low, high).collect()
    assert (round(got[0][0], 4), round(got[0][1], 4)) == (0.2366, 0.7634)
    assert tuple(got[1]) == (None, None)


def test_kaplan_meier_by_hand(spark):
    data = spark.createDataFrame([("g", 1, 1), ("g", 2, 0), ("g", 3, 1), ("g", 3, 1)], "grp string, time int, event int")
    got = statistics.kaplan_meier(data).orderBy("time").collect()
    assert [(r.time, r.at_risk, r.events, r.survival) for r in got] == [(1, 4, 1, 0.75), (3, 2, 2, 0.0)]


def test_frequency_pooling_and_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c")], "child string, parent string")
    got = {(r.term, r.ancestor) for r in ontology.closure(edges).collect()}
    assert got == {(x, x) for x in "abcd"} | {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("d", "c")}


def test_overlap_join_finds_each_pair_once(spark):
    a = spark.createDataFrame([(1, "x", 10, 20000), (2, "x", 5, 9), (3, "y", 10, 20)], "i int, c string, s long, e long")
    b = spark.createDataFrame([(7, "x", 9, 10), (8, "x", 8000, 30000), (9, "y", 21, 30)], "j int, c string, s2 long, e2 long")
    got = sorted((r.i, r.j) for r in intervals.overlap_join(a, b, "c", ("s", "e"), ("s2", "e2")).collect())
    assert got == [(1, 7), (1, 8), (2, 7)]


def test_points_classes(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (10, 6, 5, 0, -1, -6, -7)], "p int").select(acmg.points_class(F.col("p"))).collect()]
    assert got == ["P", "LP", "VUS", "VUS", "LB", "LB", "B"]


def test_predictor_support(spark):
    df = spark.createDataFrame([(0.95, 0.6, 30.0, True), (0.7, 0.0, 0.0, False), (0.0, 0.0, 0.0, False)], "r double, s double, c double, a boolean")
    got = [r[0] for r in df.select(triage.predictor_support(*map(F.col, "rsca"))).collect()]
    assert got == [pytest.approx(0.9), 0.65, 0.0]


def test_consensus_needs_two_sources(spark):
    hits = spark.createDataFrame([("a", "x", 1), ("b", "x", 9), ("a", "y", 2), ("b", "y", 3), ("a", "z", 1)], "source string, key string, rank int")
    assert [(r.key, r.position) for r in consensus.consensus(hits).orderBy("position").collect()] == [("y", 1), ("x", 2)]


def test_snapshot_diff_is_null_safe(spark):
    b = spark.createDataFrame([(1, None), (2, "q"), (3, "r")], "k int, v string")
    n = spark.createDataFrame([(1, None), (2, None), (4, "s")], "k int, v string")
    assert {r.k: r.status for r in consensus.snapshot_diff(b, n, "k", ["v"]).collect()} == {1: "same", 2: "changed", 3: "gone", 4: "new"}


def test_labels_and_strands(spark):
    df = spark.createDataFrame([Row(s="Seizures, Focal-ISS ACGT")])
    assert one(df.select(text.normalise(F.col("s")))) == "seizure focal iss acgt"
    assert one(df.select(text.reverse_complement(F.lit("AACG")))) == "CGTT"


def test_stream_resumes_and_closes_windows(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    rows = lambda h: spark.sql(f"SELECT timestamp'2024-01-01 0{h}:10:00' ts, 'view' event_type, 1.5D value")
    rows(1).write.parquet(src)
    events.run_once(spark, src, out, chk)
    rows(5).write.mode("append").parquet(src)
    events.run_once(spark, src, out, chk)
    got = spark.read.parquet(out).collect()
    assert [(r.event_type, r.n, r.total) for r in got] == [("view", 1, 1.5)]


def test_log_gamma_against_the_standard_library(spark):
    from helixframe.functions.special import lgamma

    xs = [0.1, 0.5, 1.0, 2.0, 3.5, 10.0, 171.0, 1e4, 1e9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [*xs, 0.0]], "x double").select(lgamma(F.col("x"))).collect()]
    assert got[:-1] == pytest.approx([math.lgamma(x) for x in xs], rel=1e-11, abs=1e-11) and got[-1] is None


def test_poisson_tail_keeps_small_probabilities(spark):
    from helixframe.operators.statistics import poisson_upper

    rows = [(5, 1.2), (3, 1.0), (0, 4.0), (60, 2.0), (1000, 1000.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "k long, mu double").select(poisson_upper(F.col("k"), F.col("mu"))).collect()]
    want = [sum(math.exp(-mu + i * math.log(mu) - math.lgamma(i + 1)) for i in range(k, k + 600)) for k, mu in rows]
    assert got == pytest.approx(want, rel=1e-8) and 0 < got[3] < 1e-60
    assert got[0] == pytest.approx(0.0077457883, abs=1e-10)


def test_evidence_pairs_and_inheritance_classes(spark):
    from helixframe.operators import acmg, trio

    assert [acmg.weakened(*x) for x in ((2, 4), (1, 4), (4, 1), (2, 2), (1, 1), (4, 4))] == [(2, 2), (0, 4), (4, 0), (2, 2), (1, 1), (4, 0)]
    rows = [
        ("auto", "male", "het", "hom_ref", True, "hom_ref", True, "de_novo", "de_novo"), ("auto", "male", "het", "hom_ref", False, "hom_ref", True, "possible_de_novo", None),
        ("auto", None, "het", "het", False, "hom_ref", True, "inherited_het", "maternal"), ("auto", None, "hom_alt", "het", False, "het", False, "hom_recessive", "biparental"),
        ("x_nonpar", "male", "hom_alt", "het", False, "hom_ref", True, "x_hemizygous", "maternal"), ("x_nonpar", None, "hom_alt", "het", False, "het", False, "hom_recessive", None),
        ("mt", None, "hom_alt", "hom_alt", False, None, None, "mitochondrial", "maternal"), ("auto", None, "het", None, None, None, None, "het", None), ("auto", None, "hom_alt", None, None, None, None, "hom", None),
        ("auto", None, "het", "hom_ref", True, None, None, "het", None), ("y", "male", "hemi", None, None, "hemi", False, "y_hemizygous", "paternal"),
    ]
    df = spark.createDataFrame(rows, "ctype string, sex string, z string, mz string, m_ok boolean, fz string, f_ok boolean, cls string, origin string")
    cls, origin = trio.inheritance(*(F.col(c) for c in ("ctype", "sex", "z", "mz", "m_ok", "fz", "f_ok")))
    for r in df.select("*", cls.alias("c"), origin.alias("o")).collect():
        assert (r.c, r.o) == (r.cls, r.origin), r
