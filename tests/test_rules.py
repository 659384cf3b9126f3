"""Rules of annotation, copy numbers, identifiers and spellings on small planted rows."""

import random

from pyspark.sql import functions as F

from helixframe.operators import annotation, names, records, resolve, structural


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr.alias("v")).collect()]


def test_copies_by_chromosome_and_sex(spark):
    rows = [
        ("1", 1, 1, None, False), ("1", 2, 2, "male", False), ("1", 2, 3, None, False), ("1", 1, 3, None, False),
        ("X", 1, 1, "male", False), ("X", 1, 1, "female", False), ("X", 2, 2, None, False), ("X", 3, 3, None, False), ("X", 1, 1, "male", True),
        ("Y", 1, 1, "female", False), ("MT", 0, 0, None, False),
    ]
    found = values(spark, rows, "chrom string, low int, high int, sex string, par boolean", structural.copies_type(*map(F.col, ("chrom", "low", "high", "sex", "par"))))
    assert found == ["loss", "unknown", "gain", "unknown", "unknown", "loss", "unknown", "gain", "loss", "unknown", "unknown"]


def test_gene_bands_at_their_edges(spark):
    n = [(x,) for x in (24, 25, 34, 35, 49, 50)]
    assert values(spark, n, "n int", structural.gene_band("loss", F.col("n"))) == ["3A", "3B", "3B", "3C", "3C", "3C"]
    assert values(spark, n, "n int", structural.gene_band("gain", F.col("n"))) == ["3A", "3A", "3A", "3B", "3B", "3C"]


def test_identifier_shapes(spark):
    raw = [("hp:0001250",), ("NCT04006210",), (" ORPHA : 33069 ",), ("OMIM:60720",), ("XX:1",), ("607208",), ("",), (None,)]
    assert values(spark, raw, "s string", resolve.shape(F.col("s"))) == ["HP:0001250", "NCT:04006210", "ORPHA:33069", None, None, None, None, None]


def test_comparable_changes(spark):
    raw = [("p.R1699W",), ("p.Arg1699Trp",), ("NP_009225.1:p.(Arg1699Trp)",), ("R1699W",), ("p.=",), ("p.(=)",), ("NM_1.2:c.5095c>t",), ("",), (None,)]
    assert values(spark, raw, "s string", names.comparable_change(F.col("s"))) == ["P.ARG1699TRP"] * 4 + [None, None, "C.5095C>T", None, None]


def test_public_url_drops_credentials_only(spark):
    raw = [("https://x.org/a?b=1&API_KEY=s&c=#d",), ("https://x.org/a?token=1",), ("https://x.org/a",), (None,)]
    assert values(spark, raw, "s string", names.public_url(F.col("s"))) == ["https://x.org/a?b=1&c=#d", "https://x.org/a", "https://x.org/a", None]


def test_conditions_are_named_but_for_a_slip(spark):
    rows = [(["muscular", "dystrophin"], ["muscular", "dystrophy"]), (["cold"], ["colt"]), (["haemophilia", "b"], ["haemophilia", "a"])]
    assert values(spark, rows, "w array<string>, c array<string>", names.names_condition(F.col("w"), F.col("c"))) == [True, False, False]


def test_annotation_loses_no_candidate_and_orders_the_queue(spark):
    cands = spark.createDataFrame(
        [(1, 1, 7, "de_novo", None, 0), (1, 2, 7, "inherited_het", "HIGH", 0), (1, 3, 8, "inherited_het", None, 9), (1, 4, 9, "inherited_het", None, 0), (1, 5, 9, "inherited_het", None, 0), (1, 6, 5, "inherited_het", None, 0)],
        "chrom int, pos int, gene int, class string, own_impact string, batch int",
    )
    held = spark.createDataFrame([(1, 1, "LOW", 0.0, False), (1, 3, "HIGH", 0.0, True), (1, 4, "MODERATE", 0.2, False), (1, 5, "MODERATE", 0.04, True), (1, 6, "MODERATE", 0.02, False)], "chrom int, pos int, impact string, af double, pathogenic boolean")
    a = annotation.annotate(cands, held, spark.createDataFrame([(0,)], "batch int"))
    assert {r.pos: (r.status, r.impact) for r in a.collect()} == {1: ("found", "LOW"), 2: ("not held", "HIGH"), 3: ("not answered", None), 4: ("found", "MODERATE"), 5: ("found", "MODERATE"), 6: ("found", "MODERATE")}
    # common goes, but for the pathogenic exemption; a lone heterozygote above the dominant threshold is late
    assert {r.pos: (r.grp, r.late) for r in annotation.budget(a).collect()} == {1: (1, False), 2: (0, False), 3: (6, False), 5: (0, True), 6: (4, True)}


def test_first_link_wins_and_obsolete_classes_are_followed(spark):
    frame = spark.createDataFrame
    found = resolve.links(
        frame([(1,), (2,)], "omim int"), frame([(1, 5)], "omim int, orpha int"),
        frame([("OMIM:1", 10, False), ("ORPHA:5", 10, False), ("ORPHA:5", 20, True), ("OMIM:2", 30, True)], "object string, mondo int, obsolete boolean"), frame([(20, 21)], "mondo int, by int"),
    )
    assert {(r.omim, r.mondo): (r.how, r.source) for r in found.collect()} == {
        (1, 10): ("exact match", "OMIM:1"), (1, 21): ("replacement of an obsolete match", "ORPHA:5"), (2, 30): ("obsolete, not replaced", "OMIM:2"),
    }


def test_folded_names(spark):
    raw = ["Wilson’s Disease", "WILSONS disease", "wilson   DISEASE", "ＧＳＤ Ⅱ", "glycaemic III/IV", "glycemic 3, 4", "aegis", "gas disease", "foo2b-3", "", None]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "s string").coalesce(1).select(records.composed("s").alias("s")).select(records.folded(F.col("s"))).collect()]
    assert found == ["wilsondisease", "wilsondisease", "wilsondisease", "gsdii", "glycemiciii-iv", "glycemic3-4", "aegis", "gasdisease", "foo2b3", "", ""]


def test_acronyms(spark):
    raw = ["CAH", "aHUS", "X-ALD", "CAH type 2b", "CAH Disease IV", "Cah", "abCD", "CAH and more", "ABCDEFGHI", "ÄBC", "A", "", None]
    assert values(spark, [(x,) for x in raw], "s string", records.is_acronym(F.col("s"))) == [True] * 5 + [False] * 8


def test_entity_resolution_joins_no_customer_with_all_classes(spark):
    from helixframe.operators.consensus import query_entity_resolution

    df = query_entity_resolution(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2
    assert df.count() == df.select("id").distinct().count() == 150


def test_links_of_few_objects_are_dealt_by_what_comes_of_them(spark, monkeypatch):
    from helixframe.operators import resolve

    asked = spark.range(40).select(F.col("id").alias("omim"))
    exact = asked.select("omim", (F.col("omim") % 2).alias("orpha"))
    mapped = spark.range(100).selectExpr("concat('ORPHA:', id % 2) AS object", "id AS mondo", "id % 10 = 0 AS obsolete").union(spark.sql("SELECT 'OMIM:7', 10L, true"))
    replaced = spark.sql("SELECT 10L AS mondo, 11L AS by")
    monkeypatch.setattr(resolve, "spread", lambda df, rows, *keys: resolve.keep(df.repartition(1 + int(rows) // 500, *keys), f"dealt-{rows}"))
    df = resolve.links(asked, exact, mapped, replaced)
    assert "dealt-2001" in "".join(df.inputFiles())  # 40 entries with 50 classes each, and one of their own
    got = {(r.omim, r.mondo): (r.how, r.source) for r in df.collect()}
    assert got[7, 11] == ("replacement of an obsolete match", "OMIM:7") and got[8, 20] == ("obsolete, not replaced", "ORPHA:0") and got[7, 13] == ("exact match", "ORPHA:1")


def test_one_table_of_large_counts_fills_many_tasks(spark):
    from math import comb

    from helixframe.operators.statistics import fisher

    a, b, c, d = 10_050, 9_950, 9_970, 10_530
    row, col, n = a + b, a + c, a + b + c + d
    weight, w = [], comb(n - col, row)  # of first cells from 0 on, exact
    for x in range(min(row, col) + 1):
        weight.append(w)
        w = w * (col - x) * (row - x) // ((x + 1) * (n - col - row + x + 1))
    total = sum(weight)
    two, greater = sum(v for v in weight if v <= weight[a]) * 10**12 // total / 1e12, sum(weight[a:]) * 10**12 // total / 1e12
    df = fisher(spark.createDataFrame([(None, a, b, c, d)], "key string, a long, b long, c long, d long"), "key")
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    r = df.first()
    assert abs(r.p_two - two) < 2e-6 and abs(r.p_greater - greater) < 2e-6


def test_sites_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    from helixframe.operators import trio

    monkeypatch.setattr(trio, "SITES_PART", 1000)
    plan = trio.trios(trio.calls(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1


def test_nearest_without_a_shuffle_of_pairs(spark):
    from helixframe.operators.evaluation import nearest

    random.seed(3)
    sets = {a: set(random.sample(range(60), random.randint(1, 12))) for a in range(40)} | {2**40: {1, 2, 3}, 99: {1000}}
    df = nearest(spark.createDataFrame([(a, x) for a, v in sets.items() for x in v], "a long, x long"), part=50)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    want = {}
    for a, v in sets.items():
        near = [(-round(len(v & w) / len(v | w), 6), b) for b, w in sets.items() if a != b and v & w]
        if near:
            want[a] = min(near)
    assert {r.a: (-r.jaccard, r.b) for r in df.collect()} == want


def test_fast_patterns_find_what_the_stated_ones_do(spark):
    import re

    from helixframe.operators import text

    random.seed(4)
    parts = ["a@b.c", "@", "a%40b-c.d.", "1234567890123456", "555-1234", "x", "10.0.0.255", ".", "1", "12345", "token", " ", ":", "=", "password  ", "12345678901234567x", "-", "\n", "secret", "0", "7.1.2.3", "\r\n"]
    rows = ["".join(random.choices(parts, k=random.randint(0, 5))) for _ in range(3000)]
    got = values(spark, [(r,) for r in rows], "t string", text.privacy_reasons(F.col("t")))
    assert got == [[k for k, p in text.PII if re.search(p, r.replace("%40", "@").lower())] for r in rows]
    assert not any(p.startswith(("(^", "[a-z0-9._%+-]+@")) for _, p in text.PII_FAST.values())
