"""Parsers of landed responses, inspection rules and ranking penalties on small planted inputs."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import ranking
from helixframe.sources import inspection, landed


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)


def test_phenopackets(spark):
    f = '{"type":{"id":"%s"},"excluded":%s}'
    features = ",".join(f % x for x in (("HP:0000001", "false"), ("hp:0000002", "true"), ("HP:0000001", "true"), ("X:1", "false"), ("HP:0000003", '"True"')))
    packet = '{"subject":{"id":"a"},"phenotypicFeatures":[%s],"diseases":[{"term":{"id":"OMIM:1"}},{"term":{"id":"OMIM:2"},"excluded":true}],"interpretations":[{"diagnosis":{"disease":{"id":"MONDO:0000001"}}},{"diagnosis":{"disease":{"id":"OMIM:3"}}}]}' % features
    rows = landed.phenopackets(lines(spark, packet, '{"proband":%s}' % packet, '{"members":[{}]}', '{"a":1}', "no json", "", None)).drop("value").collect()
    read = (None, ["HP:0000001"], ["HP:0000002", "HP:0000003"], 1, 1, ["OMIM:1", "OMIM:3"])
    assert [tuple(r) for r in rows[:2]] == [read, read]
    assert [r.why for r in rows[2:]] == ["cohort", *["not a phenopacket"] * 4]
    assert all(r.present == r.excluded == r.diseases == [] for r in rows[2:])


def test_records_as_object_list_or_nothing(spark):
    text = '[{"query":"a","clinvar":{"rcv":{"accession":"1"}}},{"query":"b","clinvar":{"rcv":[{"accession":"1"},{"accession":"2"}]},"gnomad_exome":{"af":{"af":NaN}},"gnomad_genome":{"af":{"af":0.5}}},{"query":"c","notfound":true}]'
    rows = landed.variant_hits(lines(spark, text, "[]", "broken")).collect()
    assert [(r.query, r.found, [x.accession for x in r.records], r.af) for r in rows] == [("a", True, ["1"], None), ("b", True, ["1", "2"], 0.5), ("c", False, [], None)]


def test_highest_group_skips_bottlenecked_and_empty_groups(spark):
    t = "array<struct<id:string,ac:bigint,an:bigint>>"
    rows = [([("fin", 9, 10), ("nfe", 1, 10), ("afr", 2, 20), ("eas", 0, 0), ("XX", 5, 5)],), ([("asj", 1, 2)],), ([],)]
    found = spark.createDataFrame(rows, f"g {t}").coalesce(1).select(landed.highest_group(F.col("g")).alias("h")).collect()
    assert [r.h and tuple(r.h) for r in found] == [("nfe", 0.1), None, None]


def test_locations(spark):
    got = lines(spark, "chr1:10-20", "M:1-2", " chrx:5-6 ", "tbd", "", None).select(landed.location(F.col("value")).alias("l")).collect()
    assert [r.l and tuple(r.l) for r in got] == [("1", 10, 20), ("MT", 1, 2), ("X", 5, 6), None, None, None]


def test_ranked_hits_keep_ties_and_drop_scoreless_rows(spark):
    rows = landed.columns_of(lines(spark, "1\t0.9\tA\tn\tHP:1,,HP:2\tG", "1\t0.9\tB\tn\t\t", "3\t\tC\tn", "4\tNaN\tD", "x\t1\tE", "# note", ""), ["Rank", "Score", "ORPHA_ID", "Disease_Name", "Matched_Phenotype", "Causative_Gene"])
    assert [(r.rank, r.id, r.matched, r.genes) for r in landed.ranked_hits(rows).collect()] == [(1, "A", ["HP:1", "HP:2"], ["G"]), (1, "B", [], [])]


def test_trial_flags(spark):
    study = '{"protocolSection":{"identificationModule":{"nctId":"N%d"},"statusModule":{"overallStatus":"%s","lastUpdatePostDateStruct":{"date":"%s"}},"contactsLocationsModule":{"locations":[{"status":"recruiting"}]}}}'
    text = '{"studies":[%s]}' % ",".join((study % (1, "Unknown", "2020-01"), study % (2, "RECRUITING", "2023-06-01"), study % (3, "COMPLETED", "soon")))
    rows = landed.trials(lines(spark, text, "{}"), F.lit("2024-01-01").cast("date")).collect()
    assert [(r.trial, r.flags) for r in rows] == [("N1", ["stale", "unverified", "conflict"]), ("N2", []), ("N3", ["conflict"])]


def test_calibrated_ends_and_bands(spark):
    ranges = [(None, False, 0.0, False, "low"), (0.0, True, 1.0, True, "mid"), (1.0, False, None, False, "high")]
    d = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 1.5, None, float("nan"))], "s double").coalesce(1)
    assert [r.v for r in d.select(landed.calibrated(F.col("s"), ranges).alias("v")).collect()] == ["low", "mid", "mid", "high", None, None]
    t = spark.createDataFrame([(x,) for x in (10.0, 9.9, 1.0, 0.1, 0.0, None)], "s double").coalesce(1)
    assert [r.v for r in t.select(landed.band(F.col("s")).alias("v")).collect()] == ["expressed", "expressed_low", "expressed_low", "trace", "not_detected", None]


def test_summaries_skip_the_list_of_uids(spark):
    text = '{"result":{"uids":["7"],"7":{"accession":"V7","germline_classification":{"description":"d","review_status":"Practice Guideline "}}}}'
    assert [tuple(r) for r in landed.summaries(lines(spark, text, "", '{"result":{}}')).collect()] == [("7", "V7", "d", 4)]


def test_genotype_kinds(spark):
    gts = [[1], [0], [1, 1], [0, 1], [None, 1], [None, 0], [None], [None, None], [1, 2], None]
    d = spark.createDataFrame([(g,) for g in gts], "g array<int>").coalesce(1)
    kinds = [r.k for r in d.select(inspection.genotype_kind(F.col("g")).alias("k")).collect()]
    assert kinds == ["haploid", "ref", "hom", "het", "het", "ref", "missing", "missing", "het", "missing"]


def test_build_by_votes(spark):
    contigs = spark.createDataFrame([("new", "chr1", 248956422), ("both", "1", 248956422), ("both", "2", 243199373), ("odd", "1", 5), ("against", "1", 249250621)], "file string, name string, length long")
    tags = spark.createDataFrame([("tagged", "refs/hg38.fa"), ("against", "GRCh38"), ("silent", "mm10")], "file string, tag string")
    found = {r.file: (r.guess, r.conflict) for r in inspection.guess_build(contigs, tags).collect()}
    assert found == {"new": ("GRCh38", False), "both": (None, True), "odd": (None, False), "against": (None, True), "tagged": ("GRCh38", False), "silent": (None, False)}


@pytest.mark.parametrize(("score", "expected"), [(ranking.resnik_with_penalties, {1: 1.0, 2: 0.0, 3: 0.5}), (ranking.likelihood_with_penalties, {1: 2.0, 2: -0.3, 3: 2.0 - 0.693147})])
def test_penalties(spark, score, expected):
    """Terms a and b over root r: disease 1 has a; disease 2 has a but is curated not to have b; disease 3 has a and, half the time, the excluded e."""
    closed = spark.createDataFrame([("a", "a"), ("a", "r"), ("b", "b"), ("b", "r"), ("e", "e"), ("e", "r"), ("r", "r")], "term string, ancestor string")
    carried = spark.createDataFrame([(1, "a", 1.0), (1, "r", 1.0), (2, "a", 1.0), (2, "r", 1.0), (3, "a", 1.0), (3, "e", 0.5), (3, "r", 1.0)], "disease long, ancestor string, freq double")
    ic = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("e", 2.0), ("r", 0.0)], "ancestor string, ic double")
    cases = spark.createDataFrame([("c", "a", "present"), ("c", "b", "present"), ("c", "e", "excluded")], "case_id string, term string, status string")
    absent = spark.createDataFrame([(2, "b")], "disease long, term string")
    found = {r.disease: r.score for r in ranking.rank(cases, closed, carried, ic, 10, score, absent).collect()}
    assert found == pytest.approx(expected)
