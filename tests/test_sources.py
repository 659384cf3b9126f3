"""Readers and sinks on small files in the shapes of the domain, written here."""

import json

import pytest
from pyspark.sql import functions as F

from helixframe.sources import readers as R
from helixframe.sources import sinks as S


def write(path, text):
    path.write_text(text)
    return str(path)


def test_vcf_header_records_calls(spark, tmp_path):
    path = write(tmp_path / "a.vcf", "\n".join([
        "##fileformat=VCFv4.2", "##INFO=<ID=AF,Number=A>", "##FORMAT=<ID=GT,Number=1>", "##contig=<ID=chr1,length=9>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tP\tM",
        "chr1\t5\t.\ta\tC,T\t.\tPASS\tAF=0.1;DB\tGT:AD:DP\t1|2:1,5,4:10\t./.", "chrM\t7\trs\tAC\tA\t9\t.\t.\tGT\t1\t0", "chrX\t0\t.\tA\tC\t.\t.\t.", "bad line",
    ]) + "\n")
    records, head = R.read_vcf(spark, path)
    assert head["samples"] == ["P", "M"] and head["contig"] == ["chr1"] and head["INFO"] == ["AF"]
    assert [(r.chrom, r.pos, r.ref, r.alts) for r in records.orderBy("pos").collect()] == [("1", 5, "A", ["C", "T"]), ("MT", 7, "AC", ["A"])]
    assert records.orderBy("pos").select(R.info_map(F.col("info"))).first()[0] == {"AF": "0.1", "DB": None}
    got = {(c.chrom, c.k, c.sample): c for c in R.calls(records).collect()}
    assert len(got) == 6
    c = got["1", 2, 0]
    assert (c.gt, c.phased, c.dp, c.ad, c.gq) == ([1, 2], True, 10, [1, 5, 4], None)
    assert got["1", 1, 1].gt == [None, None] and got["MT", 1, 0].gt == [1]


def test_vcf_with_too_many_bad_lines_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        R.read_vcf(spark, write(tmp_path / "b.vcf", "#CHROM\nchr1 5 . A C\nchr1 6 . A C\n"))


def test_frequency_pooling(spark):
    rows = [("d", "t1", None, "6/11"), ("d", "t1", "", "1/1"), ("d", "t1", None, "0/2"), ("d", "t2", None, "0/2"), ("d", "t3", None, None), ("d", "t4", "NOT", None), ("d", "t5", None, "HP:0040285"), ("d", "t6", None, "HP:0040282"), ("d", "t6", None, "1/10")]
    df = spark.createDataFrame([(*r, "P") for r in rows] + [("d", "t7", None, None, "I")], "database_id string, hpo_id string, qualifier string, frequency string, aspect string")
    positive, absent = R.pool_annotations(df)
    assert {r.term: (round(r.weight, 6), r.unstated) for r in positive.collect()} == {"t1": (0.5, False), "t3": (1.0, True), "t6": (0.55, False)}
    assert {r.term for r in absent.collect()} == {"t4", "t5"}


def test_ontology_file(spark, tmp_path):
    iri = "http://purl.obolibrary.org/obo/"
    nodes = [{"id": iri + "HP_1", "lbl": "Root"}, {"id": iri + "HP_2", "lbl": "Leaf", "meta": {"synonyms": [{"pred": "s", "val": "Leaves"}], "basicPropertyValues": [{"pred": "oio#hasAlternativeId", "val": "HP:9"}]}}, {"id": iri + "HP_3", "meta": {"deprecated": True, "basicPropertyValues": [{"pred": iri + "IAO_0100001", "val": iri + "HP_2"}]}}]
    o = R.read_ontology(spark, write(tmp_path / "hp.json", json.dumps({"graphs": [{"nodes": nodes, "edges": [{"sub": iri + "HP_2", "pred": "is_a", "obj": iri + "HP_1"}, {"sub": "x", "pred": "part_of", "obj": "y"}]}]})))
    assert [tuple(r) for r in o["edges"].collect()] == [("HP:2", "HP:1")]
    assert {r.term: r.obsolete for r in o["terms"].collect()} == {"HP:1": False, "HP:2": False, "HP:3": True}
    assert [r.synonym for r in o["synonyms"].collect()] == ["Leaves"]
    ids = spark.createDataFrame([("HP:9",), ("HP:3",), ("HP:1",)], "t string")
    assert sorted(r.t for r in R.resolve(ids, "t", o).collect()) == ["HP:1", "HP:2", "HP:2"]


def test_pedigree_and_its_errors(spark, tmp_path):
    good = "#fam\nF\tc\tp\tm\t1\t2\nF\tp\t0\t0\t1\t1\nF m 0 0 2 -9\n"
    got = {r.iid: r for r in R.read_pedigree(spark, write(tmp_path / "a.ped", good)).collect()}
    assert (got["c"].father, got["c"].affected, got["m"].sex, got["m"].affected) == ("p", True, "female", None)
    for bad in ("F c c 0 1 2", "F c 0 0 1", "F c 0 0 1 2\nF c 0 0 1 2", "F c m 0 1 2\nF m 0 0 2 1", "# nobody"):
        with pytest.raises(ValueError):
            R.read_pedigree(spark, write(tmp_path / "b.ped", bad + "\n"))


def test_lists_mappings_banners_survival_blast(spark, tmp_path):
    lines = spark.createDataFrame([("A, B;C # D",), ("B E",)], "value string").coalesce(1)
    assert [r.gene for r in R.gene_list(lines).orderBy("at").collect()] == ["A", "B", "C", "E"]
    path = write(tmp_path / "m.tsv", "#curie_map\nsubject_id\tpredicate_id\tobject_id\nM:1\tskos:exactMatch\tO:1\nM:2\tskos:broadMatch\tO:2\n")
    assert [tuple(r) for r in R.read_mappings(spark, path).collect()] == [("M:1", "O:1")]
    path = write(tmp_path / "v.csv", '"BANNER","x","y"\n"GENE SYMBOL","GENE ID (HGNC)","CLASS"\n"+++","+++","+++"\n"AB,C","H:1","Definitive"\n')
    assert [tuple(r) for r in R.read_banner_csv(spark, path, "GENE SYMBOL").collect()] == [("AB,C", "H:1", "Definitive")]
    s = spark.createDataFrame([("1", "1"), ("2.5", "2")], "time string, event string")
    assert [(r.time, r.event) for r in R.survival(s).orderBy("time").collect()] == [(1.0, 0), (2.5, 1)]
    with pytest.raises(ValueError):
        R.survival(spark.createDataFrame([("-1", "1")], "time string, event string"))
    hit = spark.createDataFrame([("# c",), ("q\ts\t99.5\t20\t0\t0\t1\t20\t5\t24\t1e-5\t40.1",)], "value string")
    assert R.read_blast(hit).first().s_end == 24


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], 0.123456789, None)], "k int, l array<int>, d double, n string")
    S.write_ranked(df, str(tmp_path / "r"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "r")).first()[:3] == ("1", "1;2", "0.1235")
    for _ in range(2):
        S.append_ledger(spark.createDataFrame([("b",), ("a",)], "q string"), str(tmp_path / "ledger"), ["q"])
    assert sorted((r.eid, r.q) for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == [("E1", "a"), ("E2", "b"), ("E3", "a"), ("E4", "b")]
    S.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
