"""Header declarations and INFO annotation on small planted files."""

from helixframe.sources import annotated, readers

HEAD = """##fileformat=VCFv4.2
##contig=<ID=1,length=248956422,assembly="GRCh38">
##INFO=<ID=CSQ,Number=.,Type=String,Description="From a predictor, ID=no. Format: Allele|Consequence|IMPACT|SYMBOL|ALLELE_NUM|gnomAD_AF|gnomADe_EAS_AF|gnomAD_FIN_AF">
##INFO=<ID=ANN,Number=.,Type=String,Description="Functional annotations: 'Allele | Annotation | Annotation_Impact | Gene_Name | Gene_ID' ">
##INFO=<ID=gnomAD_AF_afr,Number=A,Type=Float,Description="x">
##INFO=<ID=gnomAD_AC_afr,Number=A,Type=Integer,Description="x">
##INFO=<ID=gnomAD_AF_fin,Number=A,Type=Float,Description="x">
##INFO=<ID=AF,Number=A,Type=Float,Description="own cohort">
##INFO=<ID=AF_popmax,Number=A,Type=Float,Description="x">"""


def header(spark, text=HEAD):
    lines = spark.createDataFrame([(x,) for x in text.split("\n")], "value string")
    return annotated.Header(lines)


def annotate(spark, h, *rows):
    lines = spark.createDataFrame([("\t".join(("1", str(i + 1), ".", ref, alt, ".", "PASS", info)),) for i, (ref, alt, info) in enumerate(rows)], "value string")
    found = annotated.info_annotation(readers.parse_vcf(lines), h).orderBy("pos", "k").collect()
    return [(r.k, r.impact, r.gene, r.consequence, r.af, r.sources, r.implausible) for r in found]


def test_declarations_and_keys(spark):
    h = header(spark)
    assert h.csq[0] == "Allele" and h.csq[-1] == "gnomAD_FIN_AF" and h.ann == ["Allele", "Annotation", "Annotation_Impact", "Gene_Name", "Gene_ID"]
    assert h.frequencies == ["AF_popmax", "gnomAD_AF_afr"]
    d = {r.id: r for r in annotated.declarations(spark.createDataFrame([(x,) for x in HEAD.split("\n")], "value string")).collect()}
    assert d["1"].length == 248956422 and d["1"].assembly == "GRCh38" and d["CSQ"].number == "." and d["CSQ"].id == "CSQ"


def test_frequency_keys():
    yes = ["gnomAD_AF", "gnomad_exomes_AF", "gnomAD_genomes_AF_nfe", "gnomAD_faf95", "gnomAD_AFR_AF", "popmax_af", "gnomADg.AF"]
    no = ["AF", "gnomAD_AC", "gnomAD_nhomalt_afr", "gnomAD_AN", "gnomAD_AF_asj", "AF_afr", "gnomAD_filter"]
    assert all(annotated.is_frequency(k, "Float") and annotated.is_frequency(k, None) for k in yes)
    assert not any(annotated.is_frequency(k, "Float") for k in no) and not annotated.is_frequency("gnomAD_AF", "Integer")


def test_entries_by_number_worst_first_and_refused_frequencies(spark):
    csq = "CSQ=C|low|LOW|A|1|0.1|0.3&0.2|0.9,C|high|HIGH|B|1|||,C|high2|HIGH|D|1|||,T|mod|MODERATE|E|2|17||,x|odd||F||-1||"
    found = annotate(spark, header(spark), ("A", "C,T", csq + ";gnomAD_AF_afr=0.01,0.4;AF=0.9"), ("A", "G", "DB"))
    assert found[0] == (1, "HIGH", "B", "high", 0.3, ["CSQ", "INFO AF"], ["gnomAD_AF"])
    assert found[1] == (2, "MODERATE", "E", "mod", 0.4, ["CSQ", "INFO AF"], ["gnomAD_AF"])
    assert found[2] == (1, None, None, None, None, [], [])


def test_alleles_as_written_and_ann(spark):
    h = header(spark, HEAD.replace("|ALLELE_NUM", "|HGNC"))
    found = annotate(
        spark, h, ("ACT", "A", "CSQ=-|del|LOW|G1"), ("AC", "ACT,A", "CSQ=CT|ins|HIGH|G2,-|del|LOW|G3"), ("C", "T", "CSQ=G|other|HIGH|G4;ANN=T|c|MODERATE|G5|id,|any|HIGH|G6,G|no|HIGH|G7"), ("C", "T", "CSQ=T|a|HIGH|G8;ANN=T|b|HIGH|G9"), ("AC", "GT", "CSQ=GT|mnv|LOW|G10;XCSQ=9")
    )
    assert [(x[0], x[1], x[2]) for x in found] == [(1, "LOW", "G1"), (1, "HIGH", "G2"), (2, "LOW", "G3"), (1, "HIGH", "G6"), (1, "HIGH", "G8"), (1, "LOW", "G10")]
    assert found[3][5] == ["ANN"] and found[4][5] == ["CSQ", "ANN"]


def test_file_without_annotations(spark):
    h = header(spark, "##fileformat=VCFv4.2")
    assert (h.csq, h.ann, h.frequencies) == (None, None, [])
    assert annotate(spark, h, ("A", "C", "CSQ=C|low|LOW|A;gnomAD_AF=0.1")) == [(1, None, None, None, None, [], [])]
