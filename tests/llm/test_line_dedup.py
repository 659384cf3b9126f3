from collections import Counter

from helixframe.llm import line_dedup as L
from helixframe.llm import queries
from tests.oracle import compare


def brute(rows):
    first, cut = {}, {i: set() for i, _ in rows}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        for p in range(len(lines) - 2):
            key = tuple(lines[p : p + 3])
            if key in first:
                cut[i] |= {p, p + 1, p + 2}
            first.setdefault(key, (i, p))
    return {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in cut[i]) for i, t in rows}


def test_equals_brute_force(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\na\na\na\na"), (4, "one\ntwo"), (5, None), (6, ""), (7, "\n\n\n"), (8, "q\n\n\n\nq"), (9, "b\nc\nd")]
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, _t int, _cut string")
    out = L.line_dedup(docs)
    assert {r.doc_id: r.text for r in out.collect()} == brute(rows)
    assert {"_t", "_cut"} <= set(out.columns)
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in rows)


def test_stage_drops_what_is_all_copied_and_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 5), (2, "a\nb\nc", 5), (3, "", 0), (4, None, None), (5, "z\na\nb\nc", 7)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in L.stage(spark, docs, "").collect()}
    assert got == {1: ("a\nb\nc", 5), 3: ("", 0), 4: (None, None), 5: ("z", 1)}
    assert L.line_dedup(docs.limit(0)).count() == 0


def test_query_equals_sql(spark):
    compare(queries.QUERIES["op10_line_dedup"](spark, "/root/testdata/sf0.001"), queries.ORACLE_SQL["op10_line_dedup"], "/root/testdata/sf0.001")
