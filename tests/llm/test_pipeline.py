import duckdb
import pytest

import corpus_pipeline as P
from helixframe.llm import decontam, line_dedup, mixing, ngram_join, toxicity
from helixframe.llm.common import Scratch, WordHashes, read_table
from tests.llm.test_decontam import slow_tiles
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_ngram_join import brute as similar


def test_stages_are_the_five(spark):
    assert [f for _, f in P.STAGES] == [toxicity.stage, line_dedup.stage, ngram_join.stage, decontam.stage, mixing.stage]
    assert P.ORACLE_SQL is None


def test_stage_by_stage_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    s, docs = Scratch(spark, "t"), read_table(spark, sf, "documents")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        docs = s.keep(stage(spark, docs, sf), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
    order = list(kept)
    assert all(kept[b] <= kept[a] for a, b in zip(order, order[1:], strict=False))
    again = {r.doc_id for r in P.run(spark, sf).collect()}
    assert again <= kept[order[-1]]


def test_planted_cases(spark, tmp_path):
    words = [f"w{i}" for i in range(120)]
    near = [*words[:60], "other", *words[61:]]
    item = " ".join(f"b{i}" for i in range(30))
    texts = {1: " ".join(words), 2: " ".join(words), 3: " ".join(near), 4: "you idiot, you pathetic scum", 5: "before " + item + " after", 6: "a clean text on its own", 7: ""}
    for name, rows, schema in (
        ("documents", [(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [], "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = read_table(spark, str(tmp_path), "documents")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} == {1, 6, 7}


def write(spark, folder, documents, extra="", labels=(), benchmark=()):
    for name, rows, schema in (
        ("documents", documents, "doc_id long, text string, lang string, source string, n_chars long" + extra),
        ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string"),
    ):
        spark.createDataFrame(list(rows), schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def slow_pipeline(spark, rows, model, items):
    """(doc_id, text, source, copies) by plain algorithms over rows of distinct doc_ids."""
    scored = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    toxic = {r.doc_id for r in model.score(scored).collect() if r.score >= 0.5}
    rows = [r for r in rows if r[0] not in toxic]
    cut = lines({i: t for i, t, _ in rows}.items())
    rows = [(i, cut[i], s) for i, t, s in rows if t is None or cut[i] or not t]
    near = similar([(i, t) for i, t, _ in rows], 5, 80, 100)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    hashes, bad = WordHashes(), set()
    for i, t, _ in rows:
        a = decontam.text_words(t, hashes).tolist()
        runs = {tuple(a[p : p + 5]) for p in range(len(a) - 4)}
        for item in items:
            b = decontam.text_words(item, hashes).tolist()
            if len(b) >= 5 and any(tuple(b[p : p + 5]) in runs for p in range(len(b) - 4)):
                if sum(n for *_, n in slow_tiles(a, b, 5)) >= 0.6 * len(b):
                    bad.add(i)
    rows = [r for r in rows if r[0] not in bad]
    c = duckdb.connect()
    c.execute("CREATE TABLE t (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    return sorted(c.execute(mixing.mixed_sql("t", "doc_id, text, source, copy")).fetchall(), key=repr)


def test_all_stages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = read_table(spark, sf, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    items = [r.text for r in read_table(spark, sf, "benchmark").collect()]
    model = toxicity.Model.train(docs, read_table(spark, sf, "labels"))
    got = sorted((tuple(r) for r in P.run(spark, sf).select("doc_id", "text", "source", "copy").collect()), key=repr)
    assert got == slow_pipeline(spark, rows, model, items)
    assert len({r[0] for r in got}) < len(rows) - 10


def test_nulls_ties_repeats_and_clashing_columns(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en", None, 0), (2, words, None, "s", 0), (None, words, "en", "s", None), (None, None, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    rows += [(5, "you idiot, you pathetic scum", "en", "s", 1), (6, "same row", "en", "s", 8), (6, "same row", "en", "s", 8), (7, "long " * 50_000, "en", "t", 9)]
    extra = ["copy", "shuffle_key", "score", "leaks", "n", "_k1", "_l", "_n", "_toxicity", "Text_"]
    folder = write(spark, tmp_path, [(*r, *range(len(extra))) for r in rows], "".join(f", `{c}` int" for c in extra))
    out = P.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra, "copy_", "shuffle_key_"]
    got = [r.asDict() for r in out.collect()]
    assert all([r[c] for c in extra] == list(range(len(extra))) for r in got)
    assert {r["doc_id"] for r in got} <= {1, 3, 4, 6, 7, None}
    docs = read_table(spark, folder, "documents")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
    assert sorted((r.doc_id or 0, r.text or "") for r in docs.collect()) == sorted([(0, ""), (0, words), (1, words), (3, ""), (4, ""), (6, "same row"), (6, "same row"), (7, "long " * 50_000)])


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_empty_tables(spark, tmp_path, rows):
    out = P.run(spark, write(spark, tmp_path, rows))
    assert out.where("doc_id is not null").count() == 0 and out.columns[-2:] == ["copy", "shuffle_key"]
