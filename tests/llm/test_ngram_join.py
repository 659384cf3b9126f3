"""The similarity join against brute force over all pairs."""

import random
import re

import pytest

from helixframe.llm import ngram_join as N


def brute(rows, k, num, den):
    """doc_id -> (set size, smallest reachable id) from exact sets of word tuples and all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=160):
    """Unrelated texts, exact copies, near copies of a base with private and with shared changes, and a common line."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(120)]
    line = " ".join(r.choice(vocabulary) for _ in range(14))
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.45:
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice([f"x{i}", "shared", vocabulary[0]])
            if r.random() < 0.3:
                w = w[: r.randint(90, 120)]
            t = " ".join(w)
        elif kind < 0.6 and rows:
            t = r.choice(rows)[1]
        else:
            t = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) + (" " + line if r.random() < 0.5 else "")
        rows.append((i * 3 + 1, t))
    return rows


def test_lists_beyond_the_limits_and_salted_references(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT_MOST", 3)
    monkeypatch.setattr(N, "LIST_MOST", 4)
    monkeypatch.setattr(N, "REF_MOST", 0)
    rows = corpus(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.Join(spark.createDataFrame(rows, "doc_id long, text string")).run().collect()}
    assert got == brute(rows, 4, 85, 100)


def test_query_gives_rows_without_id_their_size(spark, tmp_path):
    rows = [(None, "a b c d e"), (None, None), (3, "a b c d e"), (3, "a b c d e"), (2, ""), (9, "a B c D e")]
    spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, s1 int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in N.op1_ngram_jaccard(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, 2, None), (None, 0, None), (3, 2, 3), (3, 2, 3), (2, 0, 2), (9, 2, 3)], key=repr)


@pytest.mark.parametrize("k,num,den,seed", [(4, 85, 100, 1), (4, 85, 100, 2), (5, 80, 100, 3)])
def test_components_equal_brute_force(spark, k, num, den, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.Join(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).run().collect()}
    assert got == brute(rows, k, num, den)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a B"), (6, "é a b c d e"), (7, "É a b c d e"), (8, "x " * 30000), (8, "x y z w v"), (None, "a b c d e")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n long, sig string")
    got = {}
    for r in N.Join(docs).run().collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert got[1] == [(0, 1)] and got[2] == [(0, 2)] and got[3] == [(0, 3)]
    assert got[4] == [(1, 4)] and got[5] == [(1, 4)]
    assert got[6] == [(2, 6)] and got[7] == [(2, 7)]  # only A-Z are folded
    assert {c for _, c in got[8]} == {8}
    assert None not in got
    assert N.Join(docs.limit(0)).run().count() == 0


def test_stage_keeps_the_smallest_of_each_group(spark):
    words = [f"w{i}" for i in range(100)]
    near = list(words)
    near[50] = "other"
    docs = spark.createDataFrame([(5, " ".join(words)), (3, " ".join(near)), (9, "something else entirely here now"), (10, ""), (11, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.stage(spark, docs, "").collect()) == [3, 9, 10, 11]
