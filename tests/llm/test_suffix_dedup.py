import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixframe.llm import suffix_dedup as S


def brute(rows, least):
    texts = [(i, (t or "").lower().split()) for i, t in rows]
    seen = Counter(tuple(w[p : p + least]) for _, w in texts for p in range(len(w) - least + 1))
    out = defaultdict(set)
    for i, w in texts:
        spans = []
        for p in range(len(w) - least + 1):
            if seen[tuple(w[p : p + least])] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + least
                else:
                    spans.append([p, p + least])
        out[i] |= {tuple(s) for s in spans}
    return {i: s for i, s in out.items() if s}


def test_minimisers_are_leftmost_smallest():
    x = np.array([5, 3, 3, 9, 1, 7], np.uint64)
    assert S.minimisers(x, 3).tolist() == [1, 1, 4, 4] and S.minimisers(x[:2], 3).tolist() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    passages = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 30)) for _ in range(r.randint(5, 40))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(r.choice("xyz") + str(r.randint(0, 500)) for _ in range(r.randint(0, 20)))]
        parts += r.choices(passages, k=r.randint(0, 3))
        r.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, "the the " * 40), (103, None), (104, ""), (105, "q " * 9)]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, at string")
    got = defaultdict(set)
    for x in S.Repeats(docs, phrase=5, window=6).run().collect():
        got[x.doc_id].add((x.start, x.end))
    assert dict(got) == brute(rows, 10)


def test_first_occurrence_and_empty(spark):
    p = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(7, "a b " + p), (3, p + " z"), (9, p + " z"), (None, p)], "doc_id long, text string")
    got = {x.doc_id: (x.start, x.end, x.first) for x in S.Repeats(docs, phrase=5, window=6).run().collect()}
    assert got == {7: (2, 14, False), 3: (0, 13, True), 9: (0, 13, False)}
    assert S.Repeats(docs.limit(0), 5, 6).run().count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_equals_brute_force(spark, seed):
    r = random.Random(seed)
    passages = [" ".join(f"p{j}x{i}" for i in range(12)) for j in range(5)] + ["s " * 14]
    texts = [" ".join([f"d{i}a", r.choice(passages), f"d{i}b", *r.sample(passages, r.randint(0, 1)), *(f"d{i}w{j}" for j in range(12))]) for i in range(12)]
    rows = [(i, texts[i] if i < 12 else r.choice(texts)) for i in range(24)]
    words, first, copies = {i: t.split() for i, t in rows}, {}, Counter(t for _, t in rows)
    runs = {i: [tuple(w[p : p + 10]) for p in range(len(w) - 9)] for i, w in words.items()}
    for i in sorted(runs):
        for p, x in enumerate(runs[i]):
            first.setdefault(x, (i, p))
    got = list(S.Repeats(spark.createDataFrame(rows, "doc_id long, text string"), phrase=5, window=6).run().collect())
    for x in got:
        if copies[dict(rows)[x.doc_id]] > 1:
            want = (x.start, x.end) == (0, len(words[x.doc_id])) and all(first[y][0] == x.doc_id for y in runs[x.doc_id])
        else:
            want = all(first[runs[x.doc_id][p]] == (x.doc_id, p) for p in range(x.start, x.end - 9))
        assert x.first == want
    assert {x.doc_id for x in got} == {i for i in runs if any(sum(y in z for z in runs.values()) > 1 or runs[i].count(y) > 1 for y in runs[i])}


def test_texts_that_share_a_doc_id(spark):
    a, p = " ".join(f"a{i}" for i in range(15)), " ".join(f"p{i}" for i in range(12))
    rows = [(1, a), (2, a), (2, "b c " + p), (3, p + " d"), (2, "short")]
    got = sorted(tuple(x) for x in S.Repeats(spark.createDataFrame(rows, "doc_id long, text string"), phrase=5, window=6).run().collect())
    assert got == [(1, 0, 15, True), (2, 0, 15, False), (2, 2, 14, True), (3, 0, 12, False)]
