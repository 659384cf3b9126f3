"""Collocations against their SQL and a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from helixframe.llm import collocations
from helixframe.llm.collocations import op12_collocations
from tests.oracle import compare

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, covered=80, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, c in counts.items():
        chosen = {p: n for p, n in c.items() if len(p) > 1 and n >= least}
        scored = []
        for p, a in chosen.items():
            if any(100 * n >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in chosen.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return out


def made(seed, n=300):
    random.seed(seed)
    words = ["der", "Die", "ÉTÉ", "of", "the", "a b", "x\x1fy", "q", "\x00", "中文", "-", "'"]
    signs = [" ", "  ", "\t", ". ", "\n", "\r\n", ", ", "\x0b", " ; "]
    texts = ["".join(random.choice(words) + random.choices(signs, [20, 2, 2, 2, 2, 1, 1, 1, 1])[0] for _ in range(random.randint(0, 60))) for _ in range(n)]
    return [(t, random.choice(["de", "de", "en", None, "und"])) for t in texts] + [(None, "en"), ("", None), (None, None)]


def rows_of(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize("bits", [16, None])
def test_equals_plain_count(spark, bits):
    rows = made(3)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for least, many in ((6, 50), (30, 1)):
        want = brute(rows, least)
        assert len(want) > many and rows_of(collocations.collocations(docs, least=least, bits=bits)) == want


def test_full_buckets_prune_nothing_wrongly(spark, monkeypatch):
    monkeypatch.setattr(collocations, "grams", lambda words, seed, longest, real=collocations.grams: [(h >> 60 << 60, v) for h, v in real(words, seed, longest)])
    rows = made(4)
    assert rows_of(collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), least=6)) == brute(rows, 6)


def test_short_lists_and_copies(spark):
    rows = made(5) * 3
    docs = spark.createDataFrame([(t, x, 1, 2) for t, x in rows], "text string, lang string, phrase int, n int")
    assert rows_of(collocations.collocations(docs, least=30, top=7)) == brute(rows, 30, top=7)


def test_long_texts_in_blocks():
    text = "Aa bb. cc dd ee, ff " * 50
    want = Counter()
    for piece in re.split(r"[.,]", text.lower()):
        w = piece.split()
        want.update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    got = Counter()
    for words, carried in collocations.blocks(text.encode(), 37):
        got.update(tuple(x.decode() for x in words[i : i + 3]) for i in range(len(words) - 2) if i + 3 > carried and b"." not in words[i : i + 3])
    assert got == want


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 500)
    rows = [(" ".join(t or "" for t, _ in made(6, 400)), "de"), (made(7)[0][0], "de")]
    assert rows_of(collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), least=20)) == brute(rows, 20)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []


def test_query_equals_sql(spark):
    compare(op12_collocations(spark, "/root/testdata/sf0.001"), collocations.ORACLE, "/root/testdata/sf0.001")
