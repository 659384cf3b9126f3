"""Spelling variants against their SQL and a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from helixframe.llm import variants
from helixframe.llm.variants import op13_spelling_variants
from tests.oracle import compare

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}
    form, out = {}, set()
    for w in n:
        close = [v for v in n if near(v, w)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = (best if best and n[best] >= 2 * n[w] else None, len(close))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        f = form[w][0]
        out.add((w, f, root, n[w], form[w][1], n[f] if f else None))
    return out


def made(seed, letters="abé", length=(4, 8), n=200, words=30):
    random.seed(seed)
    word = lambda: "".join(random.choices(letters, k=random.randint(*length)))
    return [(i, "1 ".join(word() for _ in range(random.randint(0, words)))) for i in range(n)]


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("slice_words", [3, 40, 20_000])
def test_equals_all_pairs(spark, slice_words):
    rows = made(1, n=800)
    want = brute(rows)
    got = variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), slice_words=slice_words).collect()
    assert len(got) == len(want) > 200
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want


def test_many_letters(spark):
    rows = made(2, "abcdefgÀÿ÷Z", (5, 6), 400, 400)
    assert rows_of(variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), slice_words=100)) == brute(rows)


def test_deep_chains_and_ties(spark):
    rows = [(i, " ".join(["abcde"] * (3 << 6) + ["abcdf"] * (3 << 5) + ["abcgf"] * (3 << 4) + ["abhgf"] * 24 + ["aihgf"] * 12 + ["jihgf"] * 6 + ["jihg"] * 9 + ["jihgfk"] * 3)) for i in range(3)]
    rows += [(7, "zzzzz " * 4 + "zzzzy " * 4 + "zzzzx " * 8)]
    got = rows_of(variants.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert ("jihgfk", "jihgf", "abcde") in {r[:3] for r in got}


def test_odd_rows(spark):
    long = "ab" * 50_000
    rows = [(None, "Hallo hallo HALLO Hello"), (1, None), (1, ""), (2, "hello hello hellö hellö hellö 中文hellö"), (2, "hello"), (3, f"{long} {long}a {long}"), (4, f"{long} {long}a {long}a")]
    rows += [(5, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa aaaaaaa")] * 2
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, word string, n int")
    assert rows_of(variants.variants(docs, slice_words=2)) == brute(rows)
    assert variants.variants(docs.limit(0)).collect() == []


def test_long_texts_in_blocks():
    text = "Haus, maus und ÄRGER " * 40
    words = [w for part in variants.runs(text, 50) for w in part]
    assert [w.decode("latin-1") for w in words] == re.findall("[a-zÀ-ÿ]+", text.translate(LOWER))


def test_light_edges_stay_few():
    random.seed(9)
    words = sorted({"".join(random.choices("abcdefgh", k=7)) for _ in range(30_000)})
    found = list(variants.merged(words, [1] * len(words), {}))
    assert len(found) < 4 * len(words) * 8
    plain = sum(len(w) for w in words) * 2 + sum(8 * (len(w) + 1) for w in words)
    assert len(found) < plain / 3


def test_query_equals_sql(spark):
    compare(op13_spelling_variants(spark, "/root/testdata/sf0.001"), variants.ORACLE, "/root/testdata/sf0.001")
