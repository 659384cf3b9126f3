import random
import time

import numpy as np

from helixframe.llm import decontam as D


def slow_tiles(text, item, seed):
    """Greedy string tiling by the book, on words."""
    a, b, free_a, free_b, out = text, item, [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < seed:
            return out
        for x in range(n):
            free_a[i + x] = free_b[j + x] = False
        out.append((i, j, n))


def fast_tiles(text, item, seed):
    number = {w: i for i, w in enumerate(dict.fromkeys(text + item))}
    return D.tile(*(np.array([number[w] for w in x], np.uint64) for x in (text, item)), seed)


def test_tiles_equal_the_slow_algorithm():
    r = random.Random(4)
    for n in range(400):
        item = [r.choice("abcde"[: 1 + n % 5]) for _ in range(r.randint(0, 25))]
        text = [r.choice("abcde"[: 1 + n % 5]) for _ in range(r.randint(0, 30))]
        cut = r.randint(0, len(item))
        text[len(text) // 2 : len(text) // 2] = item[cut:] + item[:cut]
        slow, fast = slow_tiles(text, item, 3), fast_tiles(text, item, 3)
        assert slow == fast


def test_repetitive_texts_are_tiled_in_time():
    r, began = random.Random(1), time.time()
    same, few = ["w"] * 20_000, [r.choice("ab") for _ in range(20_000)]
    assert fast_tiles(same, ["w"] * 400, 5) == [(0, 0, 400)]
    assert sum(n for *_, n in fast_tiles(few, few[7000:9000] + ["c"] + few[100:500], 5)) == 2400
    assert time.time() - began < 2


def test_exact_reordered_altered_and_clean(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words)
    texts = {
        1: "Before it. " + item + " after it.", 2: "x " + " ".join(words[20:]) + ", and " + " ".join(words[:20]), 3: " ".join(words[:9]) + " other words",
        4: None, 5: "", 6: ", ".join(w.upper() for w in words), 7: " ".join(w if i != 20 else "q" for i, w in enumerate(words)),
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([(10, item), (11, "too short"), (12, None), (None, item), (13, " ".join(words[::-1]))], "item_id long, text string")
    got = {r.doc_id: [h.item_id for h in r.hits] for r in D.leaks(docs, bench, out="hits").collect()}
    assert got == {1: [None, 10], 2: [None, 10], 3: [], 4: [], 5: [], 6: [None, 10], 7: [None, 10]}
    assert D.leaks(docs, bench.limit(0), out="hits").where("size(hits) > 0").count() == 0
    assert D.leaks(docs.limit(0), bench, out="hits").count() == 0


def test_equals_tiling_of_all_pairs(spark):
    r = random.Random(9)
    common = " ".join(f"c{i}" for i in range(8))
    items = [(i, " ".join([common, *(r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(r.randint(0, 30)))])) for i in range(25)]
    items += [items[3], (3, items[4][1]), (None, items[5][1]), (99, "one two three"), (98, None)]
    docs = []
    for i in range(80):
        parts = [common]
        for _, t in r.sample(items[:25], r.randint(0, 2)):
            w = t.split()
            cut = r.randint(0, len(w))
            parts += [" ".join(w[cut:]), " ".join(w[: r.randint(0, cut)])]
        r.shuffle(parts)
        docs.append((i, " ".join(parts)))
    docs += [docs[0], (0, docs[1][1]), (None, items[2][1]), (None, None), (500, ""), (501, items[6][1] + " " + common * 500)]
    want = []
    for doc, text in docs:
        for item, words in items:
            a, b = (text or "").split(), (words or "").split()
            tiles = slow_tiles(a, b, 5) if len(b) >= 5 and set(a) & set(b) else []
            if tiles and sum(n for *_, n in tiles) / len(b) >= 0.6:
                want.append((doc, item, round(sum(n for *_, n in tiles) / len(b), 6), len(tiles), tiles[0][2]))
    spark.createDataFrame(docs, "doc_id long, text string").createOrReplaceTempView("d")
    keyed, names = D._with_keys(spark.table("d"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = keyed.join(D.matches(spark.table("d"), bench).withColumnsRenamed({"k1": names[0], "k2": names[1]}), names)
    got = [(x.doc_id, x.item_id, round(x.coverage, 6), x.n_tiles, x.longest) for x in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 60
    bad = {(d, t) for (d, *_), t in ((w, None) for w in want)}
    leaky = D.leaks(spark.table("d").selectExpr("*", "1 as _k1", "2 as hits"), bench, out="hits")
    assert leaky.columns == ["doc_id", "text", "_k1", "hits"] and leaky.where("size(hits) > 0").count() >= len(bad)
