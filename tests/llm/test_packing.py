"""Packing against ids read by the library itself, text by text."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from helixframe.llm.packing import TIERS, Encoder, Plan, op11_packing, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def verify(rows, texts):
    """Each id in one piece, sequences gapless, checksums right, padding in one sequence at most."""
    whole = defaultdict(list)
    for ids in library(texts):
        whole[len(ids)].append(np.array(ids, "<u4"))
    documents, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        documents[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length > 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    short = [n for s in sequences.values() if (n := sum(r.length for r in s)) & (n - 1)]
    assert len(short) <= 1
    assert len({r.sequence_id for r in rows}) == max((r.sequence_id for r in rows), default=-1) + 1
    return documents, sequences


def test_pieces_have_the_librarys_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = op11_packing(spark, SF).collect()
    documents, sequences = verify(rows, [d.text for d in docs])
    assert set(documents) == {d.doc_id for d in docs}
    for d, ids in zip(docs, library([d.text for d in docs]), strict=True):
        at, ids = 0, np.array(ids, "<u4")
        for r in sorted(documents[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    cuts = sum(len(p) - (p[0].doc_tokens - 1) // 1024 - 1 for p in documents.values())
    assert cuts < len(documents)
    groups = defaultdict(lambda: defaultdict(int))
    for r in {r.sequence_id: r for r in rows}.values():
        groups[r.context][r.step] += 1
    for sizes in groups.values():
        assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(max(sizes) + 1)) <= 1


def test_odd_rows(spark):
    long = "word " * 30_000
    rows = [(1, None, 7, "a"), (1, "", 7, "a"), (None, "x y", 1, "b"), (2, long, 1, "b"), (2, long, 1, "b"), (3, "<|endoftext|> zwölf 12² — 中文　 \n x", 0, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank long, ids string")
    got = pack(docs, PATH).collect()
    documents, _ = verify(got, [r[1] for r in rows])
    assert sorted(r.doc_tokens for r in documents[1]) == [1, 1]
    n = len(library([long])[0])
    assert sum(r.length for r in documents[2]) == 2 * n
    ids = np.array(library([rows[-1][1]])[0], "<u4")
    for r in documents[3]:
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert pack(docs.limit(0), PATH).collect() == []


def test_encoder_equals_library():
    random.seed(5)
    signs = [*"ab é ß'st,.  \n\t\r\x0b\x1c\x85\xa0᠎​﻿　中12²½_-<|>", "'s", "'ll", "  ", " \n", "\n ", "<|endoftext|>"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 40))) for _ in range(5_000)]
    with open(PATH, encoding="utf-8") as f:
        got = list(Encoder(f.read()).batch(texts))
    assert [[*g.tolist(), 0] for g in got] == library(texts)


def test_plan_places_every_token_once():
    random.seed(7)
    for trial in range(60):
        kinds, most = random.choice([1, 3, 30, 900]), random.choice([3, 40])
        counts = {random.randint(1, 1024): random.randint(1, most) for _ in range(kinds)}
        plan = Plan(counts)
        used = defaultdict(set)
        pieces = defaultdict(set)
        for length, (at, held) in plan.table().items():
            for rank in range(counts[length]):
                i = max(j for j, r in enumerate(at) if r <= rank)
                spot = 0
                for first, last, start, n, sequence, offset in held[i]:
                    assert first <= rank < last and start == spot
                    spot += n
                    for t in range(offset, offset + n):
                        assert t not in used[sequence + rank - first]
                        used[sequence + rank - first].add(t)
                assert spot == length
                pieces[length].add(rank)
        sizes = [len(u) for u in used.values()]
        assert all(max(u) == len(u) - 1 for u in used.values())
        assert len(sizes) == plan.sequences and sum(1 for s in sizes if s not in TIERS) <= 1
        assert sum(sizes) == sum(x * n for x, n in counts.items())


def test_plan_grows_with_lengths_and_not_with_documents():
    small, large = ({x: n * (1 + x % 7) for x in range(1, 1025)} for n in (10, 10**9))
    a, b = (sum(map(len, Plan(c).entries.values())) for c in (small, large))
    assert b < 10 * a and b < 100_000
