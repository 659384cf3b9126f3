"""Hierarchical packing of documents into sequences of several context sizes.

A document is its token ids and an end id. Whole windows of the largest context size are cut off first; what is
left of each document is routed to the smallest tier (context size, a power of two) that holds it. Tiers are packed
from long to short: windows are opened for the tier's own pieces, longest first, and their gaps are filled from
shorter tiers, best fit first; where no piece fits, the smallest longer one is cut to close the gap and its
rest goes back to the tier of its length. So every sequence is full but the very last. Sequences are numbered tier by tier and
dealt in turn to step groups, so all groups have the same mix of tiers, to one sequence a tier.

Pieces of equal length can stand for each other. Hence the plan is made on the driver from the histogram of lengths alone
(at most as many entries as the largest context has tokens), whatever the number of documents: it says which
ranks of each length go to which sequences and offsets. A piece's rank within its length is the
number of such pieces in earlier partitions of the written token table plus its place in its own, so no task
ever gathers the pieces of a length. A piece then looks up the plan; its ids are read from the written table.

Null and empty texts are documents of the end id alone. Rows that share a doc_id, or have none, are documents of their
own. Texts of any length are tokenised whole; equal rows give pieces of their own. Strings that look like special
tokens are ordinary text. An empty table gives no pieces. Extra columns are ignored. Which of several equally long pieces
goes where depends on how the input is partitioned; lengths, cuts and padding don't.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, narrow, read_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"  #: read on the driver; tasks get its content
TIERS = (128, 256, 512, 1024)  #: context sizes, powers of two
END = 0  #: id at the end of each document
STEP_TOKENS = 65_536  #: tokens of a step group, about
MOST_KNOWN = 700_000  #: remembered pre-tokens; the memory is emptied beyond

# The vocabulary's pre-tokens, for texts of the first 256 code points: contractions, words, numbers, other signs, white space.
_SPACE, _LETTER, _NUMBER = "\\t-\\r\\x20\\x85\\xa0", "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_WORDS = re.compile(f" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_SOLID = re.compile(" ?\\S+")
_WIDE = re.compile("[^\x00-\xff]")
# In others a space before a character that no Unicode version takes for white space begins a pre-token.
_STRETCH = re.compile("(?= [^\\s\\u180e\\u200b\\ufeff])")


class Encoder:
    """Token ids as packed unsigned 16-bit numbers, remembered for each pre-token (or stretch of several)."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.content, self.model = content, Tokenizer.from_str(content)
        self.model.encode_special_tokens = True
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        (self.line,) = self.model.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}

    def __reduce__(self):  # a worker makes its own, which serves all its tasks
        return Encoder, (self.content,)

    def learn(self, pieces: list[str]) -> None:
        """Ids of pieces; those without white space but a leading space are read many at once, as lines."""
        solid, odd = [], []
        for p in pieces:
            (solid if _SOLID.fullmatch(p) else odd).append(p)
        lines = [solid[i : i + 250] for i in range(0, len(solid), 250)]
        for some, e in zip(lines, self.model.encode_batch_fast(["\n".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u2")
            ends = [*(2 * np.flatnonzero(ids == self.line)).tolist(), 2 * len(ids)]
            data, start = ids.tobytes(), 0
            for p, end in zip(some, ends, strict=True):
                self.known[p] = data[start:end]
                start = end + 2
        for p, e in zip(odd, self.model.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.known[p] = np.array(e.ids, "<u2").tobytes()

    def batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, without an end."""
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        cut = [(_STRETCH.split if _WIDE.search(t) else _WORDS.findall)(t) for t in texts]
        self.learn(list(set().union(*cut) - self.known.keys()))
        at = self.known.__getitem__
        for c in cut:
            yield np.frombuffer(b"".join(map(at, c)), "<u2")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


TOKENS = "part int, k long, doc_id long, start long, length int, crc long, doc_tokens long, ids binary"


def tokens(docs: DataFrame, content: str, context: int = TIERS[-1]) -> DataFrame:
    """A row for each whole window and for what is left of a document, with its place among those of its length in its partition.

    Whole windows have the checksum of their ids; what is left has the ids themselves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(content))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = shared.value, TaskContext.get().partitionId(), [0] * (context + 1)
        end = np.array([END], "<u2")
        for b in batches:
            rows: list[list] = [[], [], [], [], [], [], []]
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.batch([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids = np.concatenate([ids, end])
                for start in range(0, len(ids), context):
                    x = ids[start : start + context]
                    whole = len(x) == context
                    for column, v in zip(rows, (seen[len(x)], doc_id, start, len(x), crc(x) if whole else None, len(ids), None if whole else x.tobytes()), strict=True):
                        column.append(v)
                    seen[len(x)] += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(np.full(len(rows[0]), part, np.int32)), *(pa.array(x, t) for x, t in zip(rows, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "k", "doc_id", "start", "length", "crc", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENS)


# --- the plan ----------------------------------------------------------------------------------------------------


class Plan:
    """Where the pieces of each length go, from the counts of lengths alone.

    `entries[l]` lists (first rank, last rank + 1, start in the piece, length, first sequence, offset): of the pieces of length
    l, the one of rank r from the first on has its stretch at `start` in the sequence r - first rank after the first one.
    `tiers` lists (context size, first sequence, sequences), `last` has the length of the sequence that isn't full, or 0.
    """

    def __init__(self, counts: dict[int, int], tiers: tuple[int, ...] = TIERS):
        self.entries: dict[int, list[tuple[int, int, int, int, int, int]]] = defaultdict(list)
        self.tiers: list[tuple[int, int, int]] = []
        self.last = 0
        context = tiers[-1]
        self.stock: dict[int, list[list[int]]] = defaultdict(list)  # available length: [piece's length, first rank, pieces, start]
        for length, n in counts.items():
            if length < context and n:
                self.stock[length].append([length, 0, n, 0])
        self.left = sum(length * n for length, n in counts.items() if length < context)
        self.next = counts.get(context, 0)
        if self.next:
            self.entries[context].append((0, self.next, 0, context, 0, 0))
        first = 0
        for size in reversed(tiers):
            self._tier(size)
            if self.next > first:
                self.tiers.append((size, first, self.next - first))
            first = self.next
        if self.left:  # less than the smallest tier
            self.last = self.left
            offset = 0
            for length in sorted(self.stock, reverse=True):
                for piece, rank, n, start in self.stock[length]:
                    for i in range(n):
                        self.entries[piece].append((rank + i, rank + i + 1, start, length, self.next, offset))
                        offset += length
            self.tiers.append((context, self.next, 1))
            self.next += 1
        self.sequences = self.next
        del self.stock

    def _take(self, length: int, most: int) -> list[int]:
        """Up to `most` pieces of the newest run of that length."""
        run = self.stock[length][-1]
        n = min(most, run[2])
        got = [run[0], run[1], n, run[3]]
        run[1] += n
        run[2] -= n
        if not run[2]:
            self.stock[length].pop()
            if not self.stock[length]:
                del self.stock[length]
        return got

    def _tier(self, size: int) -> None:
        while self.left >= size:
            length = max(x for x in self.stock)
            if length >= size:  # left from a longer tier that ran out of pieces
                self._place(self._take(length, self.left // size), length, size, self.next, 0, size)
                continue
            if length <= size // 2 and size != TIERS[0]:
                return
            n = sum(run[2] for run in self.stock[length])
            n = min(n, self.left // size)
            first = self.next
            gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of (first sequence, sequences)
            self.next += n
            while n:
                got = self._take(length, n)
                self._put(got, length, first, 0)
                gaps[size - length].append((first, got[2]))
                first, n = first + got[2], n - got[2]
            self._fill(gaps, size)

    def _put(self, got: list[int], length: int, sequence: int, offset: int) -> None:
        piece, rank, n, start = got
        self.entries[piece].append((rank, rank + n, start, length, sequence, offset))
        self.left -= n * length

    def _place(self, got: list[int], length: int, used: int, sequence: int, offset: int, size: int) -> None:
        """The first `used` tokens of pieces fill the sequences; the rest goes back."""
        piece, rank, n, start = got
        self._put(got, used, sequence, offset)
        if sequence == self.next:
            self.next += n
        if length > used:
            self.stock[length - used].append([piece, rank, n, start + used])

    def _fill(self, gaps: dict[int, list[tuple[int, int]]], size: int) -> None:
        while gaps:
            gap = max(gaps)
            runs = gaps.pop(gap)
            if not gap:
                continue
            for sequence, n in runs:
                while n:
                    fits = max((x for x in self.stock if x <= gap), default=0)
                    if fits:
                        got = self._take(fits, n)
                        self._put(got, fits, sequence, size - gap)
                        if gap > fits:
                            gaps[gap - fits].append((sequence, got[2]))
                    else:
                        longer = min(self.stock)
                        got = self._take(longer, n)
                        self._place(got, longer, gap, sequence, size - gap, size)
                    sequence, n = sequence + got[2], n - got[2]

    def table(self) -> dict[int, tuple[list[int], list[list[tuple]]]]:
        """length: (first ranks, entries that hold from there on), for a search by rank."""
        out = {}
        for length, entries in self.entries.items():
            at = sorted({r for e in entries for r in e[:2]})
            place = {r: i for i, r in enumerate(at)}
            held: list[list[tuple]] = [[] for _ in at]
            for e in entries:
                for i in range(place[e[0]], place[e[1]]):
                    held[i].append(e)
            out[length] = (at, [sorted(h, key=lambda e: e[2]) for h in held])
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, context int, step long"


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of all documents with their sequences, context sizes and step groups."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    scratch = Scratch(spark, "packing")
    table = scratch.keep(tokens(docs, content, tiers[-1]), "tokens")
    counts = scratch.keep(table.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    plan = Plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, tiers)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = table.join(narrow(base, counts.count()), ["part", "length"]).withColumn("rank", F.col("base") + F.col("k"))
    steps = max(1, round(sum(size * n for size, _, n in plan.tiers) / step_tokens))
    sent = spark.sparkContext.broadcast((plan.table(), plan.tiers, steps))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, sizes, steps = sent.value
        firsts = [first for _, first, _ in sizes]
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, start, length, total, whole, ids, rank in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "crc", "ids", "rank")), strict=True):
                at, held = entries[length]
                for e in held[bisect_right(at, rank) - 1]:
                    sequence = e[4] + rank - e[0]
                    value = whole if ids is None else crc(np.frombuffer(ids, "<u2")[e[2] : e[2] + e[3]])
                    size = sizes[bisect_right(firsts, sequence) - 1][0]
                    for column, v in zip(rows, (doc_id, start + e[2], e[3], value, total, sequence, e[5], size, sequence % steps), strict=True):
                        column.append(v)
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)

    return ranked.select("doc_id", "start", "length", "doc_tokens", "crc", "ids", "rank").mapInArrow(run, PIECES)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
