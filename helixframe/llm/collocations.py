"""Collocations: frequent phrases of 2 to 4 words, counted in passes that hash the next length (PCY, DHP).

Texts are split into pieces at punctuation and line ends, pieces into words at spaces and tabs; only A-Z are
lower-cased. Pass k counts the phrases of k words that can still be frequent, and at the same time adds
up, in a table of hash buckets, those of k + 1 words both of whose parts of k words can be. Summed over all tasks, the
buckets that reach the least frequency become a bitmap; the frequent phrases of k words themselves become another.
In pass k + 1 a phrase is counted, as the text it is, only if its bucket is frequent and both
its parts of k words are in the second bitmap (Apriori). Bitmaps let some infrequent phrases through and never stop
a frequent one, so counts are exact. Their size is bounded (MOST_BITS); with more text they prune less.

A phrase's score is twice its share of the occurrences of its two parts, in millionths, at the cut where that is lowest.
Phrases that a longer one with at least 80 % of their frequency contains are dropped. Each language has a list of its best.

Null texts are empty, a null language is `und`. Repeated rows count repeatedly; an empty table gives no rows; ties in score go by
frequency, then by the phrase's UTF-8 bytes. Texts of any length are read in blocks that overlap by some words. Other
columns are ignored. Counts are summed in each task before they are shuffled; a part that many phrases share
is looked up in a broadcast table if it has a 100,000th of all words, so at most as many parts of each length have.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import _MULT, Scratch, mix, read_table

LEAST = 30  #: occurrences of a candidate
LONGEST = 4  #: words of a phrase
COVERED = 80  #: per cent of a phrase's occurrences that lie in a longer one which replaces it
TOP = 2000  #: phrases listed for each language; the list is the feature
LEAST_BITS, MOST_BITS = 16, 26  #: of the bucket tables: 2 to the power of so many buckets, of a byte each in a task
CHARS_A_BUCKET = 32
CHUNK = 1 << 12  #: buckets that travel as one row
BLOCK = 4_000_000  #: bytes of text split into words at once
MOST_HELD = 300_000  #: phrases counted in a task before they are handed on
HOT = 100_000  #: a part with at least one in so many words is broadcast

_BORDER = b"."
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
COUNTED = "kind int, lang string, phrase binary, c long, chunk int, payload binary"


class Hashes(dict):
    """word -> odd xxh64; 0 for the border between pieces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = 0 if word == _BORDER else xxhash.xxh64_intdigest(word) | 1
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 150_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def blocks(text: bytes, block: int | None = None, longest: int = LONGEST) -> Iterator[tuple[list[bytes], int]]:
    """(words and borders, how many of them are of the block before)."""
    text, start, before = text.translate(_FOLD), 0, []
    while start < len(text):
        end = text.find(b" ", start + (block or BLOCK))
        end = len(text) if end < 0 else end
        words = before + text[start:end].replace(b"\n", b" . ").split()
        yield words, len(before)
        before, start = words[-longest:], end


def grams(words: np.ndarray, seed: int, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to `longest` words: the hash of the phrase at each place, and whether it lies within a piece."""
    plain = mix(words)
    out = [(mix(plain + np.uint64(seed)), words != 0)]
    for k in range(1, longest):
        h, inside = out[-1]
        if len(h) < 2:
            out.append((h[:0], inside[:0]))
            continue
        out.append((mix(h[:-1] * _MULT[2] + plain[k:]), inside[:-1] & (words[k:] != 0)))
    return out


def seed_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def packed(buckets: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(chunk, payload) of sorted distinct buckets: places in the chunk, then counts of a byte."""
    at = np.searchsorted(buckets, np.arange(0, (int(buckets[-1]) // CHUNK + 2) * CHUNK, CHUNK)) if len(buckets) else [0]
    for chunk in range(len(at) - 1):
        a, b = at[chunk], at[chunk + 1]
        if a < b:
            yield chunk, (buckets[a:b] - chunk * CHUNK).astype("<u2").tobytes() + counts[a:b].astype(np.uint8).tobytes()


def batch_of(phrases: list[tuple[str, bytes, int]], chunks: list[tuple[int, bytes]]) -> pa.RecordBatch:
    m, n = len(phrases), len(chunks)
    columns = [
        pa.array(np.r_[np.zeros(m, np.int32), np.ones(n, np.int32)]),
        pa.array([p[0] for p in phrases] + [None] * n, pa.string()),
        pa.array([p[1] for p in phrases] + [None] * n, pa.binary()),
        pa.array([p[2] for p in phrases] + [None] * n, pa.int64()),
        pa.array([None] * m + [c[0] for c in chunks], pa.int32()),
        pa.array([None] * m + [c[1] for c in chunks], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["kind", "lang", "phrase", "c", "chunk", "payload"])


class Bitmap:
    """One bit a bucket."""

    def __init__(self, bits: int, rows: list):
        self.shift = np.uint64(64 - bits)
        self.bytes = np.zeros(1 << (bits - 3), np.uint8)
        for r in rows:
            self.bytes[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.payload, np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        return (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def folded(rows: DataFrame, bits: int, least: int) -> Bitmap:
    """Buckets whose counts reach `least`; each task adds up the chunks dealt to it as they stream in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(payload) // 3
                table = tables.get(chunk)
                if table is None:
                    table = tables[chunk] = np.zeros(CHUNK, np.int64)
                table[np.frombuffer(payload, "<u2", n)] += np.frombuffer(payload, np.uint8, n, 2 * n)
        out = [(c, np.packbits(t >= least).tobytes()) for c, t in tables.items()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["chunk", "payload"])

    return Bitmap(bits, rows.select("chunk", "payload").repartition("chunk").mapInArrow(run, "chunk int, payload binary").collect())


def counted(docs: DataFrame, k: int, bits: int, buckets, parts, last: bool) -> DataFrame:
    """Counts of phrases of k words that pass both bitmaps (broadcast variables, None in the first pass), and bucket chunks of k + 1."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, found = Hashes(), defaultdict(Counter)
        table = None if last else np.zeros(1 << bits, np.uint8)

        def flush() -> pa.RecordBatch:
            for c in found.values():
                c.pop(_BORDER, None)
            rows = [(lang, p, n) for lang, c in found.items() for p, n in c.items()]
            found.clear()
            return batch_of(rows, [])

        for b in batches:
            texts = defaultdict(list)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts[lang].append(text)
            for lang, some in texts.items():
                for words, carried in blocks(b"\n".join(some)):
                    if k == 1:
                        found[lang].update(words[carried:])
                        if last:
                            continue
                    h = grams(memory.of(words), seed_of(lang), k + (not last))
                    fit = h[k - 1][1]
                    if k > 1:
                        before = parts.value(h[k - 2][0]) & h[k - 2][1]
                        fit = fit & before[:-1] & before[1:] & buckets.value(h[k - 1][0]) if len(fit) else fit
                        at = np.flatnonzero(fit)
                        found[lang].update([b" ".join(words[i : i + k]) for i in at[at + k > carried].tolist()])
                    if not last and len(h[k][0]):
                        longer = h[k][1] & fit[:-1] & fit[1:]
                        longer[: max(0, carried - k)] = False
                        at, n = np.unique((h[k][0][longer] >> shift).astype(np.int64), return_counts=True)
                        table[at] = np.minimum(table[at] + n, 255)
                if sum(map(len, found.values())) > MOST_HELD:
                    yield flush()
        yield flush()
        if not last:
            at = np.flatnonzero(table)
            yield batch_of([], list(packed(at, table[at])))

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, COUNTED)


def bitmap_of(frequent: DataFrame, k: int, bits: int) -> Bitmap:
    """The bitmap of frequent phrases of k words."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = defaultdict(list)
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at[lang] += phrase.split(b" ")
            found = [grams(Hashes().of(words), seed_of(lang), k)[k - 1][0][::k] >> shift for lang, words in at.items()]
            buckets = np.unique(np.concatenate(found).astype(np.int64)) if found else np.empty(0, np.int64)
            yield batch_of([], list(packed(buckets, np.ones(len(buckets)))))

    rows = frequent.select("lang", F.col("phrase").cast("binary").alias("phrase"))
    return folded(rows.mapInArrow(run, COUNTED), bits, 1)


def phrase_counts(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, bits: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for 1 to `longest` words, (lang, phrase, f) of the phrases with f >= least."""
    spark = docs.sparkSession
    if bits is None:
        chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(chars / CHARS_A_BUCKET + 1))))
    words, out, buckets, parts = None, [], None, None
    for k in range(1, longest + 1):
        raw = scratch.keep(counted(docs, k, bits, buckets, parts, k == longest), f"pass{k}")
        phrases = raw.where("kind = 0").groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("c").alias("f"))
        if k == 1:
            words = scratch.keep(raw.where("kind = 0").groupBy("lang").agg(F.sum("c").alias("n")), "words")
        out.append(scratch.keep(phrases.where(F.col("f") >= least), f"frequent{k}"))
        if k < longest:
            buckets = spark.sparkContext.broadcast(folded(raw.where("kind = 1"), bits, least))
            parts = spark.sparkContext.broadcast(bitmap_of(out[-1], k, bits))
        scratch.drop(f"pass{k}")
    return words, out


def _looked_up(rows: DataFrame, hot: DataFrame, cold: DataFrame, key: str, out: str) -> DataFrame:
    """`rows` with the frequency of the phrase in column `key`, which is frequent, so in one of the two tables."""
    side = lambda t: t.select("lang", F.col("phrase").alias(key), F.col("f").alias(out))
    return rows.join(F.broadcast(side(hot)), ["lang", key]).unionByName(rows.join(side(cold), ["lang", key]))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language."""
    scratch = Scratch(docs.sparkSession, "collocations")
    words, counts = phrase_counts(docs, scratch, least, longest, bits)
    every = counts[0]
    for c in counts[1:-1]:
        every = every.unionByName(c)
    candidates = counts[1]
    for c in counts[2:]:
        candidates = candidates.unionByName(c)
    candidates = candidates.withColumn("w", F.split("phrase", " ", -1))
    part = lambda i, n: F.array_join(F.slice("w", i, n), " ")

    m = F.size("w")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), m - 1), lambda n: F.transform(F.sequence(F.lit(1), m - n + 1), lambda i: part(i, n))))
    longer = candidates.where(m > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * covered)).drop("longer")

    total = words.agg(F.sum("n")).first()[0] or 0
    share = -(-total // HOT)
    hot, cold = every.where(F.col("f") >= share), every.where(F.col("f") < share)
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("left"), part(F.col("k") + 1, m - F.col("k")).alias("right"))
    cuts = _looked_up(_looked_up(cuts, hot, cold, "left", "l"), hot, cold, "right", "r").withColumn("score", F.expr("CAST(a AS DECIMAL(20,0)) * 2000000BD DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(F.broadcast(words) if words.count() <= 1_000_000 else words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3), (4)) AS v(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
q AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {LEAST}),
s AS (SELECT q.lang, q.a AS f, array_to_string(ws[i:i + m - 1], ' ') AS phrase
      FROM q, (VALUES (2), (3)) AS v(m), (VALUES (1), (2), (3)) AS u(i) WHERE m < k AND i + m - 1 <= k),
x AS (SELECT lang, phrase, max(f) AS f FROM s GROUP BY ALL),
c AS (SELECT q.* FROM q LEFT JOIN x ON x.lang = q.lang AND x.phrase = q.phrase
      WHERE x.f IS NULL OR 100 * CAST(x.f AS HUGEINT) < {COVERED} * CAST(q.a AS HUGEINT)),
d AS (SELECT c.lang, c.phrase, c.a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp
      FROM c, (VALUES (1), (2), (3)) AS v(j) WHERE j < k),
e AS (SELECT d.lang, d.phrase, d.a, j, l.f AS l, r.f AS r, CAST(2000000 * CAST(d.a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
      FROM d JOIN f l ON l.lang = d.lang AND l.phrase = d.lp JOIN f r ON r.lang = d.lang AND r.phrase = d.rp),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM e),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM b WHERE place = 1)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= {TOP}
"""
