"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become lower-case words (parts between ASCII white space and ASCII
punctuation). Documents and items meet in a join on shared seeds, the hashes of their SEED-word runs.
A pair that meets is tiled: the longest run of words that both have free is found by Karp-Rabin hashes
of all runs of a length (halving the range of lengths), all equal runs of that length are marked where
they overlap no marked word, and that is repeated with what is left free until no SEED words in a row
agree. The share of the item's words under tiles, however they are ordered in the document, is its
coverage; from THRESHOLD on, the document is contaminated.

The join reads no document that shares no seed with the benchmark: a bitmap of the seeds (at most
SIEVE_BITS bits, whatever the benchmark's size; it lets false ones through, never drops a true one) goes to
all tasks. A document that covers THRESHOLD of an item has at least a known number of its seeds, so an
item is looked up by its rarest seeds only, as many as are needed for one of them to be among those: the
seeds that half of all documents share don't pair everything with everything.

Null or empty texts match nothing, nor do items of fewer than SEED words. Items with a null item_id
are items of their own, null in the result. Rows of the benchmark are told apart, equal ones included:
each gives its own row. Equal rows of documents give equal results. Extra columns stay with the
documents; `leaks` adds one column, which takes the place of a column so named.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, WordHashes, fresh, narrow, read_table, rolling

SEED, THRESHOLD, SIEVE_BITS = 5, 0.6, 1 << 26
_PUNCT = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)


def text_words(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of((text or "").lower().encode().translate(_PUNCT).split())


def tile(text: np.ndarray, item: np.ndarray, seed: int = SEED, least: float = 0.0) -> list[tuple[int, int, int]]:
    """Tiles (text position, item position, length), longest first, ties by position; none if they would cover
    less than `least` of the item even if all equal seeds were tiles."""
    if min(len(text), len(item)) < seed:
        return []
    runs, others = rolling(text, seed), rolling(item, seed)
    free = []
    for mine, theirs in ((runs, others), (others, runs)):
        inside = np.zeros(len(mine) + seed, np.int64)
        at = np.flatnonzero(np.isin(mine, theirs))
        np.add.at(inside, at, 1)
        np.add.at(inside, at + seed, -1)
        free.append(np.flatnonzero(np.cumsum(inside)[: len(mine) + seed - 1] > 0))  # words under equal seeds
    if not len(free[1]) or len(free[1]) < least * len(item):
        return []

    def hashes(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of n free words."""
        if len(at) < n:
            return at[:0], np.empty(0, np.uint64)
        whole = np.flatnonzero(at[n - 1 :] - at[: len(at) - n + 1] == n - 1)
        return at[whole], rolling(words[at], n)[whole]

    def common(n: int) -> bool:
        return bool(np.isin(hashes(item, free[1], n)[1], hashes(text, free[0], n)[1]).any())

    tiles, most = [], min(len(free[0]), len(free[1]))
    while most >= seed and common(seed):
        low = seed
        while low < most:  # the longest common run, as every shorter length has one too
            middle = (low + most + 1) // 2
            low, most = (middle, most) if common(middle) else (low, middle - 1)
        starts, found = hashes(text, free[0], low)
        places = defaultdict(list)
        for p, h in zip(*(x.tolist() for x in hashes(item, free[1], low)), strict=True):
            places[h].append(p)
        places = {h: ps[::-1] for h, ps in places.items()}
        used, done, new = np.zeros(len(item) + 1, bool), -1, []
        ours = np.isin(found, np.fromiter(places, np.uint64, len(places)))
        for t, h in zip(starts[ours].tolist(), found[ours].tolist(), strict=True):
            ps = places[h]
            while t >= done and ps:
                p = ps.pop()
                if not used[p : p + low].any():
                    used[p : p + low], done = True, t + low
                    new.append((t, p, low))
        gone = np.concatenate([np.arange(t, t + low) for t, _, _ in new])
        free = [np.setdiff1d(free[0], gone, assume_unique=True), free[1][~used[free[1]]]]
        tiles += new
        most = min(low - 1, len(free[0]), len(free[1]))
    return tiles


def _seeds(texts: DataFrame, seed: int, sieve=None, bits: int = 0) -> DataFrame:
    """(k1, k2, n, seeds): words and distinct seeds of each text; with a sieve only those that pass, and texts with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, passes = WordHashes(), sieve.value if sieve else None
        for b in batches:
            keep, n, seeds = [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                words = text_words(text, hashes)
                runs = rolling(words, seed)
                if sieve:
                    at = (runs & np.uint64(bits - 1)).astype(np.int64)
                    runs = runs[(passes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
                if len(runs):
                    keep.append(i)
                    n.append(len(words))
                    seeds.append(np.unique(runs).view(np.int64) if sieve else runs.view(np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, seeds)]).astype(np.int32))
            values = pa.array(np.concatenate(seeds) if seeds else np.empty(0, np.int64))
            keys = [b.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, values)], ["k1", "k2", "n", "seeds"])

    return texts.mapInArrow(run, "k1 long, k2 long, n long, seeds array<long>")


def _sieve(seeds: DataFrame):
    """A bitmap of the distinct seeds, as a broadcast, and its size in bits."""
    spark = seeds.sparkSession
    n, bits = seeds.count(), 1 << 20
    while bits < min(64 * n, SIEVE_BITS):
        bits *= 2
    bit = F.col("seed").bitwiseAND(F.lit(bits - 1))
    rows = seeds.select(F.shiftright(bit, 15).alias("bucket"), bit.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    packed = np.zeros(bits // 8, np.uint8)
    for r in rows:
        packed[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["map"], np.uint8)
    return spark.sparkContext.broadcast(packed), bits


def _keys(*columns: F.Column) -> list[F.Column]:
    """Two 64-bit hashes that stand for a row."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """(k1, k2, item_id, coverage, n_tiles, longest): each distinct (doc_id, text) of `docs`, by `_keys`, with the items it contains."""
    scratch, keys, item = Scratch(docs.sparkSession, "decontam"), ["k1", "k2"], ["i1", "i2"]
    a, b = _keys(F.col("doc_id"), F.col("text").cast("string"))
    texts = docs.select(a.alias("k1"), b.alias("k2"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    a, b = _keys(F.col("item_id"), F.col("text"))
    items = scratch.keep(rows.withColumns({"k1": a, "k2": b}).groupBy("k1", "k2", "item_id", "text").agg(F.count("*").alias("copies")), "items")
    places = scratch.keep(_seeds(items.select("k1", "k2", "text"), seed).toDF("i1", "i2", "n", "seeds").select(*item, "n", F.explode("seeds").alias("seed")), "places")
    distinct = scratch.keep(places.select("seed").distinct(), "seeds")
    sieve, bits = _sieve(distinct)
    met = scratch.keep(_seeds(texts, seed, sieve, bits).select(*keys, F.explode("seeds").alias("seed")).join(distinct, "seed", "left_semi").distinct(), "met")

    # An item's seeds that documents have, rarest first; a document that is long enough under tiles has `need` of its places.
    df = met.groupBy("seed").agg(F.count("*").alias("df"))
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * threshold / seed - 1e-9)).cast("int")
    sorted_places = places.join(df, "seed").groupBy(*item, "n").agg(F.sort_array(F.collect_list(F.struct("df", "seed"))).alias("s"))
    rare = sorted_places.where(F.size("s") >= need).select(*item, F.explode(F.array_distinct(F.slice("s.seed", F.lit(1), F.size("s") - need + 1))).alias("seed"))
    pairs = scratch.keep(met.join(rare, "seed").select(*keys, *item).distinct(), "pairs")
    scratch.drop("places", "seeds", "met")

    some = texts.join(narrow(pairs.select(*keys).distinct()), keys, "left_semi").dropDuplicates(keys)
    both = pairs.join(some, keys).join(items.toDF(*item, "item_id", "item", "copies"), item).select(*keys, "item_id", "copies", "text", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            keep, found = [], []
            for i, (text, item) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                words = text_words(item, hashes)
                tiles = tile(text_words(text, hashes), words, seed, threshold)
                coverage = sum(n for *_, n in tiles) / len(words)
                if tiles and coverage >= threshold:
                    keep.append(i)
                    found.append((coverage, len(tiles), tiles[0][2]))
            kept = [c.take(pa.array(keep, pa.int64())) for c in b.columns[:4]]
            new = [pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*kept, *new], ["k1", "k2", "item_id", "copies", "coverage", "n_tiles", "longest"])

    hits = scratch.keep(both.mapInArrow(run, "k1 long, k2 long, item_id long, copies long, coverage double, n_tiles int, longest int"), "hits")
    scratch.drop("items", "pairs")
    sieve.unpersist()
    return hits.select(*keys, "item_id", "coverage", "n_tiles", "longest", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")


def _with_keys(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    names = [fresh(docs, "_k1"), fresh(docs, "_k2")]
    return docs.withColumns(dict(zip(names, _keys(F.col("doc_id"), F.col("text").cast("string")), strict=True))), names


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, out: str = "leaks") -> DataFrame:
    """`docs` with an array of the items that each document contains."""
    keyed, names = _with_keys(docs)
    hit = F.struct("item_id", "coverage", "n_tiles", "longest")
    found = matches(docs, benchmark, threshold).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(hit)).alias("_h")).toDF(*names, fresh(docs, "_h"))
    joined = keyed.drop(out).join(found, names, "left")
    return joined.withColumn(out, F.coalesce(fresh(docs, "_h"), F.array())).drop(*names, *({fresh(docs, "_h")} - {out}))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed, names = _with_keys(docs)
    found = keyed.drop("text").join(matches(docs, read_table(spark, sf_dir, "benchmark")).withColumnsRenamed(dict(zip(("k1", "k2"), names, strict=True))), names)
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_tiles", "longest")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that contain no benchmark item."""
    keyed, names = _with_keys(docs)
    bad = matches(docs, read_table(spark, sf_dir, "benchmark")).select("k1", "k2").distinct().toDF(*names)
    return keyed.join(narrow(bad), names, "left_anti").drop(*names)
