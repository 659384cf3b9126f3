"""Repeated passages by sparse suffix arrays.

Words are parts between ASCII white space, A-Z in lower case. A suffix of a text is kept only where
its first PHRASE words have the smallest hash of some WINDOW neighbouring positions (a minimiser),
so the choice depends on content alone: equal passages of LEAST = PHRASE + WINDOW - 1 words or more
keep suffixes at the same places. The kept suffixes are sorted by the hashes of their first PHRASE
words and each is compared with its neighbours; those that differ from both are dropped. Each other
one is extended, word by word to the left and to the right, to all LEAST-word runs of which it is the
minimiser; the runs are sorted (by 64-bit fingerprints) and compared with their neighbours in turn.
Overlapping and touching runs of a text merge into maximal repeated spans. The result is exact for
every passage of LEAST words or more, within one text too, up to fingerprint collisions.

Equal texts are found first, as neighbours too: all of a text that has an equal of LEAST words or more
is one span, and one of the equals (smallest doc_id) stands for all in the search. A span is `first` if
each of its runs has its first occurrence (smallest doc_id, then position) there; the whole of an equal
text is if it is the one that stands for all and none of its runs occurs first in another text. Texts
that are null, empty or shorter than LEAST words have no spans. Rows with a null doc_id are left out.
Of rows that share a doc_id the spans of each text are listed, once. Extra columns are ignored.

All three sorts are range partitions by hash and place together (`common.sorted_groups`), so a suffix,
run or text that a third of all documents hold is spread over many tasks, and none of its places is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, WordHashes, narrow, read_table, rolling, sorted_groups

PHRASE, WINDOW = 25, 26


def minimisers(phrases: np.ndarray, w: int) -> np.ndarray:
    """For each window of w positions the leftmost position of its smallest value; none if there are fewer."""
    if len(phrases) < w:
        return np.empty(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(phrases, w)
    return np.argmin(low, axis=1) + np.arange(len(low))


def _words(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of((text or "").encode().lower().split())


def _halves(words: np.ndarray) -> tuple[int, int]:
    """A text's signature as two longs."""
    sig = xxhash.xxh3_128_digest(words.tobytes())
    return int.from_bytes(sig[:8], "little", signed=True), int.from_bytes(sig[8:], "little", signed=True)


class Repeats:
    def __init__(self, docs: DataFrame, phrase: int = PHRASE, window: int = WINDOW):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
        self.k, self.w, self.least = phrase, window, phrase + window - 1
        self.scratch = Scratch(docs.sparkSession, "suffix")

    def kept(self) -> DataFrame:
        """(doc_id, n, which, rest, keys, at): length, signature and kept suffixes of each text of LEAST words or more."""
        k, w, least = self.k, self.w, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                ids, n, sig, keys, at = [], [], [], [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = _words(text, hashes)
                    if len(words) < least:
                        continue
                    phrases = rolling(words, k)
                    places = np.unique(minimisers(phrases, w))
                    ids.append(doc)
                    n.append(len(words))
                    sig.append(_halves(words))
                    keys.append(phrases[places].view(np.int64))
                    at.append(places.astype(np.int64))
                offsets = pa.array(np.cumsum([0, *map(len, at)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.empty(0, np.int64))) for x in (keys, at)]
                halves = [pa.array([x[i] for x in sig], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *halves, *lists], ["doc_id", "n", "which", "rest", "keys", "at"])

        return self.docs.mapInArrow(run, "doc_id long, n long, which long, rest long, keys array<long>, at array<long>")

    def runs(self, texts: DataFrame) -> DataFrame:
        """(doc_id, which, print, start): the LEAST-word runs whose minimiser is one of the suffixes in `at`."""
        k, w, least = self.k, self.w, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                starts, prints = [], []
                for text, at, which in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                    words = _words(text, hashes)
                    if _halves(words)[0] != which:  # another text of the same doc_id
                        words = words[:0]
                    ours = np.isin(minimisers(rolling(words, k), w), at.values.to_numpy())
                    found = np.flatnonzero(ours)
                    starts.append(found.astype(np.int64))
                    prints.append(rolling(words, least)[found].view(np.int64))
                offsets = pa.array(np.cumsum([0, *map(len, starts)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.empty(0, np.int64))) for x in (prints, starts)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), *lists], ["doc_id", "which", "prints", "starts"])

        found = texts.mapInArrow(run, "doc_id long, which long, prints array<long>, starts array<long>")
        return found.select("doc_id", "which", F.explode(F.arrays_zip("prints", "starts")).alias("x")).select("doc_id", "which", F.col("x.prints").alias("print"), F.col("x.starts").alias("start"))

    def run(self) -> DataFrame:
        """(doc_id, start, end, first): repeated spans in words, ends exclusive."""
        s, text = self.scratch, ["doc_id", "which"]
        kept = s.keep(self.kept(), "kept")
        equal = sorted_groups(s, kept.select("which", "rest", "doc_id", "n"), ["which", "rest"], ["doc_id"], "equal")
        copies = s.keep(equal.where("repeated").select(*text, "n", F.col("first_doc_id").alias("rep")).distinct(), "copies")
        others = kept.join(narrow(copies.where("doc_id <> rep").select(*text)), text, "left_anti")

        suffixes = others.select(*text, F.explode(F.arrays_zip("keys", "at")).alias("x")).select(*text, F.col("x.keys").alias("key"), F.col("x.at").alias("at"))
        suffixes = s.keep(suffixes, "suffixes")
        array = sorted_groups(s, suffixes, ["key"], [*text, "at"], "array", distinct=True)
        anchors = s.keep(array.where("repeated").groupBy(*text).agg(F.collect_list("at").alias("at")), "anchors")
        s.drop("kept", "suffixes", "array", "equal")
        some = self.docs.join(narrow(anchors.select("doc_id").distinct()), "doc_id", "left_semi").join(anchors, "doc_id").select("doc_id", "text", "at", "which")
        runs = s.keep(self.runs(some), "runs")
        s.drop("anchors")

        place, first = [*text, "start"], [f"first_{c}" for c in (*text, "start")]
        hits = sorted_groups(s, runs, ["print"], place, "hits", distinct=True).where("repeated")
        hits = hits.select(*place, (F.struct(*place) == F.struct(*first)).alias("first"), (F.struct(*text) == F.struct(*first[:2])).alias("home"))
        by_doc = W.partitionBy(*text).orderBy("start")
        hits = hits.withColumn("new", (F.col("start") > F.coalesce(F.lag("start").over(by_doc), F.lit(-(1 << 30))) + self.least).cast("int"))
        hits = hits.withColumn("island", F.sum("new").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
        spans = hits.groupBy(*text, "island").agg(F.min("start").alias("start"), (F.max("start") + self.least).alias("end"), F.min("first").alias("first"), F.min("home").alias("home")).drop("island")

        spans = s.keep(spans, "spans")
        s.drop("runs", "hits", "hits-ends", "array-ends", "equal-ends")
        away = spans.where("not home").select(*text).distinct().withColumn("away", F.lit(True))
        spans = spans.join(narrow(copies.select(*text)), text, "left_anti").select("doc_id", "start", "end", "first")
        first = (F.col("doc_id") == F.col("rep")) & F.col("away").isNull()
        whole = copies.join(narrow(away), text, "left").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), first.alias("first"))
        return spans.union(whole)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated passages are not listed."""
    return Repeats(read_table(spark, sf_dir, "documents")).run()
