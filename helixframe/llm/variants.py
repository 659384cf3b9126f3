"""Spelling variants: pairs of words one edit apart, found by merging light subtrees of a trie (errata tries).

Runs of letters of whole texts are counted; of a run whose checksum with its document's id is divisible by 97, one letter
is deleted first (misspellings planted by rule). Words of at least 5 letters and 3 occurrences are put into a trie,
whose heaviest child at each node continues the heavy path. Two words that differ by one edit part at one node, and at
least one of them leaves it by a light edge, of which a word has a logarithmic number. So at each of its light edges a
word is merged into its sibling subtrees: with its letter replaced by any (`*`; equal terminals of light
subtrees are pairs), by the heavy child's letter, with its letter skipped, and with the heavy letter put before it;
the last three are pairs if the trie has such a terminal. Each pair is found at one node and one edit, so counts of
near words need no distinct.

The trie is never built whole: words are range-partitioned and sorted, each slice walks its part of the trie, and nodes that may
span slices (prefixes of a slice's first or last word, known by hashes) get their heavy child from counts summed over slices.
Members of a merged terminal are at most as many as letters, near words of a word at most some hundred a letter, so no
group grows with the data. A word's form is its near word of most occurrences if it has at least twice its own; roots
are handed down level by level, each level a written table; there are at most as many levels as occurrences have doublings.

Null and empty texts have no words; a null doc_id counts as the empty string. Rows that share a doc_id, and equal rows, all
count. Texts of any length are read in blocks, words of any length are handled in time linear in their letters. Ties go to the smallest
word in code-point order. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, read_table

LEAST, SHORTEST = 3, 5  #: occurrences and letters of a word
EVERY = 97  #: runs whose checksum this divides lose a letter
TIMES = 2  #: a form has at least so many times a word's occurrences
SLICE = 20_000  #: words of a slice of the trie, about
BLOCK = 4_000_000  #: letters of a text read at once
MOST_HELD = 300_000  #: words counted in a task before they are handed on
ANY = "*"

# One byte a code point: letters of the first 256 stay, A-Z in lower case, all else parts words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str, block: int = BLOCK) -> Iterator[list[bytes]]:
    """Runs of letters of a text, block by block, one byte a letter."""
    letters = text.encode("latin-1", "replace").translate(_LETTERS)
    start = 0
    while start < len(letters):
        end = letters.find(b" ", start + block)
        end = len(letters) if end < 0 else end
        yield letters[start:end].split()
        start = end


def misspelt(words: list[bytes], doc_id: str) -> Iterator[tuple[bytes, bytes]]:
    """(run, what is left of it) of the distinct runs that lose a letter in this document."""
    distinct = list(set(words))
    plain = [w if w.isascii() else w.decode("latin-1").encode() for w in distinct]
    h = np.fromiter(map(zlib.crc32, plain, repeat(zlib.crc32(f"{doc_id}:".encode()))), np.int64, len(plain))
    for i in np.flatnonzero(h % EVERY == 0).tolist():
        w = distinct[i]
        at = int(h[i]) % len(w)
        yield w, w[:at] + w[at + 1 :]


def word_counts(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """(word, n) of the words of at least `shortest` letters and `least` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(w, n) for w, n in found.items() if n and len(w) >= shortest]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "c"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for words in runs(text):
                    found.update(words)
                    changed = list(misspelt(words, doc_id))
                    if changed:
                        own = Counter(words)
                        for w, left in changed:
                            found[w] -= own[w]
                            found[left] += own[w]
                    if len(found) > MOST_HELD:
                        yield flush()
        yield flush()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    counted = texts.mapInArrow(run, "word string, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("n")).where(F.col("n") >= least)


# --- the trie ----------------------------------------------------------------------------------------------------


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a and b share `low` letters, not `high`
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def children(words: list[str], low: int, high: int, depth: int) -> list[tuple[str, int, int]]:
    """(letter, first, last + 1) of the parts of words[low:high] by the letter after `depth`; '' for a word that ends there."""
    out = []
    while low < high:
        c = words[low][depth : depth + 1]
        if words[high - 1][depth : depth + 1] == c:
            return [*out, (c, low, high)]
        end = bisect_left(words, words[low][:depth] + chr(ord(c) + 1), low + 1, high) if c else low + 1
        out.append((c, low, end))
        low = end
    return out


def prefix_hashes(word: str) -> list[bytes]:
    """A hash of each prefix, the empty one and the whole word included."""
    h = xxhash.xxh3_128()
    out = [h.digest()]
    for c in word:
        h.update(c.encode())
        out.append(h.digest())
    return out


def spine(part: int, words: list[str]) -> list[tuple[int, bytes, str, int]]:
    """(part, node, letter, words below in this slice) of the prefixes of the first and the last word."""
    out, seen = [], set()
    for end in (0, len(words) - 1):
        low, high = 0, len(words)
        for depth, node in enumerate(prefix_hashes(words[end])):
            parts = children(words, low, high, depth)
            if node not in seen:
                seen.add(node)
                out += [(part, node, c, b - a) for c, a, b in parts]
            low, high = next(((a, b) for c, a, b in parts if a <= end < b), (low, high))
    return out


def merged(words: list[str], counts: list[int], shared: dict[bytes, tuple[str, int]], shortest: int = SHORTEST) -> Iterator[tuple[str, str, int, bool]]:
    """(terminal, word, its count, whether any letter stands in the terminal) of light words merged into their siblings.

    `shared` gives the heavy letter and the number of letters that go on, of nodes that may span slices.
    """
    last = len(words) - 1
    along = []
    for end in {0, last}:
        along.append((end, [(d, shared[h]) for d, h in enumerate(prefix_hashes(words[end])) if h in shared]))
    todo = [(0, last + 1, 0)]
    while todo:
        low, high, depth = todo.pop()
        at = common_prefix(words[low], words[high - 1]) if high - low > 1 else None
        heavy, letters = None, 0
        for end, nodes in along:
            if low <= end < high:
                d, node = next(((d, n) for d, n in nodes if d >= depth), (None, None))
                if d is not None and (at is None or d <= at):
                    at, (heavy, letters) = d, node
        if at is None:
            continue
        parts = children(words, low, high, at)
        if heavy is None:
            going = [(a - b, c) for c, a, b in parts if c]
            heavy, letters = min(going)[1], len(going)
        for c, a, b in parts:
            if c == heavy:
                pass
            elif not c:
                if at + 1 >= shortest:
                    yield words[a] + heavy, words[a], counts[a], False
                continue
            else:
                p = words[a][:at]
                for i in range(a, b):
                    w, n = words[i], counts[i]
                    s = w[at + 1 :]
                    if letters > 2:
                        yield p + ANY + s, w, n, True
                    yield p + heavy + s, w, n, False
                    if s[:1] != c and len(w) > shortest:
                        yield p + s, w, n, False
                    yield p + heavy + w[at:], w, n, False
            todo.append((a, b, at + 1))


def merged_terminals(words: DataFrame, scratch: Scratch, slice_words: int = SLICE, shortest: int = SHORTEST) -> DataFrame:
    """(terminal, word, n, joker) of all words of the written table `words` at their light edges."""
    slices = max(1, -(-words.count() // slice_words))
    cut = scratch.keep(words.repartitionByRange(slices, "word").withColumn("part", F.spark_partition_id()), "slices")

    def spines(t: pa.Table) -> pa.Table:
        rows = spine(t["part"][0].as_py(), sorted(t["word"].to_pylist()))
        kinds = (pa.int32(), pa.binary(), pa.string(), pa.int64())
        return pa.table({n: pa.array(x, k) for n, x, k in zip(("part", "node", "letter", "c"), zip(*rows, strict=True), kinds, strict=True)})

    ends = scratch.keep(cut.select("part", "word").groupBy("part").applyInArrow(spines, "part int, node binary, letter string, c long"), "spines")
    below = ends.groupBy("node", "letter").agg(F.sum("c").alias("c"))
    going = F.col("letter") != ""
    nodes = below.groupBy("node").agg(F.min(F.when(going, F.struct(-F.col("c"), "letter"))).getField("letter").alias("heavy"), F.count(F.when(going, 1)).alias("letters"), F.count("*").alias("ways"))
    nodes = ends.select("part", "node").distinct().join(nodes.where("ways > 1"), "node")
    spanning = nodes.select("part", F.lit(None).cast("string").alias("word"), F.col("letters").alias("n"), "node", "heavy")
    rows = cut.select("part", "word", "n", F.lit(None).cast("binary").alias("node"), F.lit(None).cast("string").alias("heavy")).unionByName(spanning)

    def walk(t: pa.Table) -> pa.Table:
        own, shared = [], {}
        for word, n, node, heavy in zip(*(t[c].to_pylist() for c in ("word", "n", "node", "heavy")), strict=True):
            if node is None:
                own.append((word, n))
            else:
                shared[node] = (heavy, n)
        own.sort()
        found = list(merged([w for w, _ in own], [n for _, n in own], shared, shortest))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_())
        columns = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("terminal", "word", "n", "joker"), columns, kinds, strict=True)})

    return scratch.keep(rows.groupBy("part").applyInArrow(walk, "terminal string, word string, n long, joker boolean"), "terminals")


def near_words(words: DataFrame, scratch: Scratch, slice_words: int = SLICE, shortest: int = SHORTEST) -> DataFrame:
    """(word, n_near, near, near_n): how many words are one edit away, and the one of most occurrences."""
    terminals = merged_terminals(words, scratch, slice_words, shortest)
    found = terminals.where("NOT joker").join(words.select(F.col("word").alias("terminal"), F.col("n").alias("m")), "terminal")
    pairs = found.select("word", F.lit(1).cast("long").alias("c"), F.col("terminal").alias("near"), F.col("m").alias("near_n"))
    pairs = pairs.unionByName(found.select(F.col("terminal").alias("word"), F.lit(1).cast("long").alias("c"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    meet = terminals.where("joker").groupBy("terminal").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("g")).where(F.size("g") > 1)  # as many as letters at most
    of = meet.select(F.explode("g").alias("x"), F.size("g").alias("size"), F.col("g")[0].alias("a"), F.col("g")[1].alias("b"))
    best = F.when(F.col("x.word") == F.col("a.word"), F.col("b")).otherwise(F.col("a"))
    of = of.select(F.col("x.word").alias("word"), (F.col("size") - 1).cast("long").alias("c"), best["word"].alias("near"), (-best["n"]).alias("near_n"))
    every = pairs.unionByName(of).groupBy("word").agg(F.sum("c").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("x"))
    return every.select("word", "n_near", "x.near", (-F.col("x.n")).alias("near_n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the written (word, form) pairs: forms followed to the last."""
    own = forms.select(F.col("word").alias("form"), F.lit(True).alias("more")).distinct()
    rest = scratch.keep(forms.join(own, "form", "left").select("word", "form", F.when(F.col("more").isNull(), F.col("form")).alias("root")), "level0")
    out, level = rest.where("root IS NOT NULL").select("word", "root"), 0
    newest = out
    while (left := rest.where("root IS NULL").select("word", "form")).limit(1).count():
        level += 1
        known = newest.select(F.col("word").alias("form"), "root")
        rest = scratch.keep(left.join(known, "form", "left").select("word", "form", "root"), f"level{level}")
        newest = rest.where("root IS NOT NULL").select("word", "root")
        out = out.unionByName(newest)
    return out


def variants(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, times: int = TIMES, slice_words: int = SLICE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words."""
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.keep(word_counts(docs, least, shortest), "words")
    near = words.join(near_words(words, scratch, slice_words, shortest), "word", "left")
    follows = F.col("near_n") >= times * F.col("n")
    known = scratch.keep(near.select("word", F.when(follows, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("near_n")).alias("form_n")), "known")
    scratch.drop("slices", "spines", "terminals", "words")
    last = roots(known.where("form IS NOT NULL").select("word", "form"), scratch)
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _crc_step(a: str) -> str:
    return f"xor({a} >> 4, [{_NIBBLES}][1 + CAST({a} & 15 AS INTEGER)])"


def _nibbles() -> str:
    """The checksum's table for four bits, from its polynomial."""
    out = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(f"{i}::UBIGINT")
    return ", ".join(out)


_NIBBLES = _nibbles()
ORACLE = f"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS w FROM documents),
g AS (SELECT id, w, count(*) AS n FROM r GROUP BY ALL),
y AS (SELECT w, n, flatten(list_transform(string_split(id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS UBIGINT)]
      ELSE [CAST(192 + (unicode(c) >> 6) AS UBIGINT), CAST(128 + (unicode(c) & 63) AS UBIGINT)] END)) AS bytes FROM g),
h AS (SELECT w, n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda a, x: {_crc_step(_crc_step("xor(a, x)"))})) AS h FROM y),
z AS (SELECT CASE WHEN h % {EVERY} = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM z WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
k AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) AS p, substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
d AS (SELECT DISTINCT k.word AS a, k.n AS an, v.word AS b, v.n AS bn FROM k JOIN v ON v.word = k.p || k.s),
e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM k x JOIN k y ON x.p = y.p AND x.s = y.s AND x.i = y.i AND x.word <> y.word
      UNION ALL SELECT a, b, bn FROM d UNION ALL SELECT b, a, an FROM d),
m AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM e),
f AS MATERIALIZED (SELECT v.word, CASE WHEN near_n >= {TIMES} * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * n THEN near_n END AS form_n
      FROM v LEFT JOIN m ON m.word = v.word AND place = 1),
t AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.next)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word AND t.next IS NULL
"""
