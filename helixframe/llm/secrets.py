"""Secret scan with formats learned by grammar inference.

Base patterns find three kinds of credentials (assignments, access keys, hex strings). What they
find is labelled by kind, written as a sequence of character classes, and put into one prefix tree
a kind; states whose next-symbol and ending frequencies agree under Hoeffding's bound are merged,
first those at one distance from the start, then, where there is evidence enough, across distances, which
leaves a small probabilistic automaton a kind. A further
automaton is learned from ordinary long words. Every candidate, that is every run of 12 or more
credential characters, is then scored, less what base spans cover of it and less trailing
punctuation, by the mean log-likelihood ratio, per symbol, of the best credential automaton against
the ordinary one; from LEAST_BITS on it is a span of kind `learned`, provided that the automaton
itself gives it at least LEAST_FIT a symbol. Formats that are common among unlabelled long words, LEAST_SEEN times
in the sample, count as ordinary, whatever they are.

Null texts count as empty and have no spans. Positions are code points, ends exclusive. Learning
uses a bounded sample, gathered from all documents with a bounded heap a partition: at most SAMPLE
distinct class sequences a kind (those with the smallest hash), whole ones, of up to LONGEST symbols
each and SYMBOLS in all; scanning covers every row, whole texts and candidates of any length, row by
row, without a shuffle. With nothing to learn from, only base spans are found. A sequence is learned once, however
often it or its row repeats; of sequences whose hashes tie at the edge of the sample, the first in order of their text stays. Equal texts give
equal spans. Extra columns are carried along by `scan`, whose `spans` takes the place of a column so named.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, read_table

KINDS = ("assign", "access", "hex", "learned")
SAMPLE = 1500  #: class sequences a kind that learning may use
LONGEST, SYMBOLS = 2_000, 300_000  #: symbols of one sequence, and of all of a kind, that learning may use
ALPHA = 0.05  #: of Hoeffding's bound
LEAST_SEEN = 20  #: sequences through a state that make evidence for a merge across distances
LEAST_BITS = 1.0
LEAST_FIT = -3.0  #: mean log2 likelihood a symbol that a credential needs, whatever ordinary words have
LEAST_LENGTH = 12
_FLOOR = math.log2(1e-4)

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}+")
_IS_HEX = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_CLASSES = str.maketrans({c: k for k, cs in {"d": "0123456789", "x": "abcdef", "l": "ghijklmnopqrstuvwxyz", "X": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "s": "+/_.=-"}.items() for c in cs})

Span = tuple[int, int, int, str]  # start, kind, end, value


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, less those that are too short."""
    out: list[Span] = []
    lower = text.lower()
    if any(x in lower for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"\x01" * 16 in text.encode().translate(_IS_HEX):
        out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def classes(value: str) -> str:
    return value.translate(_CLASSES)


def candidates(text: str, found: list[Span]) -> Iterator[tuple[int, str]]:
    """(start, value) of every run of credential characters, less the base spans `found` and trailing punctuation."""
    taken, i = sorted((a, z) for a, _, z, _ in found), 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while i < len(taken) and taken[i][0] < end:
            a, z = taken[i]
            if a - start >= LEAST_LENGTH and len(value := text[start:a].rstrip(".=-_")) >= LEAST_LENGTH:
                yield start, value
            start = max(start, z)
            if z > end:
                break  # it may reach into the next run
            i += 1
        if end - start >= LEAST_LENGTH and len(value := text[start:end].rstrip(".=-_")) >= LEAST_LENGTH:
            yield start, value


# --- inference ---------------------------------------------------------------------------------------------------


class Automaton:
    """A probabilistic automaton, learned by merging compatible states of a prefix tree.

    First states at the same distance from the start are merged, from the most frequent on, if their next symbols, endings and
    subtrees agree under the bound and what may still follow them is of lengths that overlap; so where few sequences
    are left, position and remaining length decide. What remains is compared across distances, by red and blue
    states: a blue state, the most frequent first, joins a red one if both have been seen LEAST_SEEN times and every pair of states
    reached from them that has been seen as often agrees; a state of less evidence stays by itself. So formats of one length keep it,
    and words of many lengths become loops.
    """

    def __init__(self, strings: list[str], alpha: float = ALPHA, least: int = 1):
        """`least`: states seen fewer times are learned from, but not entered when sequences are scored."""
        self.least = least
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.total, self.final = [0], [0]
        for s in strings:
            self._add(s)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.low, self.high = [0] * len(self.next), [0] * len(self.next)  # least and greatest length of what may follow
        for q in range(len(self.next) - 1, -1, -1):
            ends = [0] * (self.final[q] > 0)
            self.low[q] = min(ends + [self.low[to] + 1 for to in self.next[q].values()], default=0)
            self.high[q] = max(ends + [self.high[to] + 1 for to in self.next[q].values()], default=0)
        self._merge_levels()
        self._merge_across()
        self._weigh()

    def _add(self, s: str) -> None:
        at = 0
        for c in s:
            self.total[at] += 1
            self.count[at][c] = self.count[at].get(c, 0) + 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.count.append({})
                self.total.append(0)
                self.final.append(0)
            at = self.next[at][c]
        self.total[at] += 1
        self.final[at] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _agree(self, r: int, b: int, least: int = 0) -> bool:
        """Whether r and b, and all pairs of states that the same symbols lead to, agree; pairs seen under `least` times aren't judged."""
        todo, seen = [(r, b)], {(r, b)}
        while todo:
            r, b = todo.pop()
            n, m = self.total[r], self.total[b]
            if min(n, m) < least:
                continue
            if self._differ(self.final[r], n, self.final[b], m):
                return False
            for c in self.next[b].keys() | self.next[r].keys():
                if self._differ(self.count[r].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
                if c in self.next[r] and c in self.next[b] and (pair := (self.next[r][c], self.next[b][c])) not in seen:
                    seen.add(pair)
                    todo.append(pair)
        return True

    def _fold(self, r: int, b: int) -> None:
        """Adds the tree below b to the states from r on."""
        todo = [(r, b)]
        while todo:
            r, b = todo.pop()
            self.total[r] += self.total[b]
            self.final[r] += self.final[b]
            self.low[r], self.high[r] = min(self.low[r], self.low[b]), max(self.high[r], self.high[b])
            for c, n in self.count[b].items():
                self.count[r][c] = self.count[r].get(c, 0) + n
            for c, to in self.next[b].items():
                if c in self.next[r]:
                    todo.append((self.next[r][c], to))
                else:
                    self.next[r][c] = to

    def _merge_levels(self) -> None:
        level = [0]
        while level:
            below = sorted(((to, q, c) for q in level for c, to in self.next[q].items()), key=lambda x: (-self.total[x[0]], x[0]))
            level = []
            for b, q, c in below:
                r = next((r for r in level if self.low[r] <= self.high[b] and self.low[b] <= self.high[r] and self._agree(r, b)), None)
                if r is None:
                    level.append(b)
                else:
                    self.next[q][c] = r
                    self._fold(r, b)

    def _merge_across(self) -> None:
        self.red, joined = [0], {}
        blue = set(self.next[0].values())
        while blue:
            b = min(blue, key=lambda q: (-self.total[q], q))
            blue.discard(b)
            r = None
            if self.total[b] >= LEAST_SEEN:
                r = next((r for r in self.red if self.total[r] >= LEAST_SEEN and self._agree(r, b, LEAST_SEEN)), None)
            if r is not None:
                joined[b] = r
                continue
            self.red.append(b)
            blue |= set(self.next[b].values()) - set(self.red) - joined.keys()
        for q in self.red:
            self.next[q] = {c: joined.get(to, to) for c, to in self.next[q].items()}

    def _weigh(self) -> None:
        """Logarithms of smoothed probabilities of the states that are left."""
        place = {q: i for i, q in enumerate(self.red)}
        self.steps = []
        for q in self.red:
            n = self.total[q] + 0.7
            self.steps.append(({c: (place[to], math.log2((self.count[q][c] + 0.1) / n)) for c, to in self.next[q].items() if self.total[to] >= self.least}, math.log2((self.final[q] + 0.1) / n)))
        del self.next, self.count, self.total, self.final, self.low, self.high

    def bits(self, s: str) -> float:
        """Mean log2 likelihood per symbol, the ending included."""
        at, total = 0, 0.0
        for c in s:
            to, p = self.steps[at][0].get(c, (at, _FLOOR))
            at, total = to, total + p
        return (total + self.steps[at][1]) / (len(s) + 1)


class Formats:
    """Automata of credentials and of ordinary words; small, sent to tasks with the scan."""

    def __init__(self, samples: dict[int, list[str]]):
        self.known = [Automaton(samples[k]) for k in (0, 1, 2) if samples.get(k)]
        self.ordinary = Automaton(samples.get(3, []), least=LEAST_SEEN)
        self.seen: dict[str, bool] = {}

    def score(self, value: str) -> float:
        s = classes(value)
        best = max((a.bits(s) for a in self.known), default=-1e9)
        return best - self.ordinary.bits(s) if best >= LEAST_FIT else -1e9

    def likely(self, value: str) -> bool:
        """Whether the score is enough; answers for short sequences are remembered."""
        if len(value) > 64:
            return self.score(value) >= LEAST_BITS
        s = classes(value)
        hit = self.seen.get(s)
        if hit is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            hit = self.seen[s] = self.score(value) >= LEAST_BITS
        return hit

    def spans(self, text: str) -> list[Span]:
        """Base and learned spans, by start and kind."""
        found = base_spans(text)
        if not self.known:
            return found
        extra = [(start, 3, start + len(value), value) for start, value in candidates(text, found) if self.likely(value)]
        return sorted(found + extra) if extra else found


def gather(docs: DataFrame, most: int = SAMPLE) -> dict[int, list[str]]:
    """At most `most` distinct class sequences of each kind (3: ordinary words), those of the smallest hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: list[list[tuple[int, str]]] = [[], [], [], []]
        held: list[set[str]] = [set(), set(), set(), set()]

        def put(kind: int, value: str) -> None:
            s = classes(value)
            if s in held[kind] or len(s) > LONGEST:
                return
            item = (-(xxhash.xxh64_intdigest(s) >> 1), s)
            if len(heaps[kind]) < most:
                heapq.heappush(heaps[kind], item)
                held[kind].add(s)
            elif item > heaps[kind][0]:
                held[kind].discard(heapq.heapreplace(heaps[kind], item)[1])
                held[kind].add(s)

        for pdf in frames:
            for text in pdf["text"]:
                found = base_spans(text)
                for _, kind, _, value in found:
                    put(kind, value)
                for _, value in candidates(text, found):
                    put(3, value)
        rows = [(k, -h, s) for k in range(4) for h, s in heaps[k]]
        kind, order, value = zip(*rows, strict=True) if rows else ((), (), ())
        yield pd.DataFrame({"kind": pd.Series(kind, dtype="int32"), "o": pd.Series(order, dtype="int64"), "s": pd.Series(value, dtype=object)})

    found = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInPandas(run, "kind int, o long, s string").distinct()
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.keep(found, "found").withColumn("bits", F.length(F.bin("o")))
    # Hashes are spread evenly, so each length in bits holds about as many as all shorter ones: those up to the
    # length that completes the sample are about twice the sample, however many partitions there are.
    last: dict[int, int] = {}
    seen = [0, 0, 0, 0]
    for r in found.groupBy("kind", "bits").agg(F.count("*").alias("c")).orderBy("kind", "bits").collect():
        if seen[r.kind] < most:
            last[r.kind] = r.bits
        seen[r.kind] += r.c
    enough = F.lit(False)
    for kind, bits in last.items():
        enough |= (F.col("kind") == kind) & (F.col("bits") <= bits)
    out: dict[int, list[str]] = {}
    size = [0, 0, 0, 0]
    for r in sorted(found.where(enough).select("kind", "o", "s").collect()):
        chosen = out.setdefault(r.kind, [])
        if len(chosen) < most and size[r.kind] + len(r.s) <= SYMBOLS:
            chosen.append(r.s)
            size[r.kind] += len(r.s)
    scratch.drop("found")
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, formats: Formats, out: str = "spans") -> DataFrame:
    """`docs` with the spans of each text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": z} for a, k, z, _ in formats.spans(t or "")] for t in column], dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, SPANS)(F.col("text").cast("string")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, Formats(gather(docs))).select("doc_id", "spans")
    text = lambda x: F.concat_ws(",", F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
