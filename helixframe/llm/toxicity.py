"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read a clause, each with its own states:

* *insult*: a lexical transducer; it may read a word as an `insult`, weighed by the log-odds of the
  longest of its arcs (whole words or word beginnings) that accepts the word. The arcs are learned
  from labelled rows; a short list of English seeds counts as prior evidence;
* *threat*: a threatening verb, completed by a target among the next four words; a few English verbs are given,
  further words are learned like the insult's arcs, from how often they stand so before a target;
* *target*: second and third person and group words; an insult up to three words after one gains a
  quarter, and so does a target up to three words after an insult;
* *negation*: for three words after a negating word, what is read weighs a quarter;
* *reported speech*: from a reporting verb to the end of the clause, it weighs half.

A word may be read in several ways (as an insult, a threatening verb, a plain word, ...), so a clause
has many paths. The machines are composed once, on the driver, into one weighted automaton over their
reachable joint states: gains add up, factors multiply. A clause's score is the weight of its best
path (Viterbi), so clauses are scored, not isolated words. A document's features are its strongest
clause and the sum over its clauses, both squashed by log1p, and the mean over them; a logistic curve fitted on the same
labelled rows maps them to 0..1.

Nulls count as empty texts, which get the score of a text without any match. Rows whose doc_id
is null are scored like others, never used for learning, and not held out. Repeated label rows of a
document count once, as toxic if any says so. Other columns of the input are carried along by
`Model.score`, which adds `score` (or takes the place of a column so named). With no labelled row of
one class, the seeds alone score.

Learning takes at most SAMPLE rows a class (those with the smallest md5 of doc_id), which bounds what
can be learned from; of rows of a class with equal sets of words one counts. Scoring covers every row and whole texts.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import fresh, read_table

SAMPLE = 10_000  #: labelled rows of each class that learning may use
LEAST_PREFIX = 3  #: letters of a word's shortest beginning that can be an arc
LEAST_G2 = 14.0  #: evidence (likelihood ratio) an arc needs
LEAST_ODDS = 3.0  #: log-odds an arc needs
LEAST_SHARE = 0.01  #: share of the toxic rows an arc must occur in, so that words of one much-copied text stay out
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "bastard", "bitch", "asshole", "dumbass", "imbecile", "vermin", "degenerate")
THREATS = frozenset("kill murder hurt destroy beat stab shoot strangle rape burn hang slaughter".split())
#: second and third person and group words of the four languages of the corpus
TARGETS = frozenset(
    "you your yours yourself u he him she her they them their those these people "
    "du dich dir dein deine ihr euch ihn ihm sie ihnen leute tu te toi ton ta vous votre lui leur elle elles ils gens "
    "tú ti tus usted ustedes él ella ellos ellas vosotros gente".split()
)
NEGATIONS = frozenset("not no never isn't wasn't aren't don't doesn't didn't won't cannot can't without nicht kein keine ne pas jamais nunca".split())
REPORTS = frozenset("said says say told quoted wrote claimed called calls reported stated sagte dit dijo".split())
SEED_WEIGHT = 2.5
FEATURES = 3
BEFORE = ">"  #: marks a word that stands before a target; no word begins with it

_CLAUSE = re.compile(r"[.!?;:\n,()\[\]\"“”«»|]+")
_EDGE = " \t\r\x0b\x0c'’`*_-–—#%&$/\\<>{}=+~^@"


def words_of(text: str) -> Iterator[list[str]]:
    """The clauses of a text as lists of lower-case words."""
    for part in _CLAUSE.split(text.lower()):
        words = [w for w in (x.strip(_EDGE) for x in part.split()) if w]
        if words:
            yield words


def arcs(word: str) -> list[str]:
    """What the insult transducer can match of a word: the whole, and its beginnings (marked by ^)."""
    return [word, *("^" + word[:k] for k in range(LEAST_PREFIX, len(word)))]


# --- the machines ------------------------------------------------------------------------------------------------

#: ways to read a word; the lexical transducer gives each word one or more of them, with a weight
PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT = SYMBOLS = range(6)
Arc = tuple[int, float, float]  #: next state, factor on the arc's weight, gain


class Machine:
    """A transducer over SYMBOLS: `arcs[state, symbol]` are its arcs; state 0 is the start, all states are final."""

    def __init__(self, arcs: dict[tuple[int, int], list[Arc]]):
        self.arcs = arcs

    @staticmethod
    def of(states: int, rule) -> Machine:
        """From a rule (state, symbol) -> arcs."""
        return Machine({(q, s): rule(q, s) for q in range(states) for s in SYMBOLS})


def threat_machine(window: int = 4, gain: float = 2.0) -> Machine:
    """State q > 0: a threatening verb stands q words back; a target completes it."""

    def rule(q: int, s: int) -> list[Arc]:
        if s == THREAT:
            return [(1, 1.0, 0.0)]
        if s == TARGET and q:
            return [(0, 1.0, gain)]
        return [(q + 1 if 0 < q < window else 0, 1.0, 0.0)]

    return Machine.of(window + 1, rule)


def target_machine(window: int = 3, factor: float = 1.25, gain: float = 0.5) -> Machine:
    """States 1 to `window`: a target stands so many words back; the ones above: an insult does."""

    def rule(q: int, s: int) -> list[Arc]:
        if s == TARGET:
            return [(1, 1.0, gain if q > window else 0.0)]
        if s == INSULT:
            return [(window + 1, factor if 0 < q <= window else 1.0, 0.0)]
        return [(0 if q in (0, window, 2 * window) else q + 1, 1.0, 0.0)]

    return Machine.of(2 * window + 1, rule)


def negation_machine(window: int = 3, factor: float = 0.25) -> Machine:
    """State q > 0: so many words of a negation's scope are left."""

    def rule(q: int, s: int) -> list[Arc]:
        return [(window, 1.0, 0.0)] if s == NEGATION else [(max(q - 1, 0), factor if q else 1.0, 0.0)]

    return Machine.of(window + 1, rule)


def report_machine(factor: float = 0.5) -> Machine:
    """State 1: what follows is reported."""
    return Machine.of(2, lambda q, s: [(1 if s == REPORT or q else 0, factor if q else 1.0, 0.0)])


MACHINES = (threat_machine(), target_machine(), negation_machine(), report_machine())


def compose(machines: tuple[Machine, ...]) -> Machine:
    """One machine over the reachable joint states of all; factors multiply, and apply to the gains of the others too."""
    number, todo, arcs = {(0,) * len(machines): 0}, [(0,) * len(machines)], {}
    while todo:
        state = todo.pop()
        for s in SYMBOLS:
            out: list[Arc] = []
            for ways in itertools.product(*(m.arcs[q, s] for m, q in zip(machines, state, strict=True))):
                to = tuple(w[0] for w in ways)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                factor = math.prod(w[1] for w in ways)
                out.append((number[to], factor, factor * sum(w[2] for w in ways)))
            arcs[number[state], s] = out
    return Machine(arcs)


class Grammar:
    """The lexical transducer with its learned arcs `weights`, and the composed machines."""

    def __init__(self, weights: dict[str, float], machines: tuple[Machine, ...] = MACHINES):
        self.weights, self.known = weights, {}
        self.longest = sorted({len(k) - 1 for k in weights if k[0] == "^"}, reverse=True)
        self.threats = THREATS | {k[1:] for k in weights if k[0] == BEFORE}
        self.arcs = compose(machines).arcs

    def insult(self, word: str) -> float:
        """Weight of the longest arc that accepts the word, 0 if none does."""
        w = self.weights.get(word)
        if w is None:
            w = next((x for k in self.longest if len(word) > k and (x := self.weights.get("^" + word[:k])) is not None), 0.0)
        return w

    def readings(self, word: str) -> list[tuple[int, float]]:
        """Symbols a word can be read as, with weights. Negating and reporting words are never anything else."""
        if word in NEGATIONS:
            return [(NEGATION, 0.0)]
        if word in REPORTS:
            return [(REPORT, 0.0)]
        if word in TARGETS:
            return [(TARGET, 0.0)]
        out = [(PLAIN, 0.0)]
        if word in self.threats:
            out.append((THREAT, 0.0))
        if (w := self.insult(word)) > 0:
            out.append((INSULT, w))
        return out

    def suspicious(self, text: str) -> bool:
        """Whether any word can be read as an insult or a threatening verb; words are remembered."""
        known = self.known
        if len(known) > 150_000:
            known.clear()
        for raw in set(_CLAUSE.sub(" ", text.lower()).split()):
            hit = known.get(raw)
            if hit is None:
                word = raw.strip(_EDGE)
                hit = known[raw] = bool(word) and (word in self.threats or self.insult(word) > 0)
            if hit:
                return True
        return False

    def clause(self, words: list[str]) -> float:
        """Weight of the best path of the composed machine over one clause."""
        best = {0: 0.0}
        for word in words:
            after: dict[int, float] = {}
            for symbol, weight in self.readings(word):
                for q, score in best.items():
                    for to, factor, gain in self.arcs[q, symbol]:
                        x = score + factor * weight + gain
                        if x > after.get(to, -1.0):
                            after[to] = x
            best = after
        return max(best.values())

    def features(self, text: str) -> tuple[float, ...]:
        """Of the clauses' scores: the strongest and the sum, as log1p, and the mean over all clauses, which a single word in a long text hardly moves."""
        if not self.suspicious(text):
            return (0.0,) * FEATURES
        scores = list(map(self.clause, words_of(text)))
        return (math.log1p(max(scores)), math.log1p(sum(scores)), sum(scores) / len(scores)) if any(scores) else (0.0,) * FEATURES


# --- learning ----------------------------------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is kept for judging; a row without an id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most SAMPLE labelled rows of each class outside the held-out fold: (text, toxic)."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.where(~held_out()).withColumn("_o", F.md5(F.col("doc_id").cast("string")))
    parts = [rows.where(F.col("toxic") == y).orderBy("_o", "doc_id").limit(SAMPLE) for y in (0, 1)]
    ids = parts[0].union(parts[1]).select("doc_id", "toxic")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic")


def _with_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows with a 128-bit hash of their set of words: copies of one text share it, and count once below."""
    for pdf in frames:
        words = [sorted({w for ws in words_of(t) for w in ws}) for t in pdf["text"]]
        yield pdf.assign(words=pd.Series([xxhash.xxh3_128_hexdigest("\n".join(ws)) for ws in words], dtype=object, index=pdf.index))


def before_targets(clause: list[str], window: int = 4) -> set[str]:
    """Words with a target among the `window` next ones."""
    at = [i for i, w in enumerate(clause) if w in TARGETS]
    return {clause[j] for i in at for j in range(max(0, i - window), i)} - TARGETS - NEGATIONS - REPORTS


def _arc_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class in which an arc occurs, summed over the partition of a bounded sample."""
    counts = (Counter(), Counter())
    for pdf in frames:
        for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
            clauses = list(words_of(text))
            counts[int(y)].update({a for ws in clauses for w in ws for a in arcs(w)})
            counts[int(y)].update({BEFORE + w for ws in clauses for w in before_targets(ws)})
    keys = pd.Series(list(counts[0] | counts[1]), dtype=object)
    yield pd.DataFrame({"arc": keys, "toxic": [counts[1][k] for k in keys], "clean": [counts[0][k] for k in keys]}).astype({"toxic": "int64", "clean": "int64"})


def learn_arcs(sample: DataFrame) -> dict[str, float]:
    """Arcs with significantly more toxic than clean documents of the bounded sample, and the seeds.

    Of the documents of a class with the same set of words one counts, so that copies are no evidence; all counts,
    those of the classes too, are taken after that. Words that stand before targets have arcs marked by BEFORE.
    """
    weights = {w: SEED_WEIGHT for w in SEEDS}
    sample = sample.mapInPandas(_with_words, "text string, toxic int, words string")
    sample = sample.groupBy("toxic", "words").agg(F.min("text").alias("text"))
    n = {int(r.toxic): float(r["count"]) for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0.0), n.get(0, 0.0)
    if not n1 or not n0:
        return weights
    a, b = F.col("a"), F.col("b")
    e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
    g2 = 2 * (a * F.log(a / e1) + F.when(b > 0, b * F.log(b / e0)).otherwise(0.0))
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    found = (
        sample.mapInPandas(_arc_counts, "arc string, toxic long, clean long")
        .groupBy("arc").agg(F.sum("toxic").cast("double").alias("a"), F.sum("clean").cast("double").alias("b"))
        .where(F.col("a") >= max(3.0, LEAST_SHARE * n1)).select("arc", "a", g2.alias("g2"), odds.alias("odds"))
        .where((F.col("g2") >= LEAST_G2) & (F.col("odds") >= LEAST_ODDS))
    )
    rows = sorted(found.collect(), key=lambda r: r.arc)
    # A beginning is kept only where no single longer arc explains most of what it accepts.
    longer: dict[str, float] = {}
    for r in rows:
        if r.arc[0] == BEFORE:
            continue
        word = r.arc.removeprefix("^")
        for k in range(LEAST_PREFIX, len(word) + (r.arc[0] != "^")):
            longer["^" + word[:k]] = max(longer.get("^" + word[:k], 0.0), r.a)
    weights |= {r.arc: round(r.odds, 6) for r in rows if r.arc[0] != BEFORE and longer.get(r.arc, 0.0) < 0.8 * r.a}
    insults = Grammar(weights)
    return weights | {r.arc: round(r.odds, 6) for r in rows if r.arc[0] == BEFORE and not insults.insult(r.arc[1:])}


def _features(grammar: Grammar):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            f = [grammar.features(t) for t in pdf["text"]]
            yield pd.DataFrame({"toxic": pdf["toxic"], **{f"f{i}": np.array([x[i] for x in f], float) for i in range(FEATURES)}})

    return run


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; classes weigh alike."""
    x = np.column_stack([np.ones(len(x)), x])
    if not len(y) or y.min() == y.max():
        return np.array([-2.0, 1.5, 1.0, 0.0])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.05 * beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 0.05 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    """The grammar and its curve; small and sent to the tasks with the function that uses it."""

    def __init__(self, weights: dict[str, float], beta: np.ndarray):
        self.weights, self.beta = weights, beta

    @staticmethod
    def train(docs: DataFrame, labels: DataFrame) -> Model:
        sample = training_sample(docs, labels)
        weights, names = learn_arcs(sample), [f"f{i}" for i in range(FEATURES)]
        rows = sample.mapInPandas(_features(Grammar(weights)), ", ".join(["toxic int", *(f"{f} double" for f in names)])).groupBy("toxic", *names).count().toPandas()
        rows = rows.loc[rows.index.repeat(rows["count"])].sort_values(["toxic", *names])
        return Model(weights, fit_curve(rows[names].to_numpy(float), rows["toxic"].to_numpy(float)))

    def score(self, docs: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        """`docs` with a column `score` (0..1), which takes the place of one so named; all other columns stay."""
        weights, beta = self.weights, [float(b) for b in self.beta]

        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            grammar = Grammar(weights)
            for column in texts:
                f = np.array([grammar.features(t or "") for t in column], float).reshape(-1, FEATURES)
                z = np.clip(beta[0] + f @ np.array(beta[1:]), -30, 30)
                yield pd.Series(1 / (1 + np.exp(-z)))

        return docs.withColumn(score, F.pandas_udf(run, "double")(F.coalesce(text, F.lit(""))))


# --- query and stage ---------------------------------------------------------------------------------------------


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = Model.train(docs, read_table(spark, sf_dir, "labels"))
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose score is under 0.5."""
    model = Model.train(docs, read_table(spark, sf_dir, "labels"))
    name = fresh(docs, "_toxicity")
    return model.score(docs, score=name).where(F.col(name) < 0.5).drop(name)
