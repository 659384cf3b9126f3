"""Batch ranking of diseases for many cases: a block of cases is sent to all diseases, best rows are merged.

The cases are a stated query set: CASES of them at a time travel to the tasks with the ancestors of their
terms. Every disease is read once a block, as one row with its carried terms, and scored against the block in
numpy. Terms whose ancestors in a batch are the same are matched once, and once a case has its `top`, only
diseases that reach the least of their scores are looked at further. A task hands on no more than the best `top`
of each case, with the number of rows that have each score, so what is shuffled doesn't grow with the diseases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.sources.scratch import keep

CASES = 2000  #: cases of a block
ROWS, MOST_ROWS = 256, 4096  #: diseases scored at once, at least and at most
CELLS = 4_000_000  #: of diseases and ancestors that a batch holds, if that is ROWS or more
LOWER = 32  #: bits of the lower part of a disease id


class Block:
    """Cases with their terms: for each term the informative ancestors, most informative first, the term itself before others."""

    def __init__(self, rows: list):
        self.cases = sorted({r.case_id for r in rows})
        number = {c: i for i, c in enumerate(self.cases)}
        self.present: list[list[int]] = [[] for _ in self.cases]
        self.excluded: list[list[int]] = [[] for _ in self.cases]
        self.names, self.terms, places, terms = [], [], {}, {}
        self.own: list[int] = []  # of each term its own place
        self.over: list[list[int]] = []  # and those of all its ancestors
        information: dict[int, float] = {}

        def place(name: str) -> int:
            if name not in places:
                places[name] = len(self.names)
                self.names.append(name)
            return places[name]

        for r in rows:
            for x in r.up or []:
                information[place(x.ancestor)] = x.ic
            if r.status == "excluded":
                self.excluded[number[r.case_id]].append(place(r.term))
                continue
            if r.term not in terms:
                up = sorted(r.up or [], key=lambda x: (-x.ic, x.ancestor != r.term, x.ancestor))
                terms[r.term] = len(self.terms)
                self.terms.append([(place(x.ancestor), x.ic, int(x.ancestor == r.term)) for x in up if x.ic > 0])
                self.own.append(place(r.term))
                self.over.append([place(x.ancestor) for x in up])
            self.present[number[r.case_id]].append(terms[r.term])
        self.ic = np.array([information.get(i, 0.0) for i in range(len(self.names))])

    def best(self, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each term and disease the best shared ancestor: its information (0: none), whether exact, its frequency."""
        has = ~np.isnan(freq)
        some = has.any(axis=0).tolist()
        number: dict[tuple, int] = {}  # of the different lists of ancestors that any of these diseases has
        at = [number.setdefault(tuple(x for x in up if some[x[0]]), len(number)) for up in self.terms]
        shape = (len(number), len(freq))
        ic, exact, f = np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape)
        for up, i in number.items():
            for j in range(len(up) - 1, -1, -1):  # the more informative ones last, as they replace others
                a, value, same = up[j]
                here = has[:, a]
                tie = here & (ic[i] == value) & (exact[i] == same) & (f[i] > freq[:, a]) if up[j + 1 : j + 2] and up[j + 1][1:] == (value, same) else None
                np.copyto(ic[i], value, where=here)
                np.copyto(exact[i], same, where=here)
                np.copyto(f[i], freq[:, a], where=here if tie is None else here & ~tie)
        return ic[at], exact[at], f[at]

    def contradicted(self, c: int, carried: np.ndarray, absent: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Of each present term the curated absences (row, ancestor) that it contradicts; each counts for its first term only.

        A disease that has the term, or something below it, isn't contradicted by it.
        """
        place: dict[int, int] = {}  # of the ancestors of this case, in `used`
        for t in self.present[c]:
            for a in self.over[t]:
                place.setdefault(a, len(place))
        used = np.zeros((len(absent), len(place)), bool)
        for t in self.present[c]:
            over = self.over[t]
            mine = [place[a] for a in over]
            new = absent[:, over] & ~used[:, mine] & np.isnan(carried[:, self.own[t]])[:, None]
            used[:, mine] |= new
            yield new, over


def resnik(block: Block, c: int, ic: np.ndarray, exact: np.ndarray, freq: np.ndarray, carried: np.ndarray, absent: np.ndarray | None) -> np.ndarray:
    """Mean information of the best shared ancestors."""
    return ic.sum(axis=0) / max(len(ic), 1)


def resnik_with_penalties(block: Block, c: int, ic: np.ndarray, exact: np.ndarray, freq: np.ndarray, carried: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """Mean information, less that of excluded terms the disease shows (times their frequency) and of contradicted absences."""
    cost = (block.ic[block.excluded[c]] * np.nan_to_num(carried[:, block.excluded[c]])).sum(axis=1)
    for new, over in block.contradicted(c, carried, absent):
        cost = cost + new @ block.ic[over]
    return (ic.sum(axis=0) - cost) / max(len(ic), 1)


#: parameters of the likelihood score (fixed values): least frequency, highest frequency an excluded term is believed with, value of a term the disease is curated not to have
LEAST, CAP, ABSENT = 0.02, 0.9, -2.3


def likelihood_with_penalties(block: Block, c: int, ic: np.ndarray, exact: np.ndarray, freq: np.ndarray, carried: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """Sum over present terms of the best information plus log frequency, 0 where nothing informative is shared.

    A contradicted term is worth ABSENT at most; an excluded term the disease shows costs -ln(1 - frequency), the frequency at most CAP.
    """
    total = np.zeros(len(carried))
    logs = lambda a: np.log(np.maximum(np.nan_to_num(carried[:, a]), LEAST))  # noqa: E731 (of this case's ancestors only)
    for t, (new, _) in zip(block.present[c], block.contradicted(c, carried, absent), strict=True):
        best = np.full(len(carried), -np.inf)
        for a, value, _ in block.terms[t]:
            best = np.where(np.isnan(carried[:, a]), best, np.maximum(best, value + logs(a)))
        best = np.where(np.isinf(best), 0.0, best)
        total += np.where(new.any(axis=1), np.minimum(best, ABSENT), best)
    shown = np.nan_to_num(carried[:, block.excluded[c]])
    return total + np.log(1 - np.minimum(shown, CAP)).sum(axis=1)


def likelihood(floor: float):
    """Sum of information plus log frequency, not under 0 a term; excluded terms that the disease shows cost."""

    def score(block: Block, c: int, ic: np.ndarray, exact: np.ndarray, freq: np.ndarray, carried: np.ndarray, absent: np.ndarray | None) -> np.ndarray:
        gain = np.where(ic > 0, np.maximum(0.0, ic + np.log(np.maximum(freq, floor))), 0.0).sum(axis=0)
        for a in block.excluded[c]:
            shown = ~np.isnan(carried[:, a])
            gain[shown] += np.log(np.maximum(1 - carried[shown, a], floor))
        return gain

    return score


class _Best:
    """The best rows of one case so far, and how many rows have each of their scores."""

    def __init__(self, top: int):
        self.top, self.rows, self.scores, self.counts = top, None, np.empty(0), np.empty(0, np.int64)

    def least(self) -> float:
        """The score below which nothing is added any more."""
        return -np.inf if self.rows is None or len(self.rows) < self.top else self.rows[-1, 0]

    def add(self, rows: np.ndarray) -> None:
        """`rows`: columns score, exact, specificity, upper and lower part of the disease id, excluded hits."""
        values, counts = np.unique(rows[:, 0], return_counts=True)
        if self.rows is not None:
            rows = np.concatenate([self.rows, rows])
            both, at = np.unique(np.concatenate([self.scores, values]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([self.counts, counts])).astype(np.int64)
            values = both
        if len(rows) > self.top:
            rows = rows[rows[:, 0] >= np.partition(rows[:, 0], -self.top)[-self.top]]
        self.rows = rows[np.lexsort((-rows[:, 4], -rows[:, 3], -rows[:, 2], -rows[:, 1], -rows[:, 0]))[: self.top]]
        keep = values >= self.rows[-1, 0]
        self.scores, self.counts = values[keep], counts[keep]


SCHEMA = "case_id string, disease long, score double, exact long, specificity double, excluded_hits long, same long"


def by_disease(carried: DataFrame) -> DataFrame:
    """(disease, ancestors, freqs) of the rows (disease, ancestor, freq)."""
    return carried.groupBy("disease").agg(F.collect_list("ancestor").alias("ancestors"), F.collect_list("freq").alias("freqs"))


def rank(case_terms: DataFrame, closed: DataFrame, carried: DataFrame, ic: DataFrame, top: int, score=resnik, absent: DataFrame | None = None) -> DataFrame:
    """(case_id, disease, score, exact, specificity, excluded_hits, rank, tied): the `top` of each case.

    Order: score, exact matches, specificity (mean information of the matched terms), then disease id downwards; a disease
    that shares nothing informative with a case isn't ranked. Scores are compared at six digits. `absent` (disease, term)
    are curated absences, which the scores with penalties read. `carried` has rows (disease, ancestor, freq), or it is a written
    table of those of `by_disease`.
    """
    spark = case_terms.sparkSession
    case_terms = keep(case_terms, "cases")  # counted, then read by every block
    up = closed.join(ic.where("ic > 0"), "ancestor") if absent is None else closed.join(ic, "ancestor", "left").withColumn("ic", F.coalesce("ic", F.lit(0.0)))
    asked = case_terms.join(up, "term", "left").groupBy("case_id", "term", "status").agg(F.collect_list(F.when(F.col("ancestor").isNotNull(), F.struct("ancestor", "ic"))).alias("up"))
    written = "ancestors" in carried.columns
    diseases = carried if written else by_disease(carried)
    if absent is not None:
        curated = absent.groupBy("disease").agg(F.collect_set("term").alias("absents"))
        diseases = diseases.join(curated, "disease", "left").withColumn("absents", F.coalesce("absents", F.array().cast("array<string>")))
    n = math.ceil(case_terms.agg(F.countDistinct("case_id")).first()[0] / CASES)
    if n > 1 and not (written and absent is None):  # read by every block
        diseases = keep(diseases, "diseases")
    found = None
    for i in range(max(n, 1)):
        mine = asked.where(F.pmod(F.xxhash64("case_id"), F.lit(max(n, 1))) == i).orderBy("case_id", "term")
        block = spark.sparkContext.broadcast(mine.collect())  # rows, as a Block would need this package on the path of workers
        part = diseases.mapInArrow(_scorer(block, top, score), SCHEMA)
        if n > 1:  # one block after the other; what is left of each is a small table
            part = keep(part, "ranked")
        found = part if found is None else found.union(part)
    by_case = W.partitionBy("case_id")
    order = by_case.orderBy(F.desc("score"), F.desc("exact"), F.desc("specificity"), F.desc("disease"))
    tied = F.sum("same").over(W.partitionBy("case_id", "score"))
    return found.withColumns({"rank": F.row_number().over(order).cast("long"), "tied": tied}).where(F.col("rank") <= top).drop("same")


def _places(lists: pa.Array, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and places of the names in `lists` that the block has, and which of all they are."""
    at = pc.index_in(lists.flatten(), value_set=names)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    known = at.is_valid().to_numpy(zero_copy_only=False)
    return row[known], at.filter(pa.array(known)).to_numpy(), known


def _scorer(shared, top: int, score):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        names = pa.array(block.names, pa.string())
        best = [_Best(top) for _ in block.cases]
        rows = max(ROWS, min(MOST_ROWS, CELLS // max(len(block.names), 1)))
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                freqs = b.column(2)
                row, at, known = _places(b.column(1), names)
                carried = np.full((b.num_rows, len(names)), np.nan, order="F")  # read by columns
                carried[row, at] = freqs.flatten().to_numpy()[known]
                absent = None
                if b.num_columns > 3:
                    row, at, _ = _places(b.column(3), names)
                    absent = np.zeros(carried.shape, bool)
                    absent[row, at] = True
                ic, exact, freq = block.best(carried)
                ids = b.column(0).to_numpy()
                upper, lower = (ids >> LOWER).astype(np.float64), (ids & ((1 << LOWER) - 1)).astype(np.float64)  # each exact, whatever the id
                for c, terms in enumerate(block.present):
                    if not terms:
                        continue
                    mine = ic[terms]
                    value = score(block, c, mine, exact[terms], freq[terms], carried, absent)
                    open_ = np.flatnonzero(value >= best[c].least() - 1e-6)  # rounding moves a score by less
                    if not len(open_):
                        continue
                    mine = mine[:, open_]
                    hits = (mine > 0).sum(axis=0)
                    if not hits.all():
                        open_, mine, hits = open_[hits > 0], mine[:, hits > 0], hits[hits > 0]
                        if not len(open_):
                            continue
                    specificity = np.round(mine.sum(axis=0) / hits, 6)
                    shown = (~np.isnan(carried[np.ix_(open_, block.excluded[c])])).sum(axis=1)
                    best[c].add(np.column_stack([np.round(value[open_], 6), exact[np.ix_(terms, open_)].sum(axis=0), specificity, upper[open_], lower[open_], shown]))
        for case, x in zip(block.cases, best, strict=True):
            if x.rows is not None:
                first = np.r_[True, x.rows[1:, 0] != x.rows[:-1, 0]]
                same = np.where(first, x.counts[np.searchsorted(x.scores, x.rows[:, 0])], 0)
                r = x.rows
                columns = [pa.array([case] * len(r)), pa.array((r[:, 3].astype(np.int64) << LOWER) | r[:, 4].astype(np.int64)), pa.array(r[:, 0]), pa.array(r[:, 1].astype(np.int64)), pa.array(r[:, 2]), pa.array(r[:, 5].astype(np.int64)), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, ["case_id", "disease", "score", "exact", "specificity", "excluded_hits", "same"])

    return run
