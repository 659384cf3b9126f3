"""Exact Jaccard self-join on word shingles, with set-relation skipping.

Documents are sets of 64-bit hashes of their distinct word shingles. Two sets of sizes m and n
link when 100 * overlap >= 85 * union. The join is exact for every pair of hash sets (a 64-bit
collision inside one document, about n^2 / 2^65, is the only thing it can't see):

1. Equal sets, found as neighbours in sorted order, collapse to one class, whose node is its smallest doc_id.
2. Each class keeps an index prefix under one global order: shingles by hash, except that the
   most frequent ones (counted over all classes; at most HOT_MOST, which bounds the broadcast)
   come last. Linked sets share a shingle within their prefixes.
3. Index lists are cut into blocks by set size, and entries carry their position. A block whose
   sizes, or an entry whose position, can't reach the required overlap is skipped unread.
4. Answers: in each block every set is first compared with one pivot only. A set close to its
   pivot takes over the pivot's answers: it is in the pivot's component, and a partner that was
   computed to be far from the pivot is skipped by the triangle inequality on set differences.
5. Only sets of different components that meet in a list are left. In lists of rare shingles they
   are paired. Sets that meet in lists of frequent shingles, or in any list of more than LIST_MOST
   entries, get a reference set X, and their
   differences D = Y xor X from it; then the difference of Y and Z is |D_Y| + |D_Z| - 2 |D_Y and D_Z|,
   so two sets that are not both linked to X must share elements of D, at least a known number.
   Prefixes of D, rarest first and only of elements that occur twice, give the pairs; near copies
   with changes of their own share nothing there, however many they are.
6. Pairs that survive a lower bound from 2,048 parity bits are verified on the whole sets.

Null and empty texts have no shingles and link with nothing. Rows with a null doc_id have a size like
others, but no component, and link with nothing. Rows that share a doc_id are one node. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, WordHashes, components, narrow, read_table, shingles, sorted_groups

WORDS, NUM, DEN = 4, 85, 100
HOT_DF = 8  #: shingles in more classes than this are ordered last
HOT_MOST = 500_000  #: of which at most so many (4 MB), the most frequent; the order is a matter of speed alone
LIST_MOST = 64  #: entries of a list whose sets are paired with each other; longer ones go by differences
REF_MOST, SALTS = 4_000_000, 32  #: shingles of all reference sets (32 MB) that are broadcast; beyond it the join is salted
BITS = 2048


def word_set(text: str | None, hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct shingles of a text: words are parts between ASCII white space, A-Z in lower case."""
    return shingles(hashes.of((text or "").encode().lower().split()), k)


def probe_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Prefix that a partner of any size must meet."""
    return np.where(n > 0, n - -(-num * n // den) + 1, 0)


class Join:
    """One run: parameters, the session and its scratch tables."""

    def __init__(self, docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.docs, self.nameless = rows.where("doc_id is not null"), rows.where("doc_id is null")
        self.k, self.num, self.den = words, num, den
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "ngram")

    # -- sets, classes ------------------------------------------------------------------------------------------

    def sets(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n, s1, s2, bits, lows): size, signature, parity bits and smallest shingles of each row's set."""
        k, num, den = self.k, self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                for part in range(0, batch.num_rows, 512):
                    b = batch.slice(part, 512)
                    n, sig, bits, lows = [], [], [], []
                    for text in b.column(1).to_pylist():
                        s = word_set(text, hashes, k)
                        p = int(probe_length(np.array(len(s)), num, den))
                        parity = np.bincount((s >> np.uint64(53)).astype(np.int64), minlength=BITS) & 1
                        n.append(len(s))
                        sig.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                        bits.append(np.packbits(parity.astype(np.uint8)).tobytes())
                        lows.append(s[: p + p // 2 + 16].view(np.int64))
                    offsets = np.cumsum([0, *map(len, lows)]).astype(np.int32)
                    values = np.concatenate(lows) if lows else np.empty(0, np.int64)
                    halves = np.array(sig).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                        ["doc_id", "n", "s1", "s2", "bits", "lows"],
                    )

        return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bits binary, lows array<long>")

    def classes(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(doc_id, n, s1, s2, first_doc_id) of each row with shingles, and the rows of `sets` that stand for their class."""
        rows = sets.where("n > 0")
        members = sorted_groups(self.scratch, rows.select("doc_id", "n", "s1", "s2"), ["s1", "s2"], ["doc_id"], "classes").drop("repeated")
        copies = self.scratch.keep(members.where("doc_id <> first_doc_id").select("doc_id", "s1", "s2").distinct(), "copies")
        return members, rows.join(narrow(copies), ["doc_id", "s1", "s2"], "left_anti")

    # -- the order, prefixes, lists -----------------------------------------------------------------------------

    def hot(self, counts: DataFrame, most: int = HOT_MOST) -> np.ndarray:
        limit = HOT_DF
        while counts.where(F.col("df") > limit).count() > most:
            limit *= 2
        rows = counts.where(F.col("df") > limit).select("token").toPandas()["token"].to_numpy(np.int64)
        return np.sort(rows.view(np.uint64))

    def order(self, reps: DataFrame, counts: DataFrame):
        """The frequent shingles, as a broadcast: first of those near the front of sets, then of the whole sets
        that are short of others there; again while that leaves more sets short."""
        hot = self.hot(counts)
        seen = 0
        for turn in range(4):
            shared = self.spark.sparkContext.broadcast(hot)
            short = self.scratch.keep(self.prefixes(reps, shared).where("short").select(F.col("doc_id").alias("id")).distinct(), f"short{turn}")
            n = short.count()
            if n <= seen or len(hot) >= HOT_MOST:
                break
            seen = n
            whole = self.whole_sets(short, n).select(F.explode("s").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
            whole = self.scratch.keep(whole.where(F.col("df") > HOT_DF), f"whole{turn}")
            hot = np.union1d(hot, self.hot(whole, HOT_MOST - len(hot)))
        self.scratch.drop(*(f"{x}{i}" for x in ("short", "whole") for i in range(4)))
        return shared

    def prefixes(self, reps: DataFrame, hot) -> DataFrame:
        """(doc_id, n, tokens, cold, short): the prefix in the global order, of which the first `cold` are not
        frequent; short where `lows` doesn't reach so far."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequent = hot.value
            for b in batches:
                n = b.column(1).to_numpy().astype(np.int64)
                lows = b.column(2)
                off = lows.offsets.to_numpy().astype(np.int64)
                flat = lows.values.to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.searchsorted(frequent, flat)
                is_hot = frequent[np.minimum(at, len(frequent) - 1)] == flat if len(frequent) else np.zeros(len(flat), bool)
                p, out, colds, short = probe_length(n, num, den), [], [], []
                for i in range(len(n)):
                    s, h = flat[off[i] : off[i + 1]], is_hot[off[i] : off[i + 1]]
                    cold = s[~h]
                    short.append(bool(len(cold) < p[i] and len(s) < n[i]))
                    colds.append(len(cold))
                    out.append(np.concatenate([cold, s[h]])[: p[i]].view(np.int64) if not short[-1] else np.empty(0, np.int64))
                offsets = pa.array(np.cumsum([0, *map(len, out)]).astype(np.int32))
                values = pa.array(np.concatenate(out) if out else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, values), pa.array(colds, pa.int32()), pa.array(short, pa.bool_())], ["doc_id", "n", "tokens", "cold", "short"])

        return reps.select("doc_id", "n", "lows").mapInArrow(run, "doc_id long, n long, tokens array<long>, cold int, short boolean")

    def whole_sets(self, ids: DataFrame, rows: int) -> DataFrame:
        """(id, s): the whole sets of the given documents, made again from their texts."""
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for b in batches:
                for part in range(0, b.num_rows, 512):
                    c = b.slice(part, 512)
                    s = [word_set(t, hashes, k).view(np.int64) for t in c.column(1).to_pylist()]
                    offsets = pa.array(np.cumsum([0, *map(len, s)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([c.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(s)))], ["id", "s"])

        some = self.docs.join(narrow(ids.select(F.col("id").alias("doc_id")), rows), "doc_id", "left_semi")
        return some.mapInArrow(run, "id long, s array<long>")

    def lists(self, reps: DataFrame, tokens: DataFrame, hot) -> DataFrame:
        """(token, id, n, pos, hot): the entries of all lists that hold at least two sets."""
        is_hot = (F.col("pos") >= F.col("cold")).alias("hot")
        made = self.prefixes(reps, hot)
        short = self.scratch.keep(made.where("short").select(F.col("doc_id").alias("id")).distinct(), "short")
        n_short = short.count()
        entries = made.where("not short").select("doc_id", "n", "cold", F.posexplode("tokens").alias("pos", "token")).select("doc_id", "n", "pos", "token", is_hot)
        if n_short:
            sets = self.whole_sets(short, n_short).select(F.col("id").alias("doc_id"), F.size("s").cast("long").alias("n"), F.col("s").alias("lows"))
            extra = self.prefixes(sets, hot).select("doc_id", "n", "cold", F.posexplode("tokens").alias("pos", "token")).select("doc_id", "n", "pos", "token", is_hot)
            extra = self.scratch.keep(extra, "extra")
            entries = entries.union(extra)
            tokens = tokens.union(extra.select("token")).distinct()
        entries = entries.join(tokens, "token", "left_semi")
        return self.scratch.keep(entries.select("token", F.col("doc_id").alias("id"), "n", F.col("pos").cast("long").alias("pos"), "hot"), "lists")

    # -- candidates ---------------------------------------------------------------------------------------------

    def block(self, n: Column) -> Column:
        """Number of a block of sizes; sets whose sizes allow a link are in the same block or the next."""
        return F.floor(F.log(n.cast("double")) / float(np.log(self.den / self.num)) + 1e-9)

    def need(self, m: Column, n: Column) -> Column:
        """Overlap that sets of sizes m and n need."""
        return F.ceil((m + n) * self.num / (self.num + self.den) - 1e-9)

    def reach(self, x: str, y: str) -> Column:
        """Whether sizes and the positions of a shared entry, as the first one shared, allow a link."""
        n, m, p, q = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
        return (self.num * F.greatest(n, m) <= self.den * F.least(n, m)) & (F.least(n - p, m - q) >= self.need(n, m))

    def star(self, lists: DataFrame) -> DataFrame:
        """(a, b): each set with the pivot of each of its blocks."""
        e = lists.withColumn("blk", self.block(F.col("n")))
        pivots = e.groupBy("token", "blk").agg(F.min(F.struct("id", "n", "pos")).alias("p"), F.count("*").alias("c")).where("c > 1").select("token", "blk", "p")
        return e.alias("e").join(pivots.alias("v"), ["token", "blk"]).where("e.id <> v.p.id").where(self.reach("e", "v.p")).select(F.col("v.p.id").alias("a"), F.col("e.id").alias("b")).distinct()

    def mixed(self, lists: DataFrame, comps: DataFrame) -> DataFrame:
        """(token, id, n, pos, hot, comp, blk, main): the lists with sets of several components; `main` has most of them."""
        e = lists.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
        e = e.select("token", "id", "n", "pos", "hot", "comp", self.block(F.col("n")).alias("blk"))
        sizes = e.groupBy("token", "comp").agg(F.count("*").alias("c"))
        main = sizes.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps"), F.sum("c").alias("entries")).where("comps > 1")
        main = main.select("token", F.col("m.comp").alias("main"), (F.col("entries") > LIST_MOST).alias("long"))
        return self.scratch.keep(e.join(main, "token").withColumn("hot", F.expr("hot or long")).drop("long"), "mixed")

    def rest(self, mixed: DataFrame) -> DataFrame:
        """(a, b): pairs of different components that meet in a list of a rare shingle."""
        e = mixed.where("not hot")
        x = e.where("comp <> main").withColumn("blk", F.explode(F.array(F.col("blk") - 1, F.col("blk"), F.col("blk") + 1)))
        pairs = x.alias("x").join(e.alias("y"), ["token", "blk"]).where("x.comp <> y.comp").where(self.reach("x", "y"))
        return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    def references(self, hot: DataFrame) -> DataFrame:
        """(id, ref): sets that meet in lists, however indirectly, share a reference: the smallest id of them all."""
        low = self.scratch.keep(hot.groupBy("token").agg(F.min("id").alias("low")), "low")
        edges = hot.join(low, "token").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
        return components(self.scratch, edges, "ref-").select(F.col("node").alias("id"), F.col("component").alias("ref"))

    def derived(self, mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links of sets with their references, and pairs of sets of one reference that may link, from differences alone."""
        num, den, scratch = self.num, self.den, self.scratch
        hot = mixed.where("hot").select("token", "id")
        refs = scratch.keep(self.references(hot), "refs")
        sets = scratch.keep(self.whole_sets(refs.select("id"), refs.count()), "hotsets")
        x = scratch.keep(sets.join(refs.where("id = ref").select("id"), "id", "left_semi").select(F.col("id").alias("ref"), F.col("s").alias("x")), "refsets")
        both = sets.join(refs, "id")
        if (x.agg(F.sum(F.size("x") + 2)).first()[0] or 0) <= REF_MOST:
            both = both.join(F.broadcast(x), "ref")
        else:  # one reference may belong to a third of all sets: both sides are salted
            salted = x.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            both = both.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["ref", "salt"]).drop("salt")
        d = both.select("ref", "id", F.size("s").cast("long").alias("n"), F.size("x").cast("long").alias("nx"), F.concat(F.array_except("s", "x"), F.array_except("x", "s")).alias("d"))
        d = d.withColumn("linked", (den + num) * F.size("d") <= (den - num) * (F.col("n") + F.col("nx")))
        d = scratch.keep(d, "differences")
        links = d.where("linked and id <> ref").select(F.col("ref").alias("a"), F.col("id").alias("b"), F.size("d").cast("long").alias("apart"))

        each = d.select("ref", "id", F.explode("d").alias("token"))
        shared = each.groupBy("ref", "token").agg(F.count("*").alias("df")).where("df > 1")
        core = each.join(shared, ["ref", "token"]).groupBy("ref", "id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("core"))
        c = core.join(d.select("id", "n", "nx", "linked", F.size("d").alias("nd")), "id")
        beta = (den - num) / (den + num)
        # What D has to share with that of an unlinked set, and (of an unlinked set) with that of a linked one.
        h = F.greatest(F.lit(1), F.floor((F.col("nd") + beta * (F.col("nx") - F.col("n"))) / 2 - 1e-9) + 1)
        g = F.greatest(F.lit(1), F.ceil(F.col("nd") - beta * F.col("n") * (1 + den / num) - 1e-6))
        prefix = lambda least: F.slice("core.token", F.lit(1), F.greatest(F.lit(0), F.size("core") - least + 1).cast("int"))
        c = c.select("ref", "id", "n", "nd", F.size("core").alias("size"), "linked", prefix(h).alias("h"), F.when(~F.col("linked"), prefix(g)).alias("g"))
        c = scratch.keep(c, "cores")

        def side(rows: DataFrame, tokens: str) -> DataFrame:
            """Entries with how many elements are left from them on, and the last ones before them."""
            e = rows.select("ref", "id", "n", "nd", "size", tokens, F.posexplode(tokens).alias("pos", "token"))
            return e.select("ref", "token", "id", "n", "nd", (F.col("size") - F.col("pos")).alias("left"), F.slice(tokens, F.greatest(F.col("pos") - 3, F.lit(1)), F.least(F.col("pos"), F.lit(4))).alias("prev"))

        def meet(x: DataFrame, y: DataFrame, different: str = "x.id <> y.id") -> DataFrame:
            """Pairs at the first element they share, as far as that can be told, whose rest is long enough for what they need."""
            pairs = x.alias("x").join(y.alias("y"), ["ref", "token"]).where(different).where(num * F.greatest("x.n", "y.n") <= den * F.least("x.n", "y.n"))
            pairs = pairs.where(2 * F.least("x.left", "y.left") >= F.col("x.nd") + F.col("y.nd") - beta * (F.col("x.n") + F.col("y.n")) - 1e-6)
            return pairs.where("not arrays_overlap(x.prev, y.prev)").select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

        linked, free = c.where("linked"), c.where("not linked")
        near = meet(side(linked, "h"), side(free, "g"))
        order = side(free, "h")
        apart = meet(order, order, "x.id < y.id")
        return links, near.union(apart).distinct()

    # -- verification -------------------------------------------------------------------------------------------

    def far(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """`pairs` with sizes m, n and `apart`, a lower bound of the sets' difference from their parity bits."""

        @F.pandas_udf("long")
        def apart(x: pd.Series, y: pd.Series) -> pd.Series:
            u, v = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
            return pd.Series(np.bitwise_count(u ^ v).sum(axis=1).astype(np.int64))

        a = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
        b = reps.select(F.col("doc_id").alias("b"), "n", F.col("bits").alias("y"))
        return pairs.join(a, "a").join(b, "b").withColumn("apart", apart("x", "y")).drop("x", "y")

    def allowed(self) -> Column:
        """Largest difference of linked sets of sizes m and n."""
        return F.col("m") + F.col("n") - 2 * self.need(F.col("m"), F.col("n"))

    def verified(self, near: DataFrame, name: str) -> DataFrame:
        """(a, b, apart): those of the near pairs that link, with the exact difference of their sets."""

        @F.pandas_udf("long")
        def overlap(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([len(np.intersect1d(u, v, assume_unique=True)) for u, v in zip(x, y, strict=True)], dtype="int64")

        ids = self.scratch.keep(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"ids{name}")
        sets = self.scratch.keep(self.whole_sets(ids, ids.count()), f"sets{name}")
        both = near.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
        m, n, o = F.size("x").cast("long"), F.size("y").cast("long"), F.col("o")
        found = both.withColumn("o", overlap("x", "y")).where(self.den * o >= self.num * (m + n - o)).select("a", "b", (m + n - 2 * o).alias("apart"))
        links = self.scratch.keep(found.distinct(), f"links{name}")
        self.scratch.drop(f"sets{name}", f"ids{name}")
        return links

    # -- the whole ----------------------------------------------------------------------------------------------

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for every row with a doc_id."""
        scratch = self.scratch
        sets = scratch.keep(self.sets(self.docs), "sets")
        members, reps = self.classes(sets)
        counts = reps.select(F.explode("lows").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        counts = scratch.keep(counts, "counts")
        hot = self.order(reps, counts)
        lists = self.lists(reps, counts.select("token"), hot)

        answers = scratch.keep(self.far(self.star(lists), reps), "answers")
        links = self.verified(answers.where(F.col("apart") <= self.allowed()), "1")
        comps = components(scratch, links, "c1-")

        mixed = self.mixed(lists, comps)
        by_reference, pairs = self.derived(mixed)
        by_reference = scratch.keep(by_reference, "near")
        pairs = self.rest(mixed).union(pairs).distinct()
        pivot = links.groupBy(F.col("b").alias("near")).agg(F.min(F.struct("apart", "a")).alias("p")).select("near", F.col("p.a").alias("pivot"), F.col("p.apart").alias("gap"))
        known = answers.select(F.col("a").alias("pivot"), F.col("b").alias("other"), F.col("apart").alias("known"))
        pairs = self.far(pairs, reps)
        for near, other in (("a", "b"), ("b", "a")):
            pairs = pairs.join(pivot.withColumnRenamed("near", near), near, "left").join(known.withColumnRenamed("other", other), ["pivot", other], "left")
            pairs = pairs.withColumn("apart", F.greatest("apart", F.coalesce(F.col("known") - F.col("gap"), F.lit(0)))).drop("pivot", "gap", "known")
        pairs = scratch.keep(pairs.where(F.col("apart") <= self.allowed()).select("a", "b", "m", "n", "apart").distinct(), "pairs2")
        more = self.verified(pairs, "2")
        comps = components(scratch, links.union(by_reference).union(more).select("a", "b"), "c2-")

        # Each class's first row is the one that stands for it and knows its component; the others get it in sorted order.
        known = members.drop("first_doc_id").join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        known = sorted_groups(scratch, known.select("doc_id", "n", "s1", "s2", "component"), ["s1", "s2"], ["doc_id"], "known", carry="component")
        found = known.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first_component", "first_doc_id").alias("component_id"))
        out = scratch.keep(found.union(sets.where("n = 0").select("doc_id", "n", "doc_id")), "out")
        tables = "sets classes classes-ends copies counts short extra lists mixed low refs refsets hotsets differences cores near answers pairs2 links1 links2 known known-ends"
        scratch.drop(*tables.split())
        hot.unpersist()
        # Rows that share a doc_id are one node, whatever their texts.
        same = out.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.max("component_id").alias("d")).where("c <> d")
        if same.limit(1).count():
            merged = components(scratch, out.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), "c3-").withColumnRenamed("node", "doc_id")
            out = out.join(merged, "doc_id", "left").withColumn("component_id", F.coalesce("component", "component_id")).drop("component")
        return out


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    join = Join(docs)
    nameless = join.sets(join.nameless).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return join.run().union(nameless)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five words, 0.8) the document with the smallest id; empty texts stay."""
    found = Join(docs, words=5, num=80, den=100).run()
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(narrow(gone), "doc_id", "left_anti")
