"""Shared plumbing of the training-data operators: scratch tables, word hashes, components.

Scratch tables go to the shared folder that the cluster names in
``spark.checkpoint.dir``; a private one is made only for a local session where that is unset (tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many rows of narrow ids (16 MB); beyond it Spark shuffles.
BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of so many rows, since a row holds a whole text: Python workers then need little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where a local session leaves it unset, a fresh temporary one, once per session."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Tables written once, read back without lineage, and dropped when no result reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(self.path(t))
            p.getFileSystem(conf).delete(p, True)


def narrow(side: DataFrame, rows: int | None = None) -> DataFrame:
    """`side` with a broadcast hint if its counted rows stay under BROADCAST_ROWS, else as it is."""
    return F.broadcast(side) if (side.count() if rows is None else rows) <= BROADCAST_ROWS else side


# --- equal neighbours in sorted order -----------------------------------------------------------------------------


def sorted_groups(scratch: Scratch, rows: DataFrame, keys: list[str], order: list[str], name: str, carry: str | None = None, distinct: bool = False) -> DataFrame:
    """`rows` (long columns) in the order of `keys` and `order`, each compared with its neighbours.

    Added are `repeated` (another row has the same keys) and `first_<c>` of each column c of `order`, and of
    `carry`, which may be null: the values of the first row with the same keys. Keys and order columns must not be null.
    With `distinct`, of rows equal in keys and order one is kept.
    Rows are range-partitioned by keys and order together, so a key of any share of all rows is spread
    over as many partitions as it fills; groups that run on from one partition into the next are put together
    from two more rows that each partition hands on: its first group and its last, with their first values.
    """
    columns, wanted = rows.columns, [*order, *([carry] if carry else [])]
    k, every = ([columns.index(c) for c in names] for names in (keys, [*keys, *order]))
    w = [columns.index(c) for c in wanted]
    names = [*columns, "repeated", "edge", *(f"first_{c}" for c in wanted)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, whole, firsts, held = None, None, None, None  # of the row before: its keys, all of it, its group's first values
        top, several = None, False
        for b in batches:
            if not b.num_rows:
                continue
            if distinct:
                rows = np.column_stack([b.column(i).to_numpy() for i in every])
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
                new[0] = whole is None or (rows[0] != whole).any()
                whole = rows[-1]
                b = b.filter(pa.array(new))
                if not b.num_rows:
                    continue
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in k])
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]).any(axis=1)
            new[0] = last is None or (x[0] != last).any()
            if held is not None:
                held[1][-1] |= not new[0]
                yield finish(*held)
            at = np.maximum.accumulate(np.where(new, np.arange(len(x)), -1))
            top, several = top or b.slice(0, 1), several or bool(new[1:].any() or (last is not None and new[0]))
            source = at + 1  # 0: the group that goes on from the batch before
            values = []
            for j, i in enumerate(w):
                before = pa.array([firsts[j] if firsts else None], b.column(i).type)
                values.append(pa.concat_arrays([before, b.column(i)]).take(pa.array(source)))
            repeated = ~new
            repeated[:-1] |= ~new[1:]
            held = (b, repeated, values)
            last, firsts = x[-1], [v[-1].as_py() for v in values]
        if held is not None:
            yield finish(*held)
            if several:
                yield finish(top, np.zeros(1, bool), [top.column(i) for i in w], True)
            yield finish(b.slice(b.num_rows - 1), np.zeros(1, bool), [v.slice(len(v) - 1) for v in values], True)

    def finish(b: pa.RecordBatch, repeated: np.ndarray, values: list[pa.Array], edge: bool = False) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(repeated), pa.array(np.full(b.num_rows, edge)), *values], names)

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), "repeated boolean", "edge boolean", *(f"`first_{c}` {types[c]}" for c in wanted)])
    sorted_rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    conf, size = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(size)
    conf.set(size, 20_000)  # narrow rows
    try:
        found = scratch.keep(sorted_rows.mapInArrow(run, schema), name)
    finally:
        conf.set(size, before)
    ends = found.where("edge").groupBy(*keys).agg(F.min(F.struct(*(f"first_{c}" for c in wanted))).alias("_f"), F.count("*").alias("_c"))
    ends = scratch.keep(ends.where("_c > 1"), f"{name}-ends")  # fewer rows than partitions
    out = found.where("not edge").join(F.broadcast(ends), keys, "left")
    more = {f"first_{c}": F.when(F.col("_f").isNull(), F.col(f"first_{c}")).otherwise(F.col(f"_f.first_{c}")) for c in wanted}
    return out.withColumns({"repeated": F.coalesce(F.col("_c") > 1, "repeated"), **more}).drop("edge", "_f", "_c")


# --- words and shingles as 64-bit numbers ------------------------------------------------------------------------

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """word (bytes) -> xxh64, remembered; the memory is emptied when it has grown to `most` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of products spread over all 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * _MULT[0]
    x = (x ^ (x >> np.uint64(29))) * _MULT[1]
    return x ^ (x >> np.uint64(32))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by doubling: run(2j) from run(j) twice."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, step, size = None, 0, mix(words), 1
    while True:  # binary decomposition of k
        if k & size:
            part = step[done : done + n]
            out = part.copy() if out is None else mix(out * _MULT[2] + part)
            done += size
        if done == k:
            return out
        step = mix(step[:-size] * _MULT[3] + step[size:])
        size *= 2


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return words
    if len(words) < k:
        return rolling(words, len(words)) + np.uint64(len(words))
    return np.unique(rolling(words, k))


# --- connected components ----------------------------------------------------------------------------------------


def _print(edges: DataFrame) -> tuple:
    """Count and two xors of hashes of distinct edges: equal for equal sets, and for others but once in 2^128."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(7), "u"))).first())


def components(scratch: Scratch, edges: DataFrame, tag: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node that edges lead to.

    Alternates large-star and small-star (Kiveris et al. 2014), which needs a logarithmic
    number of rounds; each round is a written table, so no lineage grows and lost executors
    cost one round. Nothing but a changed-rows count reaches the driver.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, last = scratch.keep(now, f"{tag}0"), f"{tag}0"
    turn, before = 0, _print(now)
    while True:
        turn += 1
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        new = scratch.keep(small.where("u <> v").distinct(), f"{tag}{turn}")
        scratch.drop(last)
        now, last, after = new, f"{tag}{turn}", _print(new)
        if after == before:
            break
        before = after
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
