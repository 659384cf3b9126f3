"""Left alignment and REF checks against a reference that is rows of fixed blocks.

A reference is (contig, block, bases): block b has the bases from b * size + 1 on. Nothing asks for a whole
contig: a variant is joined with the one block it needs next, and rolls on from block to block in rounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from helixframe.plans import projections as P
from helixframe.sources.scratch import keep

SIZE = 1000  #: bases of a block
ROUNDS = 1000  #: blocks that one variant may roll over; those that would go on are told
CHECKED = 50  #: records compared for each file: the sample is the feature


def reference_blocks(segments: DataFrame, size: int = SIZE) -> DataFrame:
    """(contig, block, bases) of (contig, start, bases) segments of any lengths that join without gaps, as FASTA lines do."""
    first, last = F.expr(f"(start - 1) DIV {size}"), F.expr(f"(start + length(bases) - 2) DIV {size}")
    cut = segments.where(F.length("bases") > 0).select("contig", "start", F.upper("bases").alias("bases"), F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.lit(1), F.col("block") * size - F.col("start") + 2).cast("int")
    high = ((F.col("block") + 1) * size - F.col("start") + 1).cast("int")
    part = F.struct("start", F.substring("bases", low, high - low + 1).alias("bases"))
    joined = cut.groupBy("contig", "block").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # at most `size` parts
    return joined.select("contig", "block", F.array_join(F.transform("parts", lambda p: p["bases"]), "").alias("bases"))


def _near(references: dict[str, DataFrame], size: int) -> DataFrame:
    """(_c, _k, <name>, ...) of references by name: the bases of each block with those of the block after it, blanks for bases that lie between and aren't there."""
    rows = None
    for name, blocks in references.items():
        both = F.array(F.struct("block", F.lit(name).alias("what")), F.struct((F.col("block") - 1).alias("block"), F.lit(f"{name} after").alias("what")))
        part = blocks.select("contig", "bases", F.explode(both).alias("b")).select("contig", "b.*", "bases")
        rows = part if rows is None else rows.unionByName(part)
    of = lambda n: F.max(F.when(F.col("what") == n, F.col("bases")))
    text = lambda n: F.coalesce(F.concat(F.rpad(F.coalesce(of(n), F.lit("")), size, " "), of(f"{n} after")), of(n)).alias(n)
    return rows.groupBy(F.col("contig").alias("_c"), F.col("block").alias("_k")).agg(*map(text, references))


def bases_at(rows: DataFrame, references: dict[str, DataFrame], start: Column, length: Column, size: int = SIZE, longest: int | None = None) -> DataFrame:
    """`rows` (id, contig, ...) with the bases that references, by name, have in a stretch: shorter than `length` where the contig ends, null where it has none.

    A row goes to the block that its stretch begins in, which has the next one with it, and is done there. Stretches
    over more blocks ask each of them for its part; that second way reads `rows` once more, and is left out where the caller knows
    that stretches have at most `longest` bases, no more than a block (a longer one is an error then).
    """
    only_near = longest is not None and longest <= size + 1
    here = rows.withColumns({"_s": start, "_n": length})
    asks, is_far = F.coalesce(F.expr("_n > 0 AND _s >= 1"), F.lit(False)), F.expr(f"(_s + _n - 2) DIV {size} > (_s - 1) DIV {size} + 1")
    block = F.expr(f"(_s - 1) DIV {size}")
    if only_near:
        block = F.when(is_far, F.raise_error(F.lit(f"a stretch of more than {longest} bases"))).otherwise(block)
    # Rows that ask nothing meet no block; they are dealt by id.
    near = (here if only_near else here.where(~(asks & is_far))).withColumn("_b", F.when(asks, block).otherwise(-2 - F.pmod(F.xxhash64("id"), F.lit(1 << 20))))
    near = near.join(_near(references, size), (F.col("contig") == F.col("_c")) & (F.col("_b") == F.col("_k")), "left")
    found = lambda n: F.nullif(F.replace(F.substring(F.col(n), (F.col("_s") - F.col("_b") * size).cast("int"), F.col("_n").cast("int")), F.lit(" "), F.lit("")), F.lit(""))
    near = near.select(*rows.columns, *(found(n).alias(n) for n in references))
    if only_near:
        return near
    far = here.where(asks & is_far).withColumn("_e", F.expr("_s + _n - 1"))
    parts = far.select("id", "contig", "_s", "_e", F.explode(F.expr(f"sequence((_s - 1) DIV {size}, (_e - 1) DIV {size})")).alias("block"))
    for name, blocks in references.items():
        asked = parts.join(blocks, ["contig", "block"])
        low = F.greatest(F.lit(1), F.col("_s") - F.col("block") * size).cast("int")
        high = F.least(F.lit(size), F.col("_e") - F.col("block") * size).cast("int")
        told = asked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("block", F.substring("bases", low, high - low + 1).alias("b")))).alias("parts"))
        far = far.join(told.select("id", F.array_join(F.transform("parts", lambda p: p["b"]), "").alias(name)), "id", "left")
    return near.unionByName(far.select(*near.columns))


def checked_ref(variants: DataFrame, blocks: DataFrame, other: DataFrame | None = None, size: int = SIZE, longest: int | None = None) -> DataFrame:
    """`variants` (id, contig, pos, ref, ...) with `found`, the bases of the reference, and `check`.

    `check` is match, mismatch, `mismatch, other build` (what REF says is found in the other build's blocks) or
    unverified (no such contig or place, or REF is not plain bases).
    """
    references = {"found": blocks} if other is None else {"found": blocks, "_other": other}
    out = bases_at(variants, references, F.col("pos"), F.length("ref"), size, longest)
    also = F.lit(False) if other is None else F.coalesce(F.upper("ref") == F.col("_other"), F.lit(False))
    plain = F.coalesce(F.col("ref").rlike("(?i)^[ACGTN]+$"), F.lit(False))
    check = F.when(~plain | F.col("found").isNull(), "unverified").when(F.upper("ref") == F.col("found"), "match").when(also, "mismatch, other build").otherwise("mismatch")
    return out.withColumn("check", check).drop("_other")


@F.pandas_udf(IntegerType())
def places_left(left: pd.Series, unit: pd.Series) -> pd.Series:
    """How far an inserted or deleted unit can move left over the bases before it: the run of its period that they end with."""
    out = []
    for bases, u in zip(left, unit, strict=True):
        text, n, m = bases + u, len(bases), len(u)
        k = 0
        while k < n and text[n - 1 - k] == text[n - 1 - k + m]:
            k += 1
        out.append(k)
    return pd.Series(out, dtype="int32")


@F.pandas_udf(StructType([StructField("tail", IntegerType()), StructField("head", IntegerType())]))
def common_ends(ref: pd.Series, alt: pd.Series) -> pd.DataFrame:
    """How many last bases two alleles share, and how many first ones of what is left."""
    out = []
    for r, a in zip(ref, alt, strict=True):
        n = 0 if r is None or a is None else min(len(r), len(a))
        tail = next((k for k in range(n) if r[-1 - k] != a[-1 - k]), n)
        out.append((tail, next((k for k in range(n - tail) if r[k] != a[k]), n - tail)))
    return pd.DataFrame(out, columns=["tail", "head"], dtype="int32")


def parsimonious(variants: DataFrame) -> DataFrame:
    """`variants` with `at`, `gone`, `new`: the place before the change and the bases that go and come, common ends removed.

    The end goes first, then the beginning, so a repeat is cut where it stands leftmost in what is written.
    """
    end = variants.withColumns({"_r": F.upper("ref"), "_a": F.upper("alt")})
    end = end.withColumn("_n", common_ends("_r", "_a"))
    tail, head = F.col("_n.tail"), F.col("_n.head")
    rest = lambda c: F.substring(F.col(c), head + 1, F.length(c) - tail - head)
    return end.select(*variants.columns, (F.col("pos") - 1 + head).alias("at"), rest("_r").alias("gone"), rest("_a").alias("new"))


def left_aligned(variants: DataFrame, blocks: DataFrame, size: int = SIZE, rounds: int = ROUNDS, longest: int | None = None) -> DataFrame:
    """`variants` (id, contig, pos, ref, alt; ids distinct) with `new_pos`, `new_ref`, `new_alt` and `status`.

    Pure insertions and deletions move left while the base before them equals the last of their unit, a block a
    round; each round is a written table of those that still move. Others are only trimmed. A variant takes its own columns along, and where it
    stops its block has the base before it, so nothing is joined by id. `status` is aligned, same (REF equals ALT),
    unverified (REF isn't what the reference has; left as it is), or unfinished (more than `rounds` blocks).
    """
    good = (F.col("check") == "match") & (F.upper("ref") != F.upper("alt"))
    trimmed = parsimonious(checked_ref(variants, blocks, size=size, longest=longest))
    pure = (F.col("gone") == "") | (F.col("new") == "")
    trimmed = keep(trimmed.withColumns({"_good": F.coalesce(good, F.lit(False)), "unit": F.when(good & pure, F.concat("gone", "new"))}).drop("found"), "trimmed")
    own = [c for c in variants.columns if c != "contig"]
    state = trimmed.where("_good").select(*own, "contig", "at", "gone", "new", "unit")

    def told(rows: DataFrame, pos: Column, ref: Column, alt: Column, status: str | Column) -> DataFrame:
        return rows.select(*variants.columns, pos.alias("new_pos"), ref.alias("new_ref"), alt.alias("new_alt"), (F.lit(status) if isinstance(status, str) else status).alias("status"))

    def before(rows: DataFrame, status: str) -> DataFrame:
        return told(rows, F.col("at"), F.concat("anchor", turned("gone")), F.concat("anchor", turned("new")), status)

    turned = lambda c: F.when(F.col(c) != "", F.coalesce("unit", c)).otherwise("")
    out = [
        told(trimmed.where("NOT _good"), F.col("pos"), F.col("ref"), F.col("alt"), F.when(F.col("check") == "match", "same").otherwise("unverified")),
        told(state.where("unit IS NULL"), F.col("at") + 1, F.col("gone"), F.col("new"), "aligned"),
    ]
    first = [state.where("unit IS NOT NULL AND at < 1")]
    moving = state.where("unit IS NOT NULL AND at >= 1")
    for _ in range(rounds):
        here = moving.withColumn("block", F.expr(f"(at - 1) DIV {size}")).join(blocks, ["contig", "block"], "left")
        moved = here.withColumn("left", F.expr(f"coalesce(left(bases, CAST(at - block * {size} AS INT)), '')")).drop("bases", "block").withColumn("k", places_left("left", "unit"))
        turn = F.expr("CAST(k % length(unit) AS INT)")
        anchor = F.when(F.col("left") != "", F.substring("left", F.length("left") - F.col("k"), F.lit(1)))
        moved = moved.select(*own, "contig", (F.col("at") - F.col("k")).alias("at"), "gone", "new", F.concat(F.right("unit", turn), F.left("unit", F.length("unit") - turn)).alias("unit"), (F.col("k") == F.length("left")).alias("on"), anchor.alias("anchor"))
        moved = keep(moved, "moved")
        out.append(before(moved.where("NOT on"), "aligned"))
        first.append(moved.where("on AND (at < 1 OR anchor IS NULL)").drop("on", "anchor"))
        moving = moved.where("on AND at >= 1 AND anchor IS NOT NULL").drop("on", "anchor")
        if not moving.limit(1).count():
            break
    else:
        out.append(before(bases_at(moving, {"anchor": blocks}, F.col("at"), F.lit(1), size, 1), "unfinished"))
    # At the beginning of a contig, or of what the reference has of it, there is no base before; the one after is taken.
    begun = first[0]
    for f in first[1:]:
        begun = begun.unionByName(f)
    begun = bases_at(begun, {"anchor": blocks}, F.greatest(F.col("at"), F.lit(0)) + F.length("gone") + 1, F.lit(1), size, 1)
    out.append(told(begun, F.col("at") + 1, F.concat(turned("gone"), "anchor"), F.concat(turned("new"), "anchor"), "aligned"))
    ended = out[0]
    for o in out[1:]:
        ended = ended.unionByName(o)
    return ended


def ref_sample(variants: DataFrame, n: int = CHECKED, longest: int = 20) -> DataFrame:
    """At most `n` variants of each file, evenly spaced by place: REF of up to `longest` bases, repeats counted once."""
    pool = variants.where((F.length("ref") > 0) & (F.length("ref") <= longest)).groupBy("file", "contig", "pos", "ref").agg(F.min("id").alias("id"))
    number = F.row_number().over(W.partitionBy("file").orderBy("contig", "pos", "ref")) - 1
    total = pool.groupBy("file").agg(F.greatest(F.lit(1), F.expr(f"count(*) DIV {n}")).alias("step"))
    numbered = pool.withColumn("at", number).join(total, "file")
    return numbered.where((F.col("at") % F.col("step") == 0) & (F.col("at") < F.col("step") * n)).drop("at", "step")


# --- queries -----------------------------------------------------------------------------------------------------

BLOCK_HERE = 64
LONGEST = 5  #: bases of a REF of `raw_variants`


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five contigs of eight bases an order, repeats of 160 and of 32 bases among them."""
    o = P.table(spark, sf_dir, "orders")
    seg = F.expr("o_orderkey DIV 5")
    varied = F.translate(F.lpad(F.conv(((F.col("o_custkey") * 7919 + F.col("o_orderkey") * 104729) % 65536).cast("string"), 10, 4), 8, "0"), "0123", "ACGT")
    bases = F.when(seg % 64 < 20, "CACACACA").when(seg % 64 < 24, "GGGGGGGG").otherwise(varied)
    return o.select((F.col("o_orderkey") % 5).alias("contig"), (seg * 8 + 1).alias("start"), bases.alias("bases"))


def raw_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change a line item, its REF read from the reference; every 13th REF is wrong."""
    li, blocks = P.table(spark, sf_dir, "lineitem"), keep(reference_blocks(segments(spark, sf_dir), BLOCK_HERE), "blocks")
    rows = li.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_orderkey").alias("o"))
    rows = rows.select("id", "p", "s", (F.col("o") % 5).alias("contig"), (F.expr("o DIV 5") * 8 + F.col("p") % 8 + 1).alias("pos"))
    rows = bases_at(rows, {"ref": blocks}, F.col("pos"), 1 + F.col("s") % 5, BLOCK_HERE, LONGEST).where("ref IS NOT NULL")
    first = F.left("ref", F.lit(1))
    alt = F.when(F.col("p") % 3 == 0, first).when(F.col("p") % 3 == 1, F.concat("ref", F.lit("CA"))).otherwise(F.concat(first, F.lit("GG"), F.expr("substring(ref, 2)")))
    wrong = F.when(F.col("id") % 13 == 0, F.translate("ref", "ACGT", "CGTA")).otherwise(F.col("ref"))
    return rows.select("id", "contig", "pos", wrong.alias("ref"), alt.alias("alt"))


def query_left_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = keep(reference_blocks(segments(spark, sf_dir), BLOCK_HERE), "blocks")
    return left_aligned(raw_variants(spark, sf_dir), blocks, BLOCK_HERE, longest=LONGEST).select("id", "contig", "new_pos", "new_ref", "new_alt", "status")


def query_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes; another build has the bases that every second wrong REF shows."""
    blocks = keep(reference_blocks(segments(spark, sf_dir), BLOCK_HERE), "blocks")
    other = blocks.where("contig % 2 = 0").withColumn("bases", F.translate("bases", "ACGT", "CGTA"))
    return checked_ref(raw_variants(spark, sf_dir), blocks, other, BLOCK_HERE, LONGEST).select("id", "found", "check")


def query_ref_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are the last digits of ids: their samples of up to 50 changes, and how many differ from the reference."""
    blocks = keep(reference_blocks(segments(spark, sf_dir), BLOCK_HERE), "blocks")
    sample = ref_sample(raw_variants(spark, sf_dir).withColumn("file", F.col("id") % 10))
    return checked_ref(sample, blocks, None, BLOCK_HERE, LONGEST).groupBy("file").agg(F.count("*").alias("checked"), F.count_if(F.col("check") == "mismatch").alias("mismatch"), F.min("pos").alias("first"), F.max("pos").alias("last"))


_R = """seg AS (SELECT o_orderkey % 5 AS contig, o_orderkey // 5 AS seg, (o_custkey * 7919 + o_orderkey * 104729) % 65536 AS v FROM orders),
bas AS (SELECT contig, seg, CASE WHEN seg % 64 < 20 THEN 'CACACACA' WHEN seg % 64 < 24 THEN 'GGGGGGGG'
  ELSE translate(array_to_string(list_transform(range(7, -1, -1), lambda i: CAST((v >> CAST(2 * i AS BIGINT)) & 3 AS VARCHAR)), ''), '0123', 'ACGT') END AS b FROM seg),
ctg AS MATERIALIZED (SELECT contig, string_agg(b, '' ORDER BY seg) AS s FROM bas GROUP BY 1),
l AS (SELECT l_orderkey * 8 + l_linenumber AS id, max(l_partkey) AS p, max(l_suppkey) AS sk, max(l_orderkey) AS o FROM lineitem GROUP BY 1),
q AS (SELECT id, p, o % 5 AS contig, o // 5 * 8 + p % 8 + 1 AS pos, s[o // 5 * 8 + p % 8 + 1 : o // 5 * 8 + p % 8 + 1 + sk % 5] AS r FROM l JOIN ctg ON contig = o % 5),
raw AS MATERIALIZED (SELECT id, contig, pos, r AS found, CASE WHEN id % 13 = 0 THEN translate(r, 'ACGT', 'CGTA') ELSE r END AS ref,
  CASE p % 3 WHEN 0 THEN r[1:1] WHEN 1 THEN r || 'CA' ELSE r[1:1] || 'GG' || r[2:] END AS alt FROM q WHERE r <> '')"""
SQL = {
    # Bases are cut or put before one at a time, as the definition of a left-aligned variant says.
    "prj03_left_aligned": f"""WITH RECURSIVE {_R},
roll AS (SELECT raw.id, raw.contig, pos, ref, alt, 0 AS n, CASE WHEN pos > 1 THEN substr(s, pos - 1, 1) END AS prior FROM raw JOIN ctg USING (contig) WHERE found = ref AND ref <> alt
  UNION ALL SELECT id, contig, pos - CAST(e AS INTEGER), CASE WHEN e THEN prior ELSE '' END || ref[:-2], CASE WHEN e THEN prior ELSE '' END || alt[:-2], n + 1,
    CASE WHEN e THEN CASE WHEN pos > 2 THEN substr(s, pos - 2, 1) END ELSE prior END
  FROM (SELECT roll.*, s, length(ref) = 1 OR length(alt) = 1 AS e FROM roll JOIN ctg USING (contig)) WHERE ref[-1:] = alt[-1:] AND (NOT e OR pos > 1)),
fin AS (SELECT * FROM roll QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1),
lead AS (SELECT *, (SELECT count(*) FROM range(1, least(length(ref), length(alt))) AS t(i) WHERE ref[1:i] = alt[1:i]) AS k FROM fin)
SELECT raw.id, raw.contig, coalesce(lead.pos + k, raw.pos) AS new_pos, coalesce(lead.ref[k + 1:], raw.ref) AS new_ref, coalesce(lead.alt[k + 1:], raw.alt) AS new_alt,
  CASE WHEN lead.id IS NOT NULL THEN 'aligned' WHEN raw.found = raw.ref THEN 'same' ELSE 'unverified' END AS status FROM raw LEFT JOIN lead ON lead.id = raw.id""",
    "var01_verified": f"""WITH {_R} SELECT id, found, CASE WHEN ref = found THEN 'match' WHEN contig % 2 = 0 AND ref = translate(found, 'ACGT', 'CGTA') THEN 'mismatch, other build' ELSE 'mismatch' END AS "check" FROM raw""",
    "prj31_ref_check": f"""WITH {_R}, k AS (SELECT id % 10 AS file, contig, pos, ref, min(found) AS found FROM raw GROUP BY 1, 2, 3, 4),
m AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY contig, pos, ref) - 1 AS nr, greatest(1, count(*) OVER (PARTITION BY file) // {CHECKED}) AS step FROM k)
SELECT file, count(*) AS checked, count(*) FILTER (ref <> found) AS mismatch, min(pos) AS first, max(pos) AS last FROM m WHERE nr % step = 0 AND nr < step * {CHECKED} GROUP BY 1""",
}
QUERIES = {"prj03_left_aligned": query_left_aligned, "var01_verified": query_verified, "prj31_ref_check": query_ref_check}
