"""Results as JSON texts under a byte budget: the longest list is cut, what was cut is said, provenance goes last.

All in the JVM, from the schema: which lists a result can have is known before any row is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType


def finite(c: Column, kind: DataType) -> Column:
    """`c` with null for numbers that JSON can't hold, at any depth."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: finite(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda k, v: finite(v, kind.valueType))
    return c


def lists(kind: StructType, path: str = "") -> list[str]:
    """Paths of the lists of a struct, those within structs too; lists within lists are cut with what holds them."""
    out = []
    for f in kind.fields:
        at = f"{path}.{f.name}" if path else f.name
        if isinstance(f.dataType, ArrayType):
            out.append(at)
        elif isinstance(f.dataType, StructType):
            out += lists(f.dataType, at)
    return out


def text(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def size(c: Column) -> Column:
    """Bytes of a value's JSON text."""
    return F.octet_length(text(c))


def fitting(items: Column, room: Column) -> Column:
    """How many first items fit into `room` bytes as a JSON list: by running sums of their sizes and commas."""
    # An item's own size is that of a list of it, less the brackets.
    ends = F.aggregate(
        F.transform(items, lambda x: size(F.array(x)) - 2),
        F.struct(F.lit(1).alias("used"), F.lit(0).alias("n")),
        lambda a, n: F.struct((a["used"] + n + 1).alias("used"), (a["n"] + F.when(a["used"] + n + 1 <= room, 1).otherwise(0)).alias("n")),
    )
    return ends["n"]


def _fixed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with columns worked out behind a generator, so that they aren't copied into every later expression."""
    named = F.struct(*(c.alias(n) for n, c in columns.items()))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(named)).alias("_f")).select(*rest, *(F.col(f"_f.{n}").alias(n) for n in columns))


def enveloped(rows: DataFrame, budget: Column) -> DataFrame:
    """`rows` with `warnings` and `json`, the text of (query, warnings, sources, result), of at most `budget` bytes.

    `rows` has query (string), sources (a list) and result (a struct). While the text is too long, the longest list of the
    result (by items, then bytes, then the first) keeps as many first items as fit; the sources are cut once no list of the result is left, or
    if they alone take half the budget and more than that list. A query of more than a quarter of the budget (200 bytes at least) is cut before.
    Every cut is a warning. If all that isn't enough, the result is dropped, then the sources, then the query, and that alone is said.
    """
    df = rows.withColumn("budget", budget)
    df = _fixed(df, {"result": finite(F.col("result"), rows.schema["result"].dataType), "warnings": F.array().cast("array<string>")})
    quarter = F.greatest(F.lit(200), F.expr("budget div 4"))
    long = F.coalesce(F.octet_length("query") > quarter, F.lit(False))
    said = F.concat(F.lit("query cut to "), F.expr("budget div 16").cast("string"), F.lit(" characters"))
    whole = lambda: size(F.struct("query", "warnings", "sources", "result"))
    over = long & (whole() > F.col("budget"))
    df = _fixed(df, {"query": F.when(over, F.left("query", F.expr("CAST(budget div 16 AS INT)"))).otherwise(F.col("query")), "warnings": F.when(over, F.array_append("warnings", said)).otherwise(F.col("warnings"))})

    paths = [f"result.{p}" for p in lists(rows.schema["result"].dataType)]
    for _ in range(len(paths) + 1):
        measured = {f"_n{i}": F.coalesce(F.size(p), F.lit(0)) for i, p in enumerate(paths)} | {f"_b{i}": F.coalesce(size(F.col(p)), F.lit(0)) for i, p in enumerate(paths)}
        df = _fixed(df, measured | {"_all": whole(), "_sources": F.coalesce(size(F.col("sources")), F.lit(0))})
        rank = F.array(*(F.struct(F.col(f"_n{i}").alias("n"), F.col(f"_b{i}").alias("b"), F.lit(-i).alias("i")) for i in range(len(paths))))
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("b"), F.lit(1).alias("i"))
        best = F.coalesce(F.array_max(rank), none) if paths else none
        df = _fixed(df, {"_best": best})
        provenance = (F.coalesce(F.size("sources"), F.lit(0)) > 0) & ((F.col("_best.n") == 0) | ((F.col("_sources") * 2 > F.col("budget")) & (F.col("_sources") > F.col("_best.b"))))
        df = _fixed(df, {"_over": F.col("_all") > F.col("budget"), "_prov": provenance})

        def cut(df: DataFrame, path: str, mine: Column, bytes_: Column) -> DataFrame:
            items, n = F.col(path), F.coalesce(F.size(path), F.lit(0))
            told = lambda gone: F.concat(F.lit(f"{path}: "), gone.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" items dropped"))
            room = F.col("budget") - (F.col("_all") - bytes_) - F.octet_length(told(n)) - 3  # the longest wording, its quotes and a comma
            now = F.col("_over") & mine & (n > 0)
            df = _fixed(df, {"_keep": F.when(now, F.least(fitting(items, room), n - 1))})
            some = F.slice(items, F.lit(1), F.col("_keep"))
            top, _, inner = path.partition(".")
            value = F.when(F.col("_keep").isNotNull(), F.col(top).withField(inner, some) if inner else some).otherwise(F.col(top))
            return _fixed(df, {top: value, "warnings": F.when(F.col("_keep").isNotNull(), F.array_append("warnings", told(n - F.col("_keep")))).otherwise(F.col("warnings"))}).drop("_keep")

        for i, p in enumerate(paths):
            df = cut(df, p, ~F.col("_prov") & (F.col("_best.i") == -i), F.col(f"_b{i}"))
        df = cut(df, "sources", F.col("_prov"), F.col("_sources"))
        df = df.drop("_all", "_sources", "_best", "_over", "_prov", *(f"_n{i}" for i in range(len(paths))), *(f"_b{i}" for i in range(len(paths))))
    for column in ("result", "sources", "query"):
        over = (whole() > F.col("budget")) & F.col(column).isNotNull()
        df = _fixed(df, {"_over": over})
        nothing = F.lit(None).cast(rows.schema[column].dataType)
        df = _fixed(df, {column: F.when(F.col("_over"), nothing).otherwise(F.col(column)), "warnings": F.when(F.col("_over"), F.array(F.lit(f"{column} dropped"))).otherwise(F.col("warnings"))}).drop("_over")
    return df.withColumn("json", text(F.struct("query", "warnings", "sources", "result"))).drop("budget")
