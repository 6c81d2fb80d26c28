"""Relational building blocks shared by the queries: selections, windows, counts, spines, unions and closures.

All take and return DataFrames and stay lazy, but for ``closure`` and ``page_total``, which say so.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import Stages


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next rows by a unique key, after the last one seen."""
    return (df.where(F.col(key) > F.lit(after)) if after is not None else df).orderBy(key).limit(size)


def keyset_page_desc(df: DataFrame, first: str, second: str, before: tuple | None, size: int) -> DataFrame:
    """The next rows by a descending composite key."""
    if before is not None:
        a, b = (F.lit(x) for x in before)
        df = df.where((F.col(first) < a) | ((F.col(first) == a) & (F.col(second) < b)))
    return df.orderBy(F.col(first).desc(), F.col(second).desc()).limit(size)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; Spark limits groups before the shuffle, so a hot key sends n rows a partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def later_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All but the first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank > 1").drop("_rank")


def with_selected(base: DataFrame, key: str, choices: DataFrame, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Base rows with the columns of the one choice selected for their key, null where there is none."""
    one = first_per_key(choices, [key], order).select(key, *columns)
    return base.join(one, key, "left")


def within(df: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(scope.select(*keys), list(keys), "left_semi")


def missing_from(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_anti")


def overlaps(start: Column, end: Column, low, high) -> Column:
    """Closed intervals that touch the closed window."""
    return (end >= F.lit(low)) & (start <= F.lit(high))


def differs(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Whether any pair is distinct, null being a value."""
    return reduce(lambda a, b: a | b, [~x.eqNullSafe(y) for x, y in pairs])


def counts_by(df: DataFrame, key: str, status: str, statuses: Sequence[str]) -> DataFrame:
    """Nested counts, total and share in per cent of all rows, a row a key."""
    per = df.groupBy(key).agg(*[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in statuses], F.count("*").alias("total"))
    whole = df.agg(F.count("*")).scalar()
    return per.withColumn("percent", F.round(F.lit(100.0) * F.col("total") / whole, 2))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def clamped_rest(*parts: Column) -> Column:
    """The first part less the others, not below zero."""
    return F.greatest(F.lit(0), reduce(lambda a, b: a - b, parts))


def gap_filled(series: DataFrame, at: str, spine: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row a point of the spine, with zero where the series has none."""
    return spine.join(series, at, "left").select(at, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def running_total(df: DataFrame, order: str, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """A running total per key over rows that are already reduced to one a point in time."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(w))


def moving_average(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int, out: str) -> DataFrame:
    """Trailing mean of n points that starts afresh after a null."""
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("_island", F.count_if(F.col(value).isNull()).over(run))
    w = Window.partitionBy(*keys, "_island").orderBy(order).rowsBetween(-(n - 1), 0)
    return marked.withColumn(out, F.when(F.col(value).isNotNull(), F.round(F.avg(value).over(w), 2))).drop("_island")


def months_covered(df: DataFrame, start_day: Column, end_day: Column, out: str = "month") -> DataFrame:
    """A row for each month that an interval of day numbers touches; an end before the start counts as the start."""
    first = F.trunc(F.date_from_unix_date(start_day), "month")
    last = F.trunc(F.date_from_unix_date(F.greatest(start_day, end_day)), "month")
    return df.withColumn(out, F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))))


def tagged_union(parts: dict[str, DataFrame], tag: str = "kind") -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(k)) for k, df in parts.items()])


def capped_union(parts: dict[str, tuple[DataFrame, Sequence[Column], int]], tag: str = "kind") -> DataFrame:
    """Search hits of several kinds, each ordered and cut at its own limit."""
    return tagged_union({k: df.orderBy(*order).limit(n) for k, (df, order, n) in parts.items()}, tag)


def retained(df: DataFrame, keys: Sequence[str], order: Sequence[Column], current: Column, ready: Column, keep: int) -> DataFrame:
    """Versions with ``retained``: the current one and the newest ready ones of each key stay."""
    w = Window.partitionBy(*keys).orderBy(ready.desc(), *order)
    rank = F.row_number().over(w)
    return df.withColumn("retained", current | (ready & (rank <= keep)))


def closure(edges: DataFrame, roots: DataFrame, child: str, parent: str) -> DataFrame:
    """(root, node, depth) of all descendants. One job a level until a level is empty, however deep; a node that is
    reached again ends its branch, so cycles end too. Levels are written tables, so plans do not grow with depth."""
    st = Stages(edges.sparkSession, "closure")
    links = edges.select(F.col(parent).alias("node"), F.col(child).alias("next"))
    level = st.write(roots.select(F.col(child).alias("root"), F.col(child).alias("node"), F.lit(0).alias("depth")))
    paths = []
    while True:
        paths.append(level._tidemark_path)
        out = edges.sparkSession.read.schema(level.schema).parquet(*paths)
        step = level.join(links, "node").select("root", F.col("next").alias("node"), F.lit(len(paths)).alias("depth"))
        level = st.write(step.join(out.select("root", "node"), ["root", "node"], "left_anti"))
        if level.isEmpty():
            return out


def page_total(df: DataFrame, order: Sequence[Column], offset: int, size: int) -> tuple[DataFrame, int]:
    """A page and the number of all rows (one job)."""
    return df.orderBy(*order).offset(offset).limit(size), df.count()


def clamp_limit(value, default: int = 50, most: int = 200) -> int:
    """A page size from a parameter: the default for none, otherwise an integer within bounds."""
    if value is None:
        return default
    if isinstance(value, bool) or not str(value).strip().lstrip("-").isdigit():
        raise ValueError(f"limit {value!r} is no integer")
    return max(1, min(most, int(value)))


def csv_values(text: str | None, *more: str | None) -> list[str]:
    """Distinct values of a comma-separated parameter and of further single ones, in order."""
    parts = [x.strip() for x in (text or "").split(",")] + [(x or "").strip() for x in more]
    return list(dict.fromkeys(x for x in parts if x))


def ranked_lookahead(df: DataFrame, key: str, order: Sequence[Column], node: str, ahead: int) -> DataFrame:
    """Pairs of each row with the next ``ahead`` rows of its key, by order and before any other condition.

    Rows are numbered over all keys by sorted ranges, so that the rows of a key follow one another and none of them
    needs a task of its own; a target joins the sources of its own block of numbers and of the one before, so the join
    is by equality and a hot key spreads over its blocks. Null keys have no pairs."""
    from tidemark.sources.scene import numbered

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(node).alias("_node"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    placed = numbered(rows, ["_k", *[f"_o{i}" for i in range(len(order))]], "_place", "long").select("_k", "_node", "_place")
    a = placed.withColumn("_block", F.floor(F.col("_place") / ahead)).alias("a")
    b = placed.withColumn("_block", F.explode(F.array(F.floor(F.col("_place") / ahead), F.floor(F.col("_place") / ahead) - 1))).alias("b")
    on = (F.col("a._block") == F.col("b._block")) & (F.col("a._k") == F.col("b._k")) & (F.col("b._place") > F.col("a._place")) & (F.col("b._place") <= F.col("a._place") + ahead)
    return a.join(b, on).select(F.col("a._k").alias(key), F.col("a._node").alias("source"), F.col("b._node").alias("target"), (F.col("b._place") - F.col("a._place")).alias("steps"))
