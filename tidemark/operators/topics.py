"""Two levels of topics by k-means, fitted in distributed rounds of partial sums.

A round assigns vectors to the centres in Arrow batches and returns one sum a centre and task, so what is shuffled are
centres. The number of topics depends on the number of vectors, the second level on the size of each first one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, SEED, SUB_SIZE = 8, 42, 800


def topic_count(n: int) -> int:
    return min(n, max(1, min(32, max(16, round(math.sqrt(n) / 16)))))


def sub_count(n: int) -> int:
    return min(16, max(1, math.ceil(n / SUB_SIZE)))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


def _fit(df: DataFrame, groups: dict[int, int], rounds: int) -> dict[int, np.ndarray]:
    """df: g (group number), id, vector. Centres for each group, as many as ``groups`` asks. The first centres are the
    vectors of the smallest hashes."""
    most = max(groups.values())
    order = F.xxhash64(F.col("id").cast("string"), F.lit(SEED))
    from tidemark.operators.relational import first_per_key

    first = first_per_key(df, ["g"], [order, F.col("id")], most, "k").select("g", "k", "vector").collect()
    centres = {g: np.array([r["vector"] for r in sorted((r for r in first if r["g"] == g), key=lambda r: r["k"])[:k]], np.float64) for g, k in groups.items()}
    for _ in range(rounds):
        now = {g: c for g, c in centres.items()}

        def sums(frames: Iterable[pd.DataFrame], now: dict = now) -> Iterator[pd.DataFrame]:
            total: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
            for f in frames:
                for g, part in f.groupby("g"):
                    x, c = _matrix(part["vector"]), now[g]
                    near = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(axis=1)
                    for j in np.unique(near):
                        n, s = total.get((g, int(j)), (0, 0.0))
                        total[g, int(j)] = (n + int((near == j).sum()), s + x[near == j].sum(axis=0))
            yield pd.DataFrame([(g, j, n, s.tolist()) for (g, j), (n, s) in total.items()], columns=["g", "j", "n", "s"])

        parts = df.select("g", "vector").mapInPandas(sums, "g int, j int, n long, s array<double>")
        flat = parts.select("g", "j", "n", F.posexplode("s").alias("i", "x")).groupBy("g", "j", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        for r in flat.groupBy("g", "j").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("s")).collect():
            centres[r["g"]][r["j"]] = np.array(r["s"]) / r["n"]
    return centres


def _assign(df: DataFrame, centres: dict[int, np.ndarray], out: str) -> DataFrame:
    kind = df.schema["id"].dataType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            label = np.zeros(len(f), np.int32)
            for g, at in f.groupby("g").indices.items():
                c, x = centres[g], _matrix(f["vector"].iloc[at])
                label[at] = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(axis=1)
            yield pd.DataFrame({"id": f["id"], "vector": f["vector"], "g": f["g"], out: label})

    return df.mapInPandas(run, f"id {kind}, vector array<float>, g int, {out} int")


def two_level_topics(df: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """df: id, vector. Result: id, topic, subtopic (numbered within its topic). Null vectors have no topic; an empty
    table gives an empty result."""
    x = df.where("vector IS NOT NULL").select("id", F.col("vector").cast("array<float>").alias("vector"), F.lit(0).alias("g"))
    n = x.count()
    if not n:
        return x.select("id", F.lit(0).alias("topic"), F.lit(0).alias("subtopic"))
    top = _assign(x, _fit(x, {0: topic_count(n)}, rounds), "topic")
    inner = top.select("id", "vector", F.col("topic").alias("g"))
    sizes = {r["g"]: sub_count(r["n"]) for r in inner.groupBy("g").agg(F.count("*").alias("n")).collect()}
    sub = _assign(inner, _fit(inner, sizes, rounds), "subtopic")
    return sub.select("id", F.col("g").alias("topic"), "subtopic")
