"""Exact nearest vectors of a stated query set: blocked matrix products, reduced to the best of each block."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries a block and vectors a slice; a task holds one of each.
BLOCK, SLICE = 512, 20_000


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def exact_nearest(queries: DataFrame, vectors: DataFrame, k: int, itself: bool = False) -> DataFrame:
    """queries and vectors: id BIGINT, vector. Result: id, other, place, similarity; ties go to the smaller id.

    Every block of queries meets every slice of vectors, so the work is that of all pairs of the stated queries with the
    vectors; a slice keeps k candidates a query, and only those are merged. Use the graphs of the similarity operator
    where queries are as many as vectors."""
    slices = max(1, math.ceil(vectors.count() / SLICE))
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    part = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    q = queries.select("id", "vector", part(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    v = vectors.select("id", "vector", part(slices, 2).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "other": [], "similarity": []})
        qid, ids = left["id"].to_numpy(), right["id"].to_numpy()
        s = np.round(_unit(left["vector"]) @ _unit(right["vector"]).T, 9)
        if not itself:
            s[qid[:, None] == ids[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        best = np.take_along_axis(s, order, 1)
        keep = best > -np.inf
        return pd.DataFrame({"id": qid[np.nonzero(keep)[0]], "other": ids[order[keep]], "similarity": best[keep]})

    hits = q.groupBy("block", "slice").cogroup(v.groupBy("block", "slice")).applyInPandas(meet, "id long, other long, similarity double")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)



#: Rows that a fixed table of vectors has at most.
FIXED = 100_000


def nearest_fixed(queries: DataFrame, fixed: DataFrame, k: int) -> DataFrame:
    """The k nearest of a small fixed table, such as anchors, for every query: id, other, place, similarity. The table is
    read by the driver, at most ``FIXED`` rows (ValueError beyond), and goes to every task; nothing is shuffled."""
    rows = fixed.where("id IS NOT NULL AND vector IS NOT NULL").select("id", "vector").limit(FIXED + 1).toPandas()
    if len(rows) > FIXED:
        raise ValueError(f"more than {FIXED} vectors are no fixed table")
    rows = rows.sort_values("id", ignore_index=True)
    ids, x = rows["id"].to_numpy(), _unit(rows["vector"]) if len(rows) else np.zeros((0, 1))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f) or not len(ids):
                continue
            s = np.round(_unit(f["vector"]) @ x.T, 9)
            # Rows are in the order of ids, so a stable sort gives ties to the smaller.
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            n, m = best.shape
            yield pd.DataFrame({"id": np.repeat(f["id"].to_numpy(), m), "other": ids[best.ravel()], "place": np.tile(np.arange(1, m + 1), n), "similarity": np.take_along_axis(s, best, 1).ravel()})

    return queries.where("vector IS NOT NULL").select("id", "vector").mapInPandas(run, "id long, other long, place int, similarity double")
