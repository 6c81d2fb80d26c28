"""The most similar records of every record of a domain: an approximate similarity join in cells.

A domain of at most ``CELL`` usable vectors is one cell, and there the join is exact. A larger one has a cell for every
``CELL`` of them, around centroids fitted on at most ``SAMPLE`` vectors a cell, drawn by hash, domain by domain in tasks
of their own; a record is a member of the nearest cell and asks in the ``PROBES`` nearest, so it has as many copies in a
domain of any size. Cells that hold more than ``LARGEST``, such as many copies of one vector, are split by hash and asked
in all parts. Within a part, blocks of matrix products keep the best ``k`` of each record, and these are merged.

Cases: null ids and domains and vectors that are null, zero, not finite, or not of the stated length take no part; an id
that repeats counts once; ties go to the smaller id; fewer than k others give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors as V

#: Vectors a cell, the most of a part, sampled vectors a cell, rounds of fitting, and cells that a record asks in.
CELL, LARGEST, SAMPLE, ROUNDS, PROBES = 2048, 8192, 32, 6, 4
#: Centroids of all domains together that every task holds at most, 64 MB of 64 dimensions; beyond, cells are larger.
MOST = 262_144
BLOCK = 1024


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(5).permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        mass = np.zeros_like(c)
        np.add.at(mass, near, x)
        length = np.linalg.norm(mass, axis=1, keepdims=True)
        c = np.where(length > 0, mass / np.maximum(length, 1e-12), c)
    return c, np.bincount((x @ c.T).argmax(axis=1), minlength=len(c)) / len(x)


def _cells(used: DataFrame, sizes: pd.DataFrame, kind: str) -> dict:
    """Per domain of more than a cell: its centroids and the parts of each cell."""
    if not len(sizes):
        return {}
    many = max(CELL, math.ceil(sizes["n"].sum() / MOST))
    want = {d: (n, math.ceil(n / many)) for d, n in zip(sizes["domain"], sizes["n"])}
    plan = used.sparkSession.createDataFrame([(d, float(SAMPLE * c / n), c) for d, (n, c) in want.items()], f"domain {kind}, rate double, cells int")
    drawn = used.join(plan, "domain").where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1_000_000)) < F.col("rate") * 1_000_000)

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", ignore_index=True)
        c, share = _fit(_unit(f["vector"]), int(f["cells"][0]))
        return pd.DataFrame({"domain": f["domain"][0], "centroid": list(c), "share": share})

    rows = drawn.select("domain", "id", "vector", "cells").groupBy("domain").applyInPandas(fit, f"domain {kind}, centroid array<double>, share double").toPandas()
    out = {}
    for d, f in rows.groupby("domain", sort=True):
        out[d] = np.stack(f["centroid"].to_numpy()), np.maximum(1, np.ceil(f["share"].to_numpy() * want[d][0] / LARGEST)).astype(int)
    return out


def neighbours(records: DataFrame, k: int = 32, dim: int = 64) -> DataFrame:
    """records: domain, id, vector. Result: domain, id, other, place, similarity."""
    kind, id_kind = (records.schema[c].dataType.simpleString() for c in ("domain", "id"))
    usable = records.where(F.col("domain").isNotNull() & F.col("id").isNotNull() & V.valid(F.col("vector"), dim))
    used = usable.groupBy("domain", "id").agg(F.first("vector").alias("vector"))
    # A row a domain of more than a cell: of n records there are at most n / CELL of these.
    sizes = used.groupBy("domain").agg(F.count("*").alias("n")).where(F.col("n") > CELL).toPandas()
    shared = records.sparkSession.sparkContext.broadcast(_cells(used, sizes, kind))

    def route(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """domain, cell, part, role (1 member, 2 asks, 3 both), id, vector."""
        cells = shared.value
        for f in frames:
            for d, g in f.groupby("domain", sort=False):
                if d not in cells:
                    yield g.assign(cell=0, part=0, role=3)
                    continue
                c, parts = cells[d]
                s = _unit(g["vector"]) @ c.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :PROBES]
                own = (pd.util.hash_array(g["id"].to_numpy()) % np.uint64(1 << 30)).astype(int) % parts[near[:, 0]]
                yield g.assign(cell=near[:, 0], part=own, role=1)
                for j in range(near.shape[1]):
                    for p in range(int(parts[near[:, j]].max())):
                        ask = parts[near[:, j]] > p
                        yield g[ask].assign(cell=near[ask, j], part=p, role=2)

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id", kind="stable", ignore_index=True)
        role = f["role"].to_numpy()
        member, ask = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        x, ids, out = _unit(f["vector"]), f["id"].to_numpy(), []
        for a in range(0, len(ask), BLOCK):
            at = ask[a : a + BLOCK]
            s = np.round(x[at] @ x[member].T, 9)
            s[ids[at][:, None] == ids[member][None, :]] = -np.inf
            # Members are in the order of ids, so a stable sort gives ties to the smaller.
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            top = np.take_along_axis(s, best, 1)
            row, column = np.nonzero(top > -np.inf)
            out.append(pd.DataFrame({"domain": f["domain"][0], "id": ids[at][row], "other": ids[member][best[row, column]], "similarity": top[row, column]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"domain": [], "id": [], "other": [], "similarity": []})

    routed = used.mapInPandas(route, f"domain {kind}, id {id_kind}, vector {records.schema['vector'].dataType.simpleString()}, cell int, part int, role int")
    hits = routed.groupBy("domain", "cell", "part").applyInPandas(meet, f"domain {kind}, id {id_kind}, other {id_kind}, similarity double")
    w = Window.partitionBy("domain", "id").orderBy(F.desc("similarity"), "other")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("domain", "id", "other", "place", "similarity")
