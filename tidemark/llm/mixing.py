"""Mixing sources to target shares of tokens, by balanced sampling with the cube method.

The total is the largest at which every available source holds its share without any document exceeding the source's
repeats (or a given budget, if smaller). Each document of a source then has the same expected number of copies; its
whole part is certain, its fraction an inclusion probability. The cube method moves these probabilities through the
null space of the balancing constraints, tokens and documents of the source, until they are 0 or 1: in blocks of
bounded size at first, then again over the at most two open documents that each block leaves, until a source has a
single block. The last two open documents of a source, the landing problem, are rounded for the smallest error in
tokens.

Blocks are hashed within a source, so a source with a third of all documents is many blocks, and no group is larger
than ``BLOCK`` in expectation.

Cases: rows with a null id and texts that are null, empty or without tokens are never drawn; documents of unnamed or null sources stay out; a
named source without documents reaches a share of zero, and its share goes to the others in proportion; rows of the
target table with a null source, or a share or repeats that are null or not above zero, ask for nothing; equal texts are
documents of their own; an empty table gives an empty mix; extra columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.session import Stages

#: Documents that a task moves through the null space together.
BLOCK = 4096
FRACTION = 1e-9


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: all but at most two are 0 or 1, and the sums of ``pi`` and of
    ``pi * size`` are kept."""
    pi, draws = pi.astype(float).copy(), rng.random(len(pi) + 3).tolist()
    p, x = pi.tolist(), size.astype(float).tolist()
    work, following, n, turn = [], 0, len(p), 0
    while True:
        while len(work) < 3 and following < n:
            if FRACTION < p[following] < 1 - FRACTION:
                work.append(following)
            else:
                p[following] = float(round(p[following]))
            following += 1
        if len(work) < 2:
            break
        if len(work) == 3:
            i, j, k = work
            u = (x[j] - x[k], x[k] - x[i], x[i] - x[j])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
        elif x[work[0]] == x[work[1]]:
            u = (1.0, -1.0)
        else:
            break
        up = min(((1 - p[m]) / v if v > 0 else -p[m] / v) for m, v in zip(work, u) if v)
        down = min((p[m] / v if v > 0 else (p[m] - 1) / v) for m, v in zip(work, u) if v)
        step = up if draws[turn % len(draws)] * (up + down) < down else -down
        turn += 1
        left = []
        for m, v in zip(work, u):
            p[m] += step * v
            if FRACTION < p[m] < 1 - FRACTION:
                left.append(m)
            else:
                p[m] = float(round(p[m]))
        work = left
    return np.asarray(p)


def land(pi: np.ndarray, size: np.ndarray, first: np.ndarray, exchange: bool = True) -> np.ndarray:
    """The open probabilities, at most two, rounded for the smallest error in tokens, then in documents. With
    ``exchange`` what error is left shrinks by the best single change: one document more or less, or one for another,
    among those that ``first`` left open; that serves the share and leaves the exact probabilities of the flight."""
    open_at = np.flatnonzero((pi > FRACTION) & (pi < 1 - FRACTION))
    best, want = None, (float((pi[open_at] * size[open_at]).sum()), float(pi[open_at].sum()))
    for bits in range(1 << len(open_at)):
        s = np.array([bits >> b & 1 for b in range(len(open_at))], float)
        error = (abs((s * size[open_at]).sum() - want[0]), abs(s.sum() - want[1]))
        if best is None or error < best[0]:
            best = (error, s)
    out = np.round(pi)
    out[open_at] = best[1]
    if not exchange:
        return out
    free = (first > FRACTION) & (first < 1 - FRACTION)
    into, from_ = np.flatnonzero(free & (out == 0)), np.flatnonzero(free & (out == 1))
    error = float((out * size).sum() - (first * size).sum())
    # Taking one in, leaving one out, or exchanging two; the row and column of zeros stand for neither.
    after = np.abs(error + np.append(size[into], 0)[:, None] - np.append(size[from_], 0)[None, :])
    i, j = np.unravel_index(after.argmin(), after.shape)
    out[into[i : i + 1]], out[from_[j : j + 1]] = 1.0, 0.0
    return out


def _mover(single: set[str], level: int, exchange: bool):
    """Flight of a block, and landing of the sources that have a single block; the seed follows from the block, so a rerun draws the same."""

    def move(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("doc_id", ignore_index=True)
        seed = int.from_bytes(f"{key[0]}/{key[1]}/{level}".encode(), "big")
        size = f["n_tokens"].to_numpy()
        first = f["pi"].to_numpy()
        pi = flight(first, size, np.random.default_rng(seed))
        return f[["doc_id", "source", "n_tokens", "base"]].assign(pi=land(pi, size, first, exchange) if key[0] in single else pi)

    return move


def plan(totals: list[tuple[str, float, int, int, int]], budget: int | None = None) -> list[dict]:
    """totals: source, target share, repeats, tokens, documents. The mix's expected copies a document by source."""
    live = [t for t in totals if t[3] > 0]
    if not live:
        return []
    whole = sum(t[1] for t in live)
    size = min(t[2] * t[3] / (t[1] / whole) for t in live)
    if budget is not None:
        size = min(size, float(budget))
    out = []
    for source, share, repeats, n_tokens, n_docs in live:
        expected = min(share / whole * size / n_tokens, float(repeats))
        base = math.floor(expected + FRACTION)
        out.append({"source": source, "base": base, "pi": max(0.0, expected - base), "docs": n_docs})
    return out


def mix(spark: SparkSession, documents: DataFrame, targets: DataFrame, budget: int | None = None, path: str = tokens.VOCABULARY, exchange: bool = True) -> tuple[DataFrame, DataFrame]:
    """documents: doc_id, source, text. targets: source, target_share, max_repeats (a row a source).

    Without ``exchange`` every document keeps exactly its probability; with it a source's landing may change one draw.
    Results: the documents drawn (doc_id, source, n_tokens, copies), and per named source the share aimed at and the
    share reached."""
    st = Stages(spark, "mixing")
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    # The target table has a row a source; the driver plans the mix from one row each.
    named = {r["source"]: r for r in wanted.collect()}
    chosen = documents.where(F.col("doc_id").isNotNull() & F.col("source").isin(list(named)) & (F.length("text") > 0)).select("doc_id", "source", "text")
    sized = st.write(tokens.count(chosen, path=path, keep=["doc_id", "source"]).where("n_tokens > 0"))
    sums = {r["source"]: r for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs")).collect()}
    made = plan([(s, r["target_share"], r["max_repeats"], int(sums[s]["n_tokens"]) if s in sums else 0, int(sums[s]["n_docs"]) if s in sums else 0) for s, r in sorted(named.items())], budget)
    rates = spark.createDataFrame(pd.DataFrame(made, columns=["source", "base", "pi", "docs"]).astype({"base": int, "pi": float, "docs": int}), "source string, base int, pi double, docs long")
    blocks = {m["source"]: math.ceil(m["docs"] / BLOCK) for m in made}
    # One row a named source, like the target table.
    now = sized.join(rates, "source").select("doc_id", "source", "n_tokens", "base", "pi")
    parts, level = [], 0
    fields = "doc_id long, source string, n_tokens long, base int, pi double"
    while True:
        # A source lands once it has a single block, with all that this block left open; later levels hold none of it.
        single = {s for s, b in blocks.items() if b <= 1}
        last = len(single) == len(blocks)
        count = F.element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col("source")) if blocks else F.lit(1)
        block = F.pmod(F.xxhash64("doc_id", F.lit(level)), F.greatest(count, F.lit(1)))
        moved = st.write(now.withColumn("block", block).groupBy("source", "block").applyInPandas(_mover(single, level, exchange), fields))
        parts.append(moved if last else moved.where((F.col("pi") <= 0) | (F.col("pi") >= 1)))
        if last:
            break
        now = moved.where((F.col("pi") > 0) & (F.col("pi") < 1))
        blocks = {s: math.ceil(2 * b / BLOCK) for s, b in blocks.items()}
        level += 1
    copies = (F.col("base") + F.round("pi").cast("int")).alias("copies")
    drawn = reduce(DataFrame.unionByName, parts).select("doc_id", "source", "n_tokens", copies).where("copies > 0")
    per = drawn.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"))
    total = per.agg(F.sum("n_tokens")).scalar()
    # One row a named source.
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    held = wanted.join(per, "source", "left")
    actual = F.coalesce(F.col("n_tokens") / total, F.lit(0.0))
    shares = held.select("source", "target_share", actual.alias("actual_share"), "max_repeats", *[zero(c) for c in ("n_docs", "n_copies", "most_copies", "n_tokens")])
    return drawn, shares
