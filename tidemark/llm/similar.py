"""The k most similar vectors of every vector, within an accuracy that is measured: sharded small-world graphs.

Vectors are routed to the shards of their most similar centroids; each shard holds a navigable small-world graph as
flat neighbour arrays (``hnsw``); queries visit ``probes`` shards, or all, and the shards' results are merged. Where
queries are many, a shard answers them in slices. The centroids are
fitted on a sample of at most ``SAMPLE`` vectors a shard, drawn by hash; every vector is indexed and none is capped.
There are as many shards as vectors ask for, so a query has the same number of copies at any size: up to ``FIT`` of them
are fitted together, more in two levels, the second within each cell of the first as tasks of their own. A shard that
would still outgrow ``LARGEST``, a hot cell, is split by hash, and its queries visit all its parts.

Vectors that are equal bit by bit are one class: only a representative is indexed, and results return to the members by
joins whose small side is at most k + 1 rows a class. A class with a third of all rows costs one vertex and k rows a
member.

Cases: null ids and vectors that are null, of another length, zero, or with null or infinite elements take no part;
repeated rows of an id count once; ties go to the smaller id; fewer than k others give fewer rows; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.hnsw import Graph, unit_hash
from tidemark.session import Stages

#: Vectors a shard is planned for, the most a part of one is meant to hold, and the shards that are fitted together.
SHARD, LARGEST, FIT = 4000, 8192, 2048
#: Centroids that every task holds at most: 64 MB of 64 dimensions, enough for a billion vectors; beyond, shards are
#: planned larger and split by hash.
MOST = 262_144
#: Sampled vectors a shard, from which the centroids are fitted, and rounds of fitting.
SAMPLE, ROUNDS = 32, 6
#: The most queries that a part is meant to get at once, and rows of routed queries in a batch.
SLICE, ROUTED = 131_072, 65_536


def _content(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a vector's exact content."""
    bits = x.view(np.uint32).astype(np.uint64) + np.uint64(1)
    out = []
    for seed in (7, 11):
        odd = (unit_hash(np.arange(x.shape[1]), seed) * 2**53).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        h = (bits * odd).sum(axis=1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        out.append((h ^ (h >> np.uint64(29))).view(np.int64))
    return out[0], out[1]


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float32)
    offsets = (np.arange(len(x) + 1) * x.shape[1] * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.frombuffer(b"".join(c.to_pylist()), np.float32).reshape(-1, dim) for c in chunks]) if chunks else np.zeros((0, dim), np.float32)


def usable(df: DataFrame, id_column: str, vector: str, dim: int, anchors: np.ndarray, ranks: np.ndarray, least_anchor: float) -> DataFrame:
    """The vectors that take part: id, c1, c2 (content), vec (unit length), and anchor_rank of the most similar anchor
    if its similarity is at least ``least_anchor``, else null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v = b.column(0), b.column(1)
            fits = pc.fill_null(pc.and_(pc.equal(pc.list_value_length(v), dim), pc.is_valid(ids)), False)
            ids, v = ids.filter(fits), v.filter(fits)
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            x, norm, ids = np.ascontiguousarray(x[good]), norm[good], ids.filter(pa.array(good))
            unit = (x / norm[:, None]).astype(np.float32)
            c1, c2 = _content(x)
            if len(anchors) and len(x):
                s = unit @ anchors.T
                at = s.argmax(axis=1)
                near = pa.array(ranks[at], pa.int32(), mask=s[np.arange(len(s)), at] < least_anchor)
            else:
                near = pa.nulls(len(x), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(c1), pa.array(c2), _binary(unit), near], names=["id", "c1", "c2", "vec", "anchor_rank"])

    return df.select(id_column, vector).mapInArrow(run, "id long, c1 long, c2 long, vec binary, anchor_rank int")


def _fit(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of unit vectors by spherical k-means, and how many vectors are nearest to each."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(5)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        near = _closest(x, c)
        mass = np.stack([np.bincount(near, x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        length = np.linalg.norm(mass, axis=1)
        c = np.where(length[:, None] > 0, mass / np.maximum(length, 1e-12)[:, None], c).astype(np.float32)
    return c, np.bincount(_closest(x, c), minlength=len(c))


def _blocks(n: int, k: int) -> Iterator[slice]:
    """Rows whose products with k centroids fit into 64 MB."""
    step = max(16, (1 << 24) // max(k, 1))
    return (slice(a, a + step) for a in range(0, n, step))


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[(x[b] @ c.T).argmax(axis=1) for b in _blocks(len(x), len(c))]]).astype(np.int64)


def _sampled(vectors: DataFrame, rate: float) -> DataFrame:
    return vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < int(rate * 1_000_000_000)).select("id", "vec")


def _fetched(rows: DataFrame, dim: int) -> np.ndarray:
    t = rows.toArrow()
    return _matrix(t["vec"], dim)[np.argsort(t["id"].to_numpy(), kind="stable")]


def centroids(vectors: DataFrame, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids fitted on a sample, and the share of the sample nearest to each."""
    k = min(MOST, max(1, math.ceil(n / SHARD)))
    if k == 1:
        return np.zeros((1, dim), np.float32), np.ones(1)
    if k <= FIT:
        c, held = _fit(_fetched(_sampled(vectors, min(1.0, SAMPLE * k / n)), dim), k)
        return c, held / held.sum()
    upper = min(FIT, math.isqrt(k))
    top, _ = _fit(_fetched(_sampled(vectors, min(1.0, SAMPLE * FIT / n)), dim), upper)
    rate = min(1.0, SAMPLE * k / n)

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_closest(_matrix(b.column(1), dim), top).astype(np.int32)), b.column(0), b.column(1)], names=["cell", "id", "vec"])

    def within(t: pa.Table) -> pa.Table:
        x = _matrix(t["vec"], dim)[np.argsort(t["id"].to_numpy(), kind="stable")]
        c, held = _fit(x, max(1, round(len(x) / (n * rate) * k)))
        return pa.table({"cell": np.full(len(c), t["cell"][0].as_py(), np.int32), "held": held.astype(np.int64), "vec": _binary(c)})

    # A cell's sample is ``SAMPLE`` vectors for each of its centroids.
    made = _sampled(vectors, rate).mapInArrow(cells, "cell int, id long, vec binary").groupBy("cell").applyInArrow(within, "cell int, held long, vec binary").toArrow()
    order = np.lexsort((made["held"].to_numpy(), made["cell"].to_numpy()))
    held = made["held"].to_numpy()[order]
    return _matrix(made["vec"], dim)[order], held / held.sum()


def _route(vectors: DataFrame, c: np.ndarray, parts: np.ndarray, probes: int, every: int, dim: int, slices: int) -> DataFrame:
    """shard, part, slice, role (1 member, 2 query, 3 both), id, vec. Members are in every slice, a query in one."""
    shared = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(at: np.ndarray, shard: np.ndarray, part: np.ndarray, cut: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(z.astype(np.int32)) for z in (shard, part, cut, role)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ids[at]), _binary(x[at])], names=["shard", "part", "slice", "role", "id", "vec"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            c = shared.value
            near = np.concatenate([_nearest_shards(x[b] @ c.T, probes) for b in _blocks(len(x), len(c))])
            home = near[:, 0]
            own = np.minimum((unit_hash(ids, 3) * parts[home]).astype(int), parts[home] - 1)
            asks, mine = ids % every == 0, np.minimum((unit_hash(ids, 9) * slices).astype(int), slices - 1)
            for cut in range(slices):
                yield rows(np.arange(len(ids)), home, own, np.full(len(ids), cut), np.where(asks & (mine == cut), 3, 1))
            # A query for each part of each probed shard; the member's row doubles as the query of its own part.
            asking = np.flatnonzero(asks)
            step = max(1, ROUTED // (probes * int(parts.max())))
            for a in range(0, len(asking), step):
                at = asking[a : a + step]
                shard = near[at].ravel()
                row = np.repeat(at, probes)
                row, shard = np.repeat(row, parts[shard]), np.repeat(shard, parts[shard])
                part = _within(row, shard)
                other = (shard != home[row]) | (part != own[row])
                row, shard, part = row[other], shard[other], part[other]
                yield rows(row, shard, part, mine[row], np.full(len(row), 2))

    return vectors.select("id", "vec").mapInArrow(run, "shard int, part int, slice int, role int, id long, vec binary")


def _nearest_shards(s: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` best columns of each row, the best first."""
    top = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


def _within(row: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal (row, shard)."""
    if not len(row):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])])
    first = np.flatnonzero(new)
    return np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))


def _search(k: int, ef: int, links: int, least: float, dim: int):
    def run(t: pa.Table) -> pa.Table:
        role, ids, x = t["role"].to_numpy(), t["id"].to_numpy(), _matrix(t["vec"], dim)
        order = np.argsort(ids, kind="stable")
        role, ids, x = role[order], ids[order], x[order]
        member, query = (role & 1) > 0, (role & 2) > 0
        q, found = np.zeros(0, np.int64), (np.zeros((0, 1), np.int32), np.zeros((0, 1), np.float32))
        if member.any() and query.any():
            q = ids[query]
            found = Graph(x[member], ids[member], links).search(x[query], k + 1, max(ef, k + 1))
        at, s = found
        other = np.where(at >= 0, ids[member][np.maximum(at, 0)], -1) if len(q) else np.zeros((0, 1), np.int64)
        use = (at >= 0) & (other != q[:, None]) & (s >= least)
        row, column = np.nonzero(use)
        return pa.table({"id": q[row], "other": other[row, column], "similarity": s[row, column].astype(float)})

    return run


def most_similar(spark: SparkSession, vectors: DataFrame, dim: int, k: int, least: float = -1.0, probes: int | None = 3, every: int = 1, ef: int = 16, links: int = 12) -> DataFrame:
    """vectors: id, vec as of ``usable``, an id once. The k most similar others of every id divisible by ``every``:
    id, other, similarity (at least ``least``), rank. Without ``probes`` a query visits every shard."""
    n, asked = vectors.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    c, share = centroids(vectors, n, dim)
    probes = min(probes or len(c), len(c))
    parts = np.maximum(1, np.ceil(n * share / LARGEST)).astype(int)
    slices = max(1, math.ceil(asked * probes / len(c) / SLICE))
    routed = _route(vectors, c, parts, probes, every, dim, slices)
    # As many partitions as parts: a task holds a part or a few, however many vectors there are.
    hits = routed.repartition(int(parts.sum()) * slices, "shard", "part", "slice").groupBy("shard", "part", "slice").applyInArrow(_search(k, ef, links, least, dim), "id long, other long, similarity double")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_copies(edges: DataFrame, used: DataFrame, k: int) -> DataFrame:
    """From representatives to all ids: id, other, similarity, rank, at most k for each id.

    A copy has similarity 1; of a class's members the smallest k ids stand for it in the lists of others."""
    copies = used.select("c1", "c2", "id").distinct()
    first = copies.withColumn("place", F.row_number().over(Window.partitionBy("c1", "c2").orderBy("id"))).where(F.col("place") <= k + 1)
    classes = first.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count("*").alias("held")).where("held > 1")
    shown = first.join(classes, ["c1", "c2"]).select("c1", "c2", "rep", "held", "last", F.col("id").alias("shown"), "place")
    members = copies.join(shown, ["c1", "c2"])
    inside = members.where((F.col("shown") != F.col("id")) & ((F.col("id") <= F.col("last")) | (F.col("place") <= k)))
    inside = inside.select("id", F.col("shown").alias("other"), F.lit(1.0).alias("similarity"))
    spare = edges.join(classes.select(F.col("rep").alias("id"), "held"), "id", "left").withColumn("spare", F.lit(k) - F.coalesce(F.col("held") - 1, F.lit(0))).where("spare > 0")
    wide = spare.join(shown.where(F.col("place") <= k).select(F.col("rep").alias("other"), "shown"), "other", "left").select("id", F.coalesce("shown", "other").alias("other"), "similarity", "spare")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    kept = wide.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("spare"))
    own = shown.select(F.col("rep").alias("id"), F.col("shown").alias("member"))
    outside = kept.join(own, "id", "left").select(F.coalesce("member", "id").alias("id"), "other", "similarity")
    both = inside.unionByName(outside)
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def representatives(used: DataFrame) -> DataFrame:
    """One id and vector a class of equal vectors."""
    return used.groupBy("c1", "c2").agg(F.min("id").alias("id"), F.first("vec").alias("vec")).select("id", "vec")


def record_and_anchor_pairs(spark: SparkSession, records: DataFrame, anchors: DataFrame, id_column: str, dim: int, k: int, least: float, least_anchor: float) -> DataFrame:
    """anchors: rank, vector; a fixed table. Result: pair_kind, left_key, right_key."""
    rows = [r for r in anchors.collect() if r[0] is not None and r[1] is not None and len(r[1]) == dim and None not in r[1]]
    rows = [r for r in rows if 0 < np.linalg.norm(np.array(r[1], np.float64)) < np.inf]
    a = np.array([r[1] for r in sorted(rows)], np.float64).reshape(-1, dim)
    a = (a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)).astype(np.float32)
    st = Stages(spark, "similar")
    used = st.write(usable(records, id_column, "vector", dim, a, np.array([r[0] for r in sorted(rows)], np.int32), least_anchor))
    reps = st.write(representatives(used))
    pairs = with_copies(most_similar(spark, reps, dim, k, least), used, k)
    key = lambda c: c.cast("int")
    record = pairs.select(F.lit("record").alias("pair_kind"), key(F.least("id", "other")).alias("left_key"), key(F.greatest("id", "other")).alias("right_key")).distinct()
    anchor = used.where("anchor_rank IS NOT NULL").select(F.lit("anchor").alias("pair_kind"), key(F.col("id")).alias("left_key"), F.col("anchor_rank").alias("right_key")).distinct()
    return record.unionByName(anchor)


def ranked_similar(spark: SparkSession, records: DataFrame, id_column: str, dim: int, k: int, every: int, probes: int | None = None) -> DataFrame:
    """The k most similar records of every id divisible by ``every``, against all: id, other, rank, similarity.

    Without a least similarity the nearest may lie in any shard, so every shard is visited unless ``probes`` is given."""
    st = Stages(spark, "similar")
    used = st.write(usable(records, id_column, "vector", dim, np.zeros((0, dim), np.float32), np.zeros(0, np.int32), 2.0))
    # Every id asks for itself here, copies included, so classes of copies are not reduced.
    one = st.write(used.groupBy("id").agg(F.first("vec").alias("vec")))
    return most_similar(spark, one, dim, k, probes=probes, every=every, ef=32)

