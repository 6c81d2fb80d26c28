"""Reduced vectors and three-dimensional layouts.

Principal components come from one pass of partial sums (the moments of 64 dimensions are a fixed 64 by 64 matrix), so
the fit is distributed and the driver sees only that matrix. No neighbour-preserving layout library is assumed: the
layout is that of the first three components, scaled to a unit radius, and its method is named so.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHOD = "pca3"
NEIGHBOURS = 8
#: The most anchors of a snapshot and the grid cells on each axis of its bounds.
ANCHORS, CELLS = 4096, 16


def _stack(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def components(df: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and the k leading components of unit vectors, and the number of vectors; signs are fixed by the largest
    coordinate."""

    def moments(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, None, None
        for f in frames:
            if len(f):
                x = _stack(f["vector"])
                n, s, q = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    parts = df.where("vector IS NOT NULL").select("vector").mapInPandas(moments, "n long, s array<double>, q array<double>")
    add = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"])
    summed = lambda c: parts.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(add("x").alias(c))
    n = parts.agg(F.sum("n")).first()[0] or 0
    if not n:
        return np.zeros(0), np.zeros((0, 0)), 0
    s, q = np.array(summed("s").first()[0]), np.array(summed("q").first()[0])
    dim = len(s)
    mean = s / n
    values, vectors = np.linalg.eigh(q.reshape(dim, dim) / n - np.outer(mean, mean))
    top = vectors[:, np.argsort(-values, kind="stable")[: min(k, dim)]]
    sign = np.sign(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])])
    return mean, top * np.where(sign == 0, 1, sign), int(n)


def _project(df: DataFrame, mean: np.ndarray, top: np.ndarray, schema: str, finish) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield finish(f["id"], (_stack(f["vector"]) - mean) @ top)

    return df.where("vector IS NOT NULL").select("id", "vector").mapInPandas(run, schema)


def reduce_dimensions(df: DataFrame, k: int) -> DataFrame:
    """id, reduced: unit vectors of k dimensions. Two vectors or fewer are cut instead of fitted."""
    kind = df.schema["id"].dataType.simpleString()
    mean, top, n = components(df, k)
    if n <= 2:
        return df.where("vector IS NOT NULL").select("id", F.transform(F.slice("vector", 1, k), lambda x: x.cast("double")).alias("reduced"))

    def finish(ids: pd.Series, y: np.ndarray) -> pd.DataFrame:
        length = np.linalg.norm(y, axis=1, keepdims=True)
        return pd.DataFrame({"id": ids, "reduced": list(y / np.where(length > 0, length, 1.0))})

    return _project(df, mean, top, f"id {kind}, reduced array<double>", finish)


def layout(df: DataFrame) -> DataFrame:
    """id, x, y, z. No vectors, one and two have constant places."""
    kind = df.schema["id"].dataType.simpleString()
    mean, top, n = components(df, 3)
    if n <= 2:
        at = F.row_number().over(Window.orderBy("id"))
        x = F.when(F.lit(n) == 1, F.lit(0.0)).otherwise(F.when(at == 1, -1.0).otherwise(1.0)).cast("float")
        return df.where("vector IS NOT NULL").select("id", x.alias("x"), F.lit(0.0).cast("float").alias("y"), F.lit(0.0).cast("float").alias("z"))

    def finish(ids: pd.Series, y: np.ndarray) -> pd.DataFrame:
        y = np.pad(y, ((0, 0), (0, max(0, 3 - y.shape[1]))))
        return pd.DataFrame({"id": ids, "x": y[:, 0].astype(np.float32), "y": y[:, 1].astype(np.float32), "z": y[:, 2].astype(np.float32)})

    return _project(df, mean, top, f"id {kind}, x float, y float, z float", finish)


def anchored(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """Places for new vectors among placed anchors: the weighted mean of the eight most similar, moved a little in a
    direction fixed by the id. anchors: vector, x, y, z; a fixed table."""
    rows = anchors.orderBy("id").select("vector", "x", "y", "z").collect()
    a = np.array([r[0] for r in rows], np.float64)
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    places = np.array([r[1:] for r in rows], np.float64)
    jitter = max(1e-4, float(np.linalg.norm(np.ptp(places, axis=0))) * 0.0005)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            s = _stack(f["vector"]) @ a.T
            best = np.argsort(-s, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(a))]
            near = np.take_along_axis(s, best, 1)
            w = np.maximum(0.001, near - near.min(axis=1, keepdims=True) + 0.001)
            at = (places[best] * (w / w.sum(axis=1, keepdims=True))[:, :, None]).sum(axis=1)
            for i, key in enumerate(f["id"]):
                h = hashlib.sha256(str(key).encode()).digest()
                turn, up = int.from_bytes(h[:4], "big") / 2**32 * math.tau, int.from_bytes(h[4:8], "big") / 2**31 - 1.0
                flat = math.sqrt(max(0.0, 1.0 - up * up))
                at[i] += np.array([math.cos(turn) * flat, math.sin(turn) * flat, up]) * jitter
            yield pd.DataFrame({"id": f["id"], "x": at[:, 0].astype(np.float32), "y": at[:, 1].astype(np.float32), "z": at[:, 2].astype(np.float32)})

    kind = df.schema["id"].dataType.simpleString()
    return df.where("vector IS NOT NULL").select("id", "vector").mapInPandas(run, f"id {kind}, x float, y float, z float")


def incremental_layout(changed: int, total: int, same_versions: bool) -> bool:
    """Whether a new layout may keep the old one's places: few changes and the same versions."""
    return same_versions and changed <= max(1000, int(total * 0.02))


def anchors(df: DataFrame, key: str, point: str, most: int = ANCHORS) -> DataFrame:
    """The points key, point, x, y, z that stand for the layout of each key: all of up to ``most`` points, else the one
    nearest the centre of each cell of a grid over the key's own bounds, filled up in even steps by ``point``.

    Cells come from doubles and distances from floats, as layouts are stored; ties go to the smaller point."""
    near, all_ = [F.col(point), *[F.col(a) for a in "xyz"]], Window.partitionBy(key)
    p = df.select(key, point, *[F.col(a).cast("float").alias(a) for a in "xyz"]).withColumn("n", F.count("*").over(all_))
    for a in "xyz":
        least, span = F.min(a).over(all_).cast("double"), F.greatest(F.max(a).over(all_).cast("double") - F.min(a).over(all_).cast("double"), F.lit(1e-6))
        p = p.withColumns({f"min_{a}": least, f"span_{a}": span})
    cell = {f"c{a}": F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor((F.col(a) - F.col(f"min_{a}")) / F.col(f"span_{a}") * CELLS))) for a in "xyz"}
    off = {f"off_{a}": F.col(a) - (F.col(f"min_{a}") + (F.col(f"c{a}") + 0.5) / CELLS * F.col(f"span_{a}")).cast("float") for a in "xyz"}
    away = F.col("off_x") * F.col("off_x") + F.col("off_y") * F.col("off_y") + F.col("off_z") * F.col("off_z")
    grid = p.where(F.col("n") > most).withColumns(cell).withColumns(off)
    grid = grid.withColumn("chosen", F.row_number().over(Window.partitionBy(key, *cell).orderBy(away, *near)) == 1)
    room = grid.withColumn("room", F.lit(most) - F.count_if("chosen").over(all_))
    step = F.greatest(F.lit(1), F.floor((F.col("n") - most + F.col("room")) / F.greatest(F.lit(1), F.col("room"))))
    place = F.row_number().over(Window.partitionBy(key, "chosen").orderBy(*near)) - 1
    fill = (F.col("place") % F.col("step") == 0) & (F.col("place") < F.col("step") * F.col("room"))
    kept = room.withColumns({"step": step, "place": place}).where(F.col("chosen") | fill)
    columns = [key, point, *"xyz"]
    return p.where(F.col("n") <= most).select(columns).unionByName(kept.select(columns))


#: Codes of a byte that types may take, and the type that stands for all others beyond them.
CODES, OTHER = 255, "other"


def type_codes(df: DataFrame, column: str) -> DataFrame:
    """event_type, type_code of every type that occurs, in lower case without outer blanks; null and blank read as other.

    Types are coded in their order. More than ``CODES`` of them leave the first 254 a code of their own, and the last
    code stands for ``other`` and the rest. Only the first 256 types are ever ordered together."""
    types = df.select(F.coalesce(F.nullif(F.lower(F.trim(column)), F.lit("")), F.lit(OTHER)).alias("event_type")).distinct()
    first = types.orderBy("event_type").limit(CODES + 1)
    full = first.count() > CODES
    coded = first.withColumn("code", F.row_number().over(Window.orderBy("event_type")) - 1).where(F.col("code") < (CODES - 1 if full else CODES))
    own = types.join(coded, "event_type", "left")
    rest = F.lit(CODES - 1)
    code = F.when(F.col("event_type") == OTHER, rest).otherwise(F.coalesce("code", rest)) if full else F.col("code")
    return own.select("event_type", code.cast("int").alias("type_code"))
