"""The binary scene of a snapshot: one record of 56 bytes a canonical event, and an index of point numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import Stages

# Fixed value: the record's layout, little endian.
RECORD = np.dtype([("point", "<u4"), ("id", "V16"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("start", "<i4"), ("end", "<i4"), ("type", "u1"), ("precision", "u1"), ("flags", "u1"), ("spare", "u1"), ("members", "<u4"), ("macro", "<u4"), ("local", "<u4")])
NO_TOPIC = 0xFFFFFFFF


def encode(df: DataFrame) -> DataFrame:
    """point, canonical_id, x, y, z, start_day, end_day, type_code, precision_code, uncertain, disagrees, members,
    macro, local -> point, record. Null topics are NO_TOPIC; null numbers are zero."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            r = np.zeros(len(f), RECORD)
            r["point"], r["id"] = f["point"], np.array([np.void(bytes.fromhex(i.replace("-", ""))) for i in f["canonical_id"]], "V16")
            for to, c in (("x", "x"), ("y", "y"), ("z", "z"), ("start", "start_day"), ("end", "end_day"), ("type", "type_code"), ("precision", "precision_code"), ("members", "members")):
                r[to] = f[c].fillna(0)
            r["flags"] = f["uncertain"].fillna(False).astype(int) | 2 * f["disagrees"].fillna(False).astype(int)
            for c in ("macro", "local"):
                r[c] = f[c].fillna(NO_TOPIC).astype(np.int64)
            raw = r.tobytes()
            yield pd.DataFrame({"point": f["point"], "record": [raw[i : i + RECORD.itemsize] for i in range(0, len(raw), RECORD.itemsize)]})

    return df.mapInPandas(run, "point int, record binary")


def stream(encoded: DataFrame, rows: int = 2048) -> Iterator[bytes]:
    """The scene in chunks of records by point number, partition by partition; numbers must run from 0 without a gap."""
    chunk, expected = bytearray(), 0
    for r in encoded.orderBy("point").toLocalIterator(prefetchPartitions=True):
        if r["point"] != expected:
            raise ValueError(f"point {r['point']} follows {expected - 1}")
        chunk += r["record"]
        expected += 1
        if expected % rows == 0:
            yield bytes(chunk)
            chunk.clear()
    if chunk:
        yield bytes(chunk)


def chunks(encoded: DataFrame, rows: int = 2048) -> DataFrame:
    """The scene as chunks that executors make: chunk, first_point, n, data. A chunk holds ``rows`` records."""
    order = F.array_sort(F.collect_list(F.struct("point", "record")))
    made = encoded.groupBy(F.floor(F.col("point") / rows).alias("chunk")).agg(F.min("point").alias("first_point"), F.count("*").alias("n"), order.alias("r"))
    return made.select("chunk", "first_point", "n", F.aggregate("r", F.lit(b""), lambda a, x: F.concat(a, x["record"])).alias("data"))


def decode(raw: bytes, count: int) -> np.ndarray:
    """The records of a scene, whose length and numbering must fit."""
    if len(raw) != count * RECORD.itemsize:
        raise ValueError(f"{len(raw)} bytes are not {count} records")
    r = np.frombuffer(raw, RECORD)
    if not (r["point"] == np.arange(count)).all():
        raise ValueError("point numbers have a gap")
    return r


def index_bytes(points: list[int]) -> bytes:
    return np.sort(np.asarray(points, "<u4")).tobytes()


def numbered(df: DataFrame, order: list[str], out: str = "point", kind: str = "int") -> DataFrame:
    """Numbers from 0 in a stated order without sorting in one task: ranges are sorted apart, and each starts where
    the ranges before it end."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once: the ranges are counted and numbered from the same rows.
    placed = Stages(df.sparkSession, "numbered").write(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row a partition.
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(out, (F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast(kind)).drop("_at", "_part", "_n", "_start")
