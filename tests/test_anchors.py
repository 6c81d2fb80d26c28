"""Anchors of a snapshot's layout: all of a small one, else a grid over its own bounds and a fill."""

import duckdb
import numpy as np

from tidemark.operators.groups import geometry
from tidemark.operators.projection import anchors
from tidemark.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def expected(ids, x, most=4096, cells=16):
    if len(x) <= most:
        return set(ids)
    low, span = [float(v) for v in x.min(axis=0)], [max(float(v), 1e-6) for v in x.max(axis=0).astype(float) - x.min(axis=0).astype(float)]
    members = {}
    for i, p in enumerate(x):
        cell = tuple(min(cells - 1, max(0, int((float(v) - m) / w * cells))) for v, m, w in zip(p, low, span))
        members.setdefault(cell, []).append(i)
    chosen = []
    for cell, at in members.items():
        centre = np.array([m + (c + 0.5) / cells * w for c, m, w in zip(cell, low, span)], np.float32)
        chosen.append(min(at, key=lambda i: (float(np.sum(np.square(x[i] - centre))), ids[i])))
    rest = sorted(set(range(len(x))) - set(chosen), key=lambda i: ids[i])
    room = most - len(chosen)
    chosen += rest[:: max(1, len(rest) // max(1, room))][:room]
    return {ids[i] for i in chosen}


def test_anchors(spark):
    rng = np.random.default_rng(4)
    layouts = {"small": rng.normal(size=(4096, 3)), "wide": 40 * rng.random((9000, 3)), "dense": 0.01 * rng.normal(size=(12_500, 3)), "flat": np.column_stack([rng.normal(size=(4097, 2)), np.ones(4097)])}
    layouts["dense"][0] = 3.0
    rows, want = [], set()
    for key, x in layouts.items():
        x = x.astype(np.float32)
        ids = [f"{v:016x}" for v in rng.permutation(len(x)) * 7919]
        rows += [(key, i, *map(float, p)) for i, p in zip(ids, x)]
        want |= {(key, i) for i in expected(ids, x)}
    got = anchors(spark.createDataFrame(rows, "k string, id string, x float, y float, z float"), "k", "id").select("k", "id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert all(sum(k == key for k, _ in want) == 4096 for key in layouts)


def test_small_snapshots_keep_every_point(spark):
    got = catalog.queries()["sl10_spatial_grid"](spark, FOLDER).collect()
    placed = duckdb.sql(f"SELECT snapshot_id, canonical_id FROM (SELECT DISTINCT snapshot_id, canonical_id, x, y, z FROM '{FOLDER}/event_map_canonical.parquet' WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)").fetchall()
    assert sorted(tuple(r) for r in got) == sorted(placed)


def test_topic_anchor(spark):
    df = spark.createDataFrame([("a", "q", 0.0, 0.0, 0.0), ("a", "c", 1.0, 0.0, 0.0), ("a", "b", 3.0, 0.0, 0.0), ("a", "d", 2.0, 0.0, 4.0), ("t", "z", 0.0, 0.0, 1.0), ("t", "y", 0.0, 0.0, 3.0)], "k string, id string, x double, y double, z double")
    assert {(r["k"], r["anchor"]) for r in geometry(df, ["k"], "id").collect()} == {("a", "c"), ("t", "y")}
