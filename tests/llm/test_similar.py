import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import queries as Q
from tidemark.llm import similar as S
from tidemark.llm.hnsw import Graph

DIM = 16
SCHEMA = "vector_index int, vector array<float>, note string"


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, DIM))
    for i in range(0, n - 3, 4):
        x[i + 1 : i + 4] = x[i] + 0.15 * rng.normal(size=(3, DIM))
    return x.astype(np.float32)


def exact_pairs(x, ids, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((u @ u.T).astype(np.float64), 6)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in sorted(range(len(x)), key=lambda j: (-s[i, j], ids[j]))[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def test_graph_recall():
    x = clustered(3000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    at, s = Graph(u, np.arange(3000)).search(u, 6, 24)
    truth = np.argsort(-(u @ u.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(t)) / 6 for a, t in zip(at, truth)]) >= 0.9
    assert (np.diff(s, axis=1) <= 1e-6).all()


def test_small_graphs():
    for n in (1, 2, 5):
        u = clustered(n)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        at, _ = Graph(u, np.arange(n)).search(u, 6, 8)
        assert {tuple(sorted(a[a >= 0])) for a in at} == {tuple(range(n))}


def test_pairs_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD", 300)
    monkeypatch.setattr(S, "LARGEST", 200)
    x = clustered(2000)
    df = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], SCHEMA)
    anchors = spark.createDataFrame([(r, x[r * 7].tolist()) for r in range(20)], "anchor_rank int, vector array<float>")
    got = S.record_and_anchor_pairs(spark, df, anchors, "vector_index", DIM, 5, 0.9, 0.7).collect()
    mine = {(r["left_key"], r["right_key"]) for r in got if r["pair_kind"] == "record"}
    want = exact_pairs(x, list(range(2000)), 5, 0.9)
    assert len(mine & want) >= 0.98 * len(want) and len(mine - want) <= 0.01 * len(want)
    u, a = x / np.linalg.norm(x, axis=1, keepdims=True), x[::7][:20] / np.linalg.norm(x[::7][:20], axis=1, keepdims=True)
    s = u @ a.T
    assert {(r["left_key"], r["right_key"]) for r in got if r["pair_kind"] == "anchor"} == {(i, int(s[i].argmax())) for i in range(2000) if s[i].max() >= 0.7}


def test_copies_ties_and_unusable_vectors(spark):
    x = clustered(40, 3)
    rows = [(i, v.tolist(), "n") for i, v in enumerate(x)]
    rows += [(100 + i, x[0].tolist(), None) for i in range(9)] + [(0, x[0].tolist(), "again")]
    bad = [None, [], [1.0], [0.0] * DIM, [float("nan")] + [1.0] * (DIM - 1), [float("inf")] + [1.0] * (DIM - 1), [None] + [1.0] * (DIM - 1)]
    rows += [(200 + i, v, None) for i, v in enumerate(bad)] + [(None, x[1].tolist(), None)]
    df = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([(1, None), (None, x[0].tolist()), (2, [0.0] * DIM), (3, [1.0])], "anchor_rank int, vector array<float>")
    got = {(r["left_key"], r["right_key"]) for r in S.record_and_anchor_pairs(spark, df, none, "vector_index", DIM, 5, 0.9, 0.7).collect()}
    ids = [*range(40), *range(100, 109)]
    assert got == exact_pairs(np.concatenate([x, np.repeat(x[:1], 9, axis=0)]), ids, 5, 0.9)


def test_empty(spark):
    none = spark.createDataFrame([], "anchor_rank int, vector array<float>")
    assert S.record_and_anchor_pairs(spark, spark.createDataFrame([], SCHEMA), none, "vector_index", DIM, 5, 0.9, 0.7).count() == 0


def test_stated_queries(spark):
    x = clustered(600, 5)
    df = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], SCHEMA)
    got = S.ranked_similar(spark, df, "vector_index", DIM, 5, 20, 16).groupBy("id").agg(F.collect_set("other").alias("o")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert len(got) == 30 and np.mean([len(set(r["o"]) & set(np.argsort(-s[r["id"]])[:5])) / 5 for r in got]) >= 0.9


def test_stated_queries_over_many_shards(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(S, "SHARD", 20)
    monkeypatch.setattr(S, "SLICE", 30, raising=False)
    x = np.random.default_rng(8).normal(size=(2000, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vector_index int, vector array<float>").write.parquet(f"{tmp_path}/event_record.parquet")
    got = Q.p5_similar(spark, str(tmp_path)).groupBy("id").agg(F.collect_list("other").alias("o")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert len(got) == 100 and all(len(r["o"]) == 5 for r in got)
    assert np.mean([len(set(r["o"]) & set(np.argsort(-s[r["id"]])[:5])) / 5 for r in got]) >= 0.98


def test_centroids_in_two_levels(spark, monkeypatch):
    """More shards than are fitted together: pairs are found as with one level, and every query has as many copies."""
    monkeypatch.setattr(S, "SHARD", 25)
    monkeypatch.setattr(S, "FIT", 8)
    monkeypatch.setattr(S, "SAMPLE", 400)
    x = clustered(1500, 4)
    df = spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], SCHEMA)
    used = S.usable(df, "vector_index", "vector", DIM, np.zeros((0, DIM), np.float32), np.zeros(0, np.int32), 2.0).persist()
    c, share = S.centroids(used, 1500, DIM)
    assert 30 <= len(c) <= 90 and abs(share.sum() - 1) < 1e-9 and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5)
    got = {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in S.most_similar(spark, used.select("id", "vec"), DIM, 5, 0.9).collect()}
    want = exact_pairs(x, list(range(1500)), 5, 0.9)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)
