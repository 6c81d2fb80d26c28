import numpy as np
import pytest

from tidemark.operators import neighbours as N

SCHEMA = "domain string, id string, vector array<float>, note string"


def exact(rows, k):
    out = {}
    for d in {r[0] for r in rows}:
        mine = {r[1]: np.array(r[2], np.float32).astype(float) for r in rows if r[0] == d}
        ids = sorted(mine)
        u = np.array([mine[i] / np.linalg.norm(mine[i]) for i in ids])
        s = np.round(u @ u.T, 9)
        np.fill_diagonal(s, -2)
        for i, row in enumerate(s):
            out[d, ids[i]] = [(ids[j], row[j]) for j in sorted(range(len(ids)), key=lambda j: (-row[j], ids[j])) if j != i][:k]
    return out


def made(seed, domains, dim=8):
    rng, rows = np.random.default_rng(seed), []
    for d, n in domains.items():
        x = rng.normal(size=(n, dim))
        x[1::3] = x[: len(x[1::3]) * 3 : 3][: len(x[1::3])] + 0.1 * rng.normal(size=(len(x[1::3]), dim))
        rows += [(d, f"{d}{i:05d}", v.tolist(), None) for i, v in enumerate(x)]
    return rows


def test_small_domains_are_exact(spark):
    rows = made(0, {"a": 60, "b": 5, "c": 1})
    bad = [("a", "null", None, "x"), ("a", "zero", [0.0] * 8, None), ("a", "short", [1.0], None), ("a", "nan", [float("nan")] * 8, None), (None, "none", [1.0] * 8, None), ("a", None, [1.0] * 8, None), rows[0]]
    got = {}
    for r in N.neighbours(spark.createDataFrame(rows + bad, SCHEMA), 7, 8).orderBy("place").collect():
        got.setdefault((r["domain"], r["id"]), []).append(r["other"])
    assert got == {k: [o for o, _ in v] for k, v in exact(rows, 7).items() if v}
    assert N.neighbours(spark.createDataFrame([], SCHEMA), 7, 8).count() == 0


@pytest.mark.parametrize("largest", [8192, 30])
def test_cells_keep_what_is_similar(spark, monkeypatch, largest):
    monkeypatch.setattr(N, "CELL", 100)
    monkeypatch.setattr(N, "LARGEST", largest)
    rows = made(2, {"big": 900, "small": 40}) + [("big", f"copy{i:03d}", [1.0] * 8, None) for i in range(80)]
    want = {(k, o) for k, v in exact(rows, 5).items() for o, s in v if s >= 0.9 and not (k[1].startswith("copy") or o.startswith("copy"))}
    got = N.neighbours(spark.createDataFrame(rows, SCHEMA), 5, 8).collect()
    have = {((r["domain"], r["id"]), r["other"]) for r in got}
    assert len(want & have) >= 0.95 * len(want)
    per = {}
    for r in got:
        per[r["domain"], r["id"]] = per.get((r["domain"], r["id"]), 0) + 1
    assert len(per) == 1020 and set(per.values()) == {5}
