import math

import numpy as np
import pytest

from xylem.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """{row number: (links, component)} by all cosines."""

    def good(v):
        return v and None not in v and all(map(math.isfinite, v)) and any(v)

    n = len(rows)
    up, links = list(range(n)), [0] * n
    linked = []
    for i, (a, v, lab) in enumerate(rows):
        for j, (b, w, other) in enumerate(rows[:i]):
            if a is None or b is None or lab is None or lab != other or not good(v) or not good(w) or len(v) != len(w):
                continue
            x, y = np.float32(v).astype(float), np.float32(w).astype(float)
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98:
                links[i] += 1
                links[j] += 1
                linked.append((i, j))
    root = {i: rows[i][0] for i in up}
    for _ in range(n):
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    return [(rows[i][0], links[i], root[i]) for i in range(n)]


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()), key=str)


@pytest.mark.parametrize(("block", "small"), [(16, 48), (1024, 48), (1024, 4), (16, 4)])
def test_links_match_brute_force(spark, monkeypatch, block, small):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "SMALL", small)
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for _ in range(15):
        base = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 30))):
            v = base + rng.standard_normal(64) * rng.choice([0, 0.05, 0.1, 0.14, 0.2])
            rows.append((n := n + 1, (v * rng.choice([1, 5, 1e-3])).tolist(), int(rng.integers(0, 2))))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    unit = [1.0] + [0.0] * 7
    rows = [(1, None, 1), (2, [], 1), (3, [0.0] * 8, 1), (4, [None] + unit[1:], 1), (5, [float("nan")] + unit[1:], 1), (6, [float("inf")] + unit[1:], 1), (7, unit, None), (8, unit, 1), (9, unit, 1), (10, unit, 2), (None, unit, 1), (11, unit[:7], 1), (12, [-1.0] + unit[1:], 1), (13, [3e38] + unit[1:], 1), (14, [1e-45] + unit[1:], 1)]
    want = {8: (3, 8), 9: (3, 8), 13: (3, 8), 14: (3, 8)}
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", id long, raw string, copies long")
    out = vectors.near_vectors(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_links, r.component_id) == want.get(r.vec_id, (0, r.vec_id)) and r.kept == (r.vec_id == r.component_id or r.vec_id is None)
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_and_small_vectors_and_borderline_pairs():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((30, 8))
    for factor in (1e155, 1e-170, 1e300, 3e-308):
        assert vectors.linked(vectors.scaled(x * factor), vectors.scaled(x)).diagonal().all()
    base = np.zeros((1, 8))
    base[0, 0] = 1
    near = np.array([[0.98, math.sqrt(1 - 0.98**2) + k * 1e-16, *[0.0] * 6] for k in range(-40, 41)])
    one = vectors.pair_cosines(np.repeat(base, len(near), axis=0), near) >= vectors.LEAST_COSINE
    assert 0 < one.sum() < len(near) and (vectors.linked(base, near)[0] == one).all() and (vectors.linked(near, base)[:, 0] == one).all()
