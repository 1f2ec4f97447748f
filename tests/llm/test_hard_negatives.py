"""Hard negatives against scoring everything, spanning-tree bounds, odd rows."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulae.llm import hard_negatives as hn


def brute(rows, k=5):
    valid = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
             if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    def first(a, same):
        out = []
        for j, (i, lab, q) in enumerate(valid):
            if j != a and (lab == valid[a][1]) == same:
                s = sum(x * y for x, y in zip(valid[a][2], q))
                out.append((max(-2**53, min(2**53, s)), i))
        return sorted(out, key=lambda t: (-t[0], t[1] is None, t[1] or 0))

    out = []
    for a, (i, _, _) in enumerate(valid):
        if i is not None and i % 3 == 0:
            others = first(a, False)
            for ps, p in first(a, True)[:k]:
                inside = [(s, n) for s, n in others if 80 * ps <= 100 * s <= 100 * ps]
                out += [(i, p, r + 1, n, ps, s) for r, (s, n) in enumerate(inside[:k])]
    return sorted(out, key=str)


def mined(df):
    got = hn.mine_hard_negatives(df, F.col("vec_id") % 3 == 0)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("small", [True, False])
def test_matches_scoring_everything(spark, monkeypatch, small):
    if small:  # many blocks, chunks and cells
        for name, size in (("BLOCK", 3), ("CHUNK", 5), ("BLOCKS", 1), ("CHUNKS", 2)):
            monkeypatch.setattr(hn, name, size)
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    def near():
        return [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]

    rows = [(i, rng.choice([0, 0, 0, 1, 2]), near()) for i in range(70)]
    hot = near()
    rows += [(100 + i, rng.choice([0, 1]), hot) for i in range(30)]  # ties
    rows += [rows[0], rows[3], rows[3], (3, 1, rows[3][2]), (None, 0, hot), (None, 1, hot), (None, None, hot), (6, None, near()),
             (9, 1, None), (12, 1, [1.0, None]), (15, 2, [float("nan")] * 6), (18, 2, [float("inf")] * 6), (21, 1, [0.0] * 6), (24, 1, []),
             (27, 0, [1.0, 2.0]), (30, 5, near()), (33, 1, [1e9] * 6), (36, 0, [2e9] * 6), (39, 0, [1e300] * 6), (42, 1, [-1e18] * 6)]
    df = spark.createDataFrame([(i, lab, v, "x", 1, 2) for i, lab, v in rows],
                               "vec_id long, label int, embedding array<double>, id string, v int, pack int").repartition(5)
    assert mined(df) == brute(rows)
    assert mined(df.limit(0)) == []


def test_bounds_spare_scores_and_lose_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-60, 60, (12, 16)).astype(float)
    def rows(n, spread):
        x = np.floor(centres[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, 16)))
        norms = np.linalg.norm(x, axis=1) * (1 + 1e-9)
        return hn.Rows([{"ids": list(range(n)), "sizes": [16] * n, "vectors": x.tobytes(), "norms": norms.tobytes(), "label": 1}])

    anchors, all_rows = rows(60, 1.5), rows(3000, 1.5)
    exact = anchors.x @ all_rows.x.T
    top = np.sort(exact, axis=1)[:, -40:]
    windows = np.stack([np.stack([np.full(60, -np.inf), np.full(60, np.inf)], 1), np.stack([np.ceil(0.8 * top[:, 0]), top[:, 0]], 1),
                        np.full((60, 2), np.nan)], axis=1)
    found, scored = hn.search(anchors, all_rows, windows, 5)
    for a in range(60):
        for w in range(2):
            low, high = windows[a, w]
            want = sorted((-s, i) for i, s in enumerate(exact[a]) if low <= s <= high)[:5]
            assert [(-s, i) for i, s in zip(*found[a][w])] == want
        assert len(found[a][2][0]) == 0
    assert scored < 0.5 * exact.size


def test_spanning_tree_and_walk():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 30, (80, 3)).astype(float)
    parent, gap = hn.spanning_tree(x)
    assert parent[0] == -1 and np.allclose(gap[1:], np.linalg.norm(x[1:] - x[parent[1:]], axis=1))
    edges = sorted((np.linalg.norm(x[i] - x[j]), i, j) for i in range(80) for j in range(i))
    root, total = list(range(80)), 0.0
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for d, i, j in edges:
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert math.isclose(gap[1:].sum(), total)
    seen, open_rows, most = set(), set(), 0
    for k, last, goes_on in hn._walk(parent):
        assert k == 0 or parent[k] in open_rows
        if last:
            open_rows.discard(int(parent[k]))
        seen.add(k)
        if goes_on:
            open_rows.add(k)
        most = max(most, len(open_rows))
    assert len(seen) == 80 and not open_rows and most <= 8
