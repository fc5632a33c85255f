"""Hard negatives against all scores, and the pivot table's brackets against the scores they enclose."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewheel.llm import hard_negatives as hn
from tidewheel.llm.hard_negatives import Queries, Space, mine

SCHEMA = "vec_id long, label int, embedding array<float>, v int, near string, block int"


def by_hand(rows: list[tuple], anchor) -> list[tuple]:
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(c is not None and math.isfinite(c) for c in r[2])]
    v = [[math.floor(256 * float(np.float32(c))) for c in r[2]] for r in ok]
    out = []
    for i, (a, label, _) in enumerate(ok):
        if not anchor(a):
            continue
        scores = [(-sum(x * y for x, y in zip(v[i], w, strict=False)), ok[j][0], ok[j][1] == label) for j, w in enumerate(v) if j != i]
        positives = sorted((s, d) for s, d, same in scores if same)[:5]
        for p, d in positives:
            found = sorted((s, n) for s, n, same in scores if not same and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(a, d, r + 1, n, -p, -s) for r, (s, n) in enumerate(found)]
    return sorted(out)


def held(spark, rows: list[tuple], anchor, condition) -> int:
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    found = sorted(tuple(r) for r in mine(df, condition).collect())
    assert found == by_hand(rows, anchor)
    return len(found)


def clustered(rng, n: int, size: int, labels: int, spread: float) -> list[tuple]:
    centres = rng.normal(size=(6, size))
    x = centres[rng.integers(6, size=n)] + spread * rng.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.where(rng.random(n) < 0.35, 3, rng.integers(labels, size=n))
    return [(i, int(c), [float(y) for y in np.float32(row)]) for i, (c, row) in enumerate(zip(label, x, strict=True))]


@pytest.mark.parametrize("seed,spread", [(1, 0.05), (2, 2.0)])
def test_mining_equals_all_scores(spark, monkeypatch, seed, spread):
    if seed == 1:  # many small blocks, chunks and packs, none of them broadcast
        for name, n in {"BLOCK_BYTES": 2048, "CHUNK_ROWS": 7, "CHUNK_QUERIES": 5, "BROADCAST_BYTES": 0, "HELD": 3, "SAMPLE_NUMBERS": 400}.items():
            monkeypatch.setattr(hn, name, n)
    rows = clustered(np.random.default_rng(seed), 300, 8, 4, spread)
    rows += [(10, 1, rows[10][2]), (900, 2, rows[10][2]), (900, 3, rows[10][2])]  # repeated ids, vectors in a tie
    assert held(spark, rows, lambda a: a % 20 == 0, F.col("vec_id") % 20 == 0) > 100


def test_mining_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0]), (2, 2, [0.9, 0.5, 7.0]), (3, 2, []), (None, 1, [1.0, 1.0]), (4, None, [1.0, 1.0]), (5, 1, None), (6, 2, [nan, 1.0]),
        (7, 2, [inf, 1.0]), (8, 2, [None, 1.0]), (9, 1, [-1.0, -1.0]), (11, 2, [0.0, 0.0]), (12, 1, [0.0, 0.0]), (13, -5, [0.95, 0.4]), (0, 1, [1.0, 0.5]), (100, 7, [1.0, 1.0]),
    ]
    assert held(spark, rows, lambda a: a % 2 == 0, F.col("vec_id") % 2 == 0) > 3
    empty = spark.createDataFrame([], SCHEMA)
    assert mine(empty, F.lit(True)).count() == 0
    assert mine(spark.createDataFrame([(1, 1, None, 1, "", 1)], SCHEMA), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        mine(spark.createDataFrame([(1, 1, [3e7], 1, "", 1)], SCHEMA), F.lit(True))


@pytest.mark.parametrize("scale", [1, 1 << 15])
def test_brackets_enclose_scores_and_prune(scale):
    rng = np.random.default_rng(5)
    x = np.floor(256 * scale * np.array([r[2] for r in clustered(rng, 400, 16, 4, 0.03)]))
    space = Space(16, float((x**2).sum(axis=1).max()), x)
    q = Queries(space, np.arange(40), np.zeros(40, np.int64), x[:40].astype(space.exact), np.zeros((40, 1), np.int64), np.zeros((40, 1), np.int64))
    d = space.distances(space.lifted(x))
    lower, upper = q.brackets(d, d)
    score = x[:40] @ x.T
    assert (lower <= score).all() and (score <= upper).all()
    fifth = np.sort(score, axis=1)[:, -5:-4]
    assert (upper >= fifth).mean() < 0.5  # clusters: most rows are never scored
    block = q.brackets(d.min(axis=0)[None], d.max(axis=0)[None])
    assert (block[0] <= score.min(axis=1, keepdims=True)).all() and (block[1] >= score.max(axis=1, keepdims=True)).all()


def test_beyond_doubles_scores_stay_exact(spark):
    rows = [(i, i % 3, [1e6 + i, 1e6 - 3.0 * i, 4e6]) for i in range(40)]
    assert held(spark, rows, lambda a: a % 5 == 0, F.col("vec_id") % 5 == 0) > 20
