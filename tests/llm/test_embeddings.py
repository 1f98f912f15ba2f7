from __future__ import annotations

import math

import numpy as np
import pytest

from attestra.llm import embeddings
from tests.llm.test_simhash import brute_components


def brute(rows, threshold=0.98):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float64) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    pairs = [
        (i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))
        if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
        and unit[i] @ unit[j] >= threshold
    ]
    root = brute_components(pairs, range(len(rows)))
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((vec_id, sum(i in p for p in pairs), component, vec_id == component))
    return sorted(out, key=repr)


def vectors(n=400, dim=16, kind=np.float32):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        if i % 4 and rows:
            base = np.array(rows[rng.integers(max(0, i - 3), i)][1], np.float64)
            x = base + rng.normal(0, rng.choice([0.02, 0.05]), dim)
        else:
            x = rng.normal(size=dim)
        rows.append((i, x.astype(kind).tolist(), i // 40 % 3))
    hot = rng.normal(size=dim)
    rows += [(1000 + i, (hot + rng.normal(0, 0.03, dim)).astype(kind).tolist(), 1) for i in range(150)]
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(30)] + [rows[5], rows[5]]
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [math.nan] * dim, [math.inf] * dim, [1.0] * (dim - 1), [1.0] * (dim - 1), [2.0] * dim, [3.0] * dim]
    rows += [(3000 + i, v, 1) for i, v in enumerate(odd)] + [(4000, rows[5][1], None), (None, rows[5][1], rows[5][2]), (None, [1.0, 2.0], 9)]
    return rows


@pytest.mark.parametrize("kind, block", [("float", 512), ("float", 16), ("double", 64)])
def test_links_equal_brute_force(spark, monkeypatch, kind, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = vectors(kind=np.float32 if kind == "float" else np.float64)
    frame = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, node string")
    got = sorted(map(tuple, embeddings.near_duplicates(frame).collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(frame).collect() == []
    none = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in embeddings.near_duplicates(none).collect()] == [(1, 0, 1, True)]
