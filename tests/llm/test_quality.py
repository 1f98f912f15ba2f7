from __future__ import annotations

import zlib

import numpy as np
import pytest

from attestra.llm import quality


def corpus(n):
    rng = np.random.default_rng(5)
    words = ["river", "stone", "garden", "morning", "letter", "under", "walked", "slowly", "the", "a", "of", "and"]
    rows, labels = [], []
    for i in range(n):
        picked = rng.choice(words, rng.integers(20, 80)).tolist()
        good = i % 4 != 0
        text = " ".join(picked) + "." if good else " ".join(f"{w}$$$" for w in picked)
        rows.append((i, text, "en"))
        labels.append((i, int(good)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus(600)
    odd = [(1000, None, "x"), (1001, "", "x"), (None, "the river", "x"), (5, "twice", "x"), (1002, "word " * 50000, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + [(7, 0), (None, 1), (9, None), (99999, 1)], "doc_id long, quality int")
    return docs, marks, dict(labels)


def test_held_out_accuracy(tables):
    docs, marks, truth = tables
    got = quality.score(docs, marks).collect()
    assert len(got) == 605
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    unseen = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(unseen) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.97
    assert sorted(r.score for r in quality.score(docs, marks).collect()) == sorted(r.score for r in got)


def test_held_out_labels_are_not_read(tables, spark):
    docs, marks, _ = tables
    changed = marks.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    key = lambda r: (r.doc_id is None, r.doc_id, r.score)
    assert sorted(quality.score(docs, marks).collect(), key=key) == sorted(quality.score(docs, changed).collect(), key=key)


def test_keep_good_keeps_columns_and_rows(tables):
    docs, marks, truth = tables
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert np.mean([truth[i] for i in ids if i in truth]) > 0.97


def test_without_labels_or_text(tables):
    docs, marks, _ = tables
    assert {r.score for r in quality.score(docs, marks.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), marks).collect() == []


def test_risk_and_its_slope():
    rng = np.random.default_rng(1)
    p, u = rng.normal(size=8), rng.normal(size=12)
    risk, slope_p, slope_u = quality.pu_risk(p, u, 0.3)
    step = 1e-6
    for i in range(8):
        moved = p.copy()
        moved[i] += step
        assert abs((quality.pu_risk(moved, u, 0.3)[0] - risk) / step - slope_p[i]) < 1e-4
    for i in range(12):
        moved = u.copy()
        moved[i] += step
        assert abs((quality.pu_risk(p, moved, 0.3)[0] - risk) / step - slope_u[i]) < 1e-4
    far = quality.pu_risk(np.full(4, 9.0), np.full(4, -9.0), 0.9)
    assert far[0] >= 0 and np.all(far[1] > 0) and np.all(far[2] < 0)
