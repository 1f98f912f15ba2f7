from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from attestra.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        have = words(text)
        hit, found = set(), set()
        for item_id, item in items:
            need = words(item)
            n = min(13, len(need))
            windows = {tuple(need[i : i + n]) for i in range(len(need) - n + 1)} if n else set()
            for at in range(len(have) - n + 1):
                if n and tuple(have[at : at + n]) in windows:
                    hit.update(range(at, at + n))
                    found.add("null" if item_id is None else str(item_id))
        out.append((doc_id, len(have), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(have)))
    return sorted(out, key=repr)


def tables(seed=0):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "É", "日本", "x1", *[f"w{i}" for i in range(25)]]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([14, 20, 40])))) for i in range(12)]
    items += [(100, "short item here"), (101, "the"), (102, ""), (103, None), (104, "one " * 30), (None, " ".join(say(15))), (0, " ".join(say(13))), (0, items[1][1])]
    docs = []
    for i in range(60):
        text = say(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            item = words(rng.choice(items[:12])[1])
            a = rng.randrange(len(item))
            at = rng.randrange(len(text) + 1)
            text[at:at] = item[a : a + rng.choice([12, 13, 20])]
        docs.append((i, " ".join(w.upper() if rng.random() < 0.2 else w + rng.choice(["", ",", ".\n", "-"]) for w in text)))
    docs += [(None, None), (200, ""), (200, "Short ITEM, here!"), (200, "Short ITEM, here!"), (201, "one " * 5000 + "end"), (202, "w1 " * 30000 + items[0][1])]
    return docs, items


@pytest.mark.parametrize("segment, block", [(1 << 20, 1 << 20), (300, 1 << 20), (2000, 60)])
def test_matches_equal_brute_force(spark, monkeypatch, segment, block):
    monkeypatch.setattr(dc, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    docs, items = tables()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, segment string")
    benchmark = spark.createDataFrame([(*b, 1) for b in items], "item_id long, text string, near int")
    index = dc.build_index(frame)
    got = dc.contamination(index, dc.search(index, benchmark)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=repr) == brute(docs, items)


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    near = item.replace("eta theta", "eta inserted theta")
    docs = spark.createDataFrame([(1, item), (2, "x " + near), (3, item.replace("theta", "y z u v w q r s t")), (4, " ".join(reversed(item.split())))], "doc_id long, text string")
    index = dc.build_index(docs)
    hits = dc.search(index, spark.createDataFrame([(7, item)], "item_id long, text string"))
    got = {r.doc_id: (r.n_hit, r.near_items) for r in dc.contamination(index, hits).collect()}
    assert got == {1: (14, 0), 2: (0, 1), 3: (0, 0), 4: (0, 0)}


def test_decontaminate_keeps_rows_and_columns(spark, tmp_path):
    docs, items = tables(3)
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, _row string, n_words int").write.parquet(str(tmp_path / "d"))
    frame = spark.read.parquet(str(tmp_path / "d"))
    kept = dc.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame.columns
    expected = sorted((d for d in docs if not brute([d], items)[0][-1]), key=repr)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == expected


def test_empty_tables(spark):
    docs, items = tables()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    index = dc.build_index(frame)
    assert {r.n_hit for r in dc.contamination(index, dc.search(index, benchmark.limit(0))).collect()} == {0}
    nothing = dc.build_index(frame.limit(0))
    assert dc.contamination(nothing, dc.search(nothing, benchmark)).collect() == []


def brute_near(docs, items):
    """Documents and the number of items near in each, by plain loops."""
    have = [(doc_id, words(text)) for doc_id, text in docs]
    total = Counter(w for _, text in have for w in text)
    exact = {r[0]: r[3] for r in brute(docs, items)}
    out = {}
    for doc_id, text in have:
        near = set()
        for item_id, item in items:
            need = words(item)
            n = min(dc.WINDOW, len(need))
            for s in range(len(need) - n + 1 if n else 0):
                window = need[s : s + n]
                rarest = sorted((i for i in range(n) if total[window[i]]), key=lambda i: total[window[i]])[: dc.NEAR_TERMS]
                if len(rarest) == min(n, dc.NEAR_TERMS) and any(
                    all(window[i] in text[max(0, at - rarest[0] + i - dc.SLACK) : max(0, at - rarest[0] + i + dc.SLACK + 1)] for i in rarest)
                    for at in range(len(text)) if text[at] == window[rarest[0]]
                ):
                    near.add(str(item_id))
        out[doc_id] = len(near - set(exact[doc_id]))
    return out


@pytest.mark.parametrize("segment", [1, 300, 2000, 1 << 20])
def test_near_matches_do_not_depend_on_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(dc, "SEGMENT_BYTES", segment)
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(rng.choice([3, 6, 9, 14, 20])))) for i in range(30)]
    docs = []
    for i in range(60):
        text = words(rng.choice(items)[1])
        text[rng.randrange(len(text))] = f"changed{i}"
        docs.append((i, " ".join([*[f"w{rng.randrange(260)}" for _ in range(rng.randrange(8))], *text])))
    index = dc.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    hits = dc.search(index, spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: r.near_items for r in dc.contamination(index, hits).collect()}
    assert got == brute_near(docs, items)
    assert sum(got.values()) > 10
