from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from attestra.llm import simhash
from attestra.llm.components import components


def brute_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs_of, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs_of:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


TEXTS = [
    None, "", " \t\n", "One", "one two", "ONE two three", "one two three four", "a\x0bb\x0cc\rd", "É é É é",
    "one two three four", "x" * 5000, "no break no break a b", " ".join(f"w{i % 7}" for i in range(40000)),
]


def test_fingerprints_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: signed(brute_fingerprint(t)) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("long_list", [0, 3, 64])
def test_links_join_all_close_values(spark, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    rng = random.Random(7)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(30):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(rng.choice([1, 3, 20])):
            values.add(base ^ sum({1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3]))}))
    values = sorted(values)
    expected = brute_components(
        [(signed(a), signed(b)) for i, a in enumerate(values) for b in values[i + 1 :] if bin(a ^ b).count("1") <= 2],
        [signed(v) for v in values],
    )
    frame = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    got = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    assert all(expected[n] == r for n, r in got.items())
    assert all(expected[n] == n for n in expected if n not in got)


def test_component_ids(spark):
    rows = [(5, "a b c d"), (3, "A B C D"), (3, "A B C D"), (9, None), (8, " "), (None, "a b c d"), (7, "q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect()))
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    path = list(range(100, 160))
    rng.shuffle(path)
    pairs = list(zip(path, path[1:], strict=False)) + [(1, i) for i in range(2, 60)] + [(200, 200), (None, 3), (300, 301), (300, 301)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    clean = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == brute_components(clean, {n for p in clean for n in p})


def test_components_of_a_million_links(spark):
    n = 1_000_000
    pairs = spark.range(n, numPartitions=4).selectExpr("id AS a", f"id + {n} AS b")
    found = components(pairs)
    assert found.count() == 2 * n
    assert found.filter(f"root != node % {n}").count() == 0


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_copies_by_similarity(spark, tmp_path):
    """Pairs of random texts with some words changed: the share caught by exact Jaccard similarity."""
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    docs, pairs = [], {}
    for i in range(600):
        words = say(rng.choice([60, 150, 400]))
        other = list(words)
        for _ in range(rng.randrange(1, 1 + len(words) // 25)):
            other[rng.randrange(len(words))] = "changed"
        a, b = " ".join(words), " ".join(other)
        pairs[2 * i] = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        docs += [(2 * i, a), (2 * i + 1, b)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    kept = {r.doc_id for r in simhash.keep_one(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert all(i in kept for i in pairs)
    caught = lambda low, high: [i + 1 not in kept for i, s in pairs.items() if low <= s < high]
    shares = {(low, high): sum(c) / len(c) for low, high in ((0, 0.7), (0.7, 0.8), (0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1)) if (c := caught(low, high))}
    print({k: round(v, 3) for k, v in shares.items()})
    similar = caught(0.8, 1)
    assert sum(similar) / len(similar) >= 0.9
    assert shares[0.9, 0.95] >= 0.98 and shares[0, 0.7] == shares[0.7, 0.8] == 0


def test_a_large_group_of_near_copies_leaves_one(spark, tmp_path):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    docs = []
    for i in range(3000):
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(words)))
    docs += [(9000 + i, " ".join(f"w{rng.randrange(5000)}" for _ in range(80))) for i in range(100)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.read.parquet(f"{tmp_path}/d")).collect())
    assert kept == [0, *range(9000, 9100)]


def wide_nodes(spark, values):
    rows = [(i, *np.array(v, np.uint64).view(np.int64).tolist()) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "node long, " + ", ".join(f"{w} long" for w in simhash.WIDE))


def test_strangers_that_meet_by_chance_go_no_further(spark):
    """Chance meetings in lists grow with the square of the table; only near entries are kept and looked up."""
    rng = np.random.default_rng(8)
    values = rng.integers(0, 1 << 64, (12000, simhash.NEAR_WORDS), np.uint64, endpoint=False)
    for i in range(0, 200, 2):  # near copies: 20 of 256 bits
        flips = np.zeros(256, np.uint8)
        flips[rng.choice(256, 20, replace=False)] = 1
        values[i + 1] = values[i] ^ np.packbits(flips).view(np.uint64)
    nodes = wide_nodes(spark, values).cache()
    met = [(r.key, r.pivot, r.node) for r in simhash.near_lists(nodes).collect()]
    by_chance = simhash._postings(nodes).filter("node >= 200").groupBy("key").count().filter("count > 1").count()
    assert by_chance > 500
    assert sum(node >= 200 for _, _, node in met) < by_chance / 10
    assert {(2 * i, 2 * i + 1) for i in range(100)} <= {(pivot, node) for _, pivot, node in met}


def test_sublists_do_not_depend_on_batches():
    rng = np.random.default_rng(9)
    entries = []
    for key, size in enumerate([1, 2, 64, 65, 500, 1, 3, 30]):
        base = rng.integers(0, 1 << 64, 1, np.uint64)
        base = np.append(base, ~base)
        entries += [(key, 1000 * key + i, int((base[i % 2] ^ np.uint64(1 << int(rng.integers(63)))).view(np.int64))) for i in range(size)]

    def parted(step):
        batches = (pa.record_batch([pa.array(c, pa.int64()) for c in zip(*entries[i : i + step])], names=["key", "node", "sketch"]) for i in range(0, len(entries), step))
        return sorted(tuple(r.values()) for b in simhash._met(batches) for r in b.to_pylist())

    whole = parted(len(entries))
    assert all(parted(step) == whole for step in (1, 7, 64, 100))
    assert [sum(k == key for k, _, _ in whole) for key in range(8)] == [0, 0, 64, 65, 500, 0, 2, 30]
    assert {p for k, p, _ in whole if k == 2} == {2000, 2001} and {p for k, p, _ in whole if k == 4} == {4000}
    assert list(simhash._met(iter(()))) == []
