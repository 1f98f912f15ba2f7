from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from attestra.llm import language_model as lm
from attestra.llm.elias_fano import EliasFano, pack, unpack


STRENGTH = lm.Settings()


def tokens_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall("[^\x20\x09-\x0D]+", lower), "\n"]


def is_held_out(key):
    return zlib.crc32(("null" if key is None else str(key)).encode()) % 7 == 2


class Brute:
    """The same model from dictionaries, with nothing quantised."""

    def __init__(self, rows, order):
        self.order, self.n = order, [Counter() for _ in range(order + 1)]
        for key, text in rows:
            if not is_held_out(key):
                words = [" ", *tokens_of(text)]
                self.n[1].update(words)
                for k in range(2, order + 1):
                    self.n[k].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        starts = self.n[1].pop(" ", 0)
        self.total, self.distinct = sum(self.n[1].values()), len(self.n[1])
        self.base = dict(self.n[1])
        self.n[1][" "] = starts

    def p(self, gram):
        if len(gram) == 1:
            return (self.base.get(gram[0], 0) + 1) / (self.total + self.distinct + 1)
        lower, weight = self.p(gram[1:]), STRENGTH.strength(len(gram))
        context = gram[:-1] if len(gram) > 2 else gram[0]
        c = self.n[len(gram) - 1][context]
        return (self.n[len(gram)][gram] + weight * lower) / (c + weight)

    def score(self, text):
        words = [" ", *tokens_of(text)]
        return sum(math.log10(self.p(tuple(words[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(words)))

    def row(self, key, text):
        words = tokens_of(text)
        return (key, is_held_out(key), len(words), sum(w in self.base for w in words), self.total,
                sum(math.log10(self.p((w,))) for w in words), self.score(text))


def corpus():
    rng = random.Random(8)
    words = ["the", "The", "of", "x", "É", "é", "日本", "a\x00b", *(f"w{i}" for i in range(300))]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=rng.randrange(0, 80))) for _ in range(150)]
    texts += [None, "", " \t\n\x0b", "the", "the of the of the of " * 300, "unseen words only", *texts[:40], texts[3] + " never"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "the of"), (5, "x x x"), (5, "x x x")]


@pytest.mark.parametrize("order, block, span, split, shard_bytes", [(3, 1 << 21, 1 << 20, 1 << 21, 1 << 12), (3, 700, 50, 60, 1 << 14), (2, 500, 1 << 20, 100, 1 << 30), (4, 1500, 60, 200, 1 << 15)])
def test_equals_brute_force(spark, order, block, span, split, shard_bytes):
    settings = lm.Settings(order, block=block, span=span, split=split, shard_bytes=shard_bytes, parts=12, probability_bits=20)
    rows = corpus()
    brute = Brute(rows, order)
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, held_out string, Score double").repartition(3)
    got = sorted(lm.score(docs, lm.train(docs, settings=settings)).collect(), key=repr)
    want = sorted((brute.row(*r) for r in rows), key=repr)
    assert Counter(r[:5] for r in got) == Counter(r[:5] for r in want)
    for r, w in zip(sorted(got, key=lambda r: (str(r[0]), r[5])), sorted(want, key=lambda r: (str(r[0]), r[5])), strict=True):
        assert r.base_score == pytest.approx(w[5], rel=1e-12)
        assert r.score == pytest.approx(w[6], abs=2e-3 * r.n_tokens)
    assert sum(r.score for r in got) == pytest.approx(sum(w[6] for w in want), rel=1e-3)


def test_probabilities_sum_to_one(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(docs)
    brute = Brute(rows, 3)
    words = [w for w in brute.base if w != "\n"]
    for context in ["the of", "w1", "", "never met"]:
        probes = spark.createDataFrame([(i, f"{context} {w}") for i, w in enumerate([*words, "not-a-word"])], "doc_id long, text string")
        prefix = lm.score(spark.createDataFrame([(0, context)], "doc_id long, text string"), model).collect()[0].score
        end = brute.p(tuple([" ", *tokens_of(context)][-3:]))
        start = prefix - math.log10(end)
        scored = {r.doc_id: r.score for r in lm.score(probes, model).collect()}
        total = end
        for i, w in enumerate([*words, "not-a-word"]):
            after = brute.p(tuple([" ", *tokens_of(f"{context} {w}")][-3:]))
            total += 10 ** (scored[i] - start) / after
        assert total == pytest.approx(1, abs=0.03)


def test_empty_tables(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert lm.score(docs.limit(0), lm.train(docs.limit(0))).collect() == []
    untrained = lm.score(docs, lm.train(docs.limit(0))).collect()
    assert len(untrained) == docs.count() and {r.train_tokens for r in untrained} == {0} and {r.n_known for r in untrained} == {0}


def test_monotone_sequences():
    rng = np.random.default_rng(0)
    for n, limit in [(0, 10), (1, 1), (1, 10**12), (5, 3), (1000, 10), (100000, 10**9), (3000, 1 << 62), (1000, 1)]:
        values = np.sort(rng.integers(0, limit, n))
        found = EliasFano.of(values)
        at = rng.integers(0, n, 50) if n else np.zeros(0, np.int64)
        wanted = np.concatenate([rng.integers(0, limit + 5, 500), values[:50], values[-50:] + 1, [0, limit, limit + (limit >> 1)]])
        place, equal = found.successors(wanted)
        assert (found.all() == values).all() and (found.get(at) == values[at]).all()
        assert (place == np.searchsorted(values, wanted)).all() and (equal == np.isin(wanted, values)).all()
    for width in (0, 1, 7, 63):
        values = rng.integers(0, 1 << width, 200000)
        assert (unpack(pack(values, width), width, np.arange(200000)) == values).all()


def test_words_of_texts():
    rng = random.Random(3)
    alphabet = "abAB \t\n\x0b\x1f\x85é日0"
    for text in ["", " ", "a", " a", "A b", "x" * 64, "x" * 65 + " " + "X" * 65, *("".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(300))]:
        words, starts = lm.words_of(text.encode())
        want = text.encode().lower().split()
        assert len(starts) == len(want)
        names = {}
        for word, pair in zip(want, zip(words.key.tolist(), words.check.tolist())):
            assert names.setdefault(word, pair) == pair
        assert len(set(names.values())) == len(names)


def test_words_have_different_hashes():
    rng = random.Random(4)
    words = {bytes(rng.choices(b"ab", k=rng.randrange(1, 65))) for _ in range(100_000)} | {str(i).encode() for i in range(200_000)}
    found, _ = lm.words_of(b" ".join(words))
    assert len(set(found.key.tolist())) == len(words)


def test_packing_copies_no_bits_one_by_one():
    """Every bit took a byte while numbers were packed, 64 of each number."""
    rng = np.random.default_rng(3)
    for width in (1, 7, 10, 20, 33, 63, 64):
        for n in (0, 1, 63, 64, 65, 1000):
            values = [int(v) for v in rng.integers(0, 1 << width, n, np.uint64, endpoint=False)] if width < 64 else [(1 << 64) - 1 - i for i in range(n)]
            words = pack(np.array(values, np.uint64), width)
            whole = sum(v << i * width for i, v in enumerate(values))
            assert words.tobytes() == whole.to_bytes((n * width + 63) // 64 * 8 + 8, "little")
            assert unpack(words, width, np.arange(n)).astype(np.uint64).tolist() == values
    values = rng.integers(0, 1 << 10, 1 << 16)
    tracemalloc.start()
    try:
        pack(values, 10)
        assert tracemalloc.get_traced_memory()[1] < 3 << 20
    finally:
        tracemalloc.stop()
