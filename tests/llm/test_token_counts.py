from __future__ import annotations

import random

import regex

from attestra.llm import token_counts
from attestra.llm.rows import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.tiktoken")
SCORES = token_counts.piece_scores(open(PATH, encoding="utf-8").read())


def brute(word):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        best.append(max((best[s][0] + SCORES[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in SCORES))
    return -best[-1][1]


def test_trie_equals_one_by_one():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"theinrgao \xc3\xa9") for _ in range(rng.randrange(1, 14))) for _ in range(2000)] + [b"a" * 400, bytes(range(256))]
    assert token_counts.Trie(SCORES).counts(words) == {w: brute(w) for w in words}


def test_shared_prefixes_are_scored_once(monkeypatch):
    trie, seen = token_counts.Trie(SCORES), []
    state = trie._state
    monkeypatch.setattr(trie, "_state", lambda word, end, path: seen.append(word[:end]) or state(word, end, path))
    words = [b"interest", b"interesting", b"interests", b"internal", b"in", b"in"]
    trie.counts(words)
    assert sorted(seen) == sorted({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 20)
    texts = [None, "", "the cat", "the cat", "  x\n\n y", "naïve 日本 😀", "z" * 3000, " ".join(f"word{i % 90}" for i in range(30000))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "the", 2)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.count_tokens(docs, PATH).collect()}
    for i, text in [*enumerate(texts), (None, "the")]:
        words = regex.findall(token_counts.PATTERN, text or "")
        memo = {w: brute(w.encode()) for w in set(words)}
        assert got[i] == (len(words), sum(memo[w] for w in words))
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []
    assert token_counts.totals(token_counts.count_tokens(docs, PATH)).collect()[0].n_rows == len(texts) + 1
