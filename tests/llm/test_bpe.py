from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from attestra.llm import bpe
from attestra.llm.rows import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_file("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n  x", "Hello world", "it's we'll I'D 'S", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext|", "é日本語 ñ😀👍🏽",
    "\u00a0\u2003x\u3000\x1c\x1d\x85 y\u200b", "a" * 3000, "ab" * 2000, "0123456789" * 50, "!?#" * 300, "\x00\x01\x7f", "x\r\n\ty  z ", "ſ K İ ı",
    "١٢٣ ½ Ⅷ ㊿", "words " * 20000,
]


@pytest.fixture(scope="module")
def reference():
    made = tokenizers.Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def random_texts(n):
    rng = random.Random(3)
    pools = [range(32, 127), range(0x20, 0x2FF), range(0x300, 0x3000), [9, 10, 13, 32, 160], range(0x1F300, 0x1F600)]
    return ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_encoding_equals_the_library(reference):
    codec = bpe.Codec(bpe.Vocabulary(open(PATH, encoding="utf-8").read()))
    for text in [t or "" for t in TEXTS] + random_texts(3000):
        ids = reference.encode(text, add_special_tokens=False).ids
        mine = codec.encode(text)
        assert np.frombuffer(mine, "<u4").tolist() == ids, repr(text[:80])
        assert codec.decode(mine) == reference.decode(ids, skip_special_tokens=False)


def test_every_character_alone_and_between_letters(reference):
    codec = bpe.Codec(bpe.Vocabulary(open(PATH, encoding="utf-8").read()))
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for at in range(0, len(chars), 500):
        text = "".join(f"a{c}b {c}1" for c in chars[at : at + 500])
        if np.frombuffer(codec.encode(text), "<u4").tolist() != reference.encode(text, add_special_tokens=False).ids:
            wrong += [c for c in chars[at : at + 500] if np.frombuffer(codec.encode(f"a{c}b {c}1"), "<u4").tolist() != reference.encode(f"a{c}b {c}1", add_special_tokens=False).ids]
    assert [hex(ord(c)) for c in wrong] == []


def test_forced_cuts_are_never_merged():
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    for word in ("hello", "zqxj", "naïve", " 日本語", "Ünïcödé", "qzvkxj"):
        data = word.encode()
        assert b"".join(vocabulary.fragments(data)) == data
        whole = vocabulary.merge(data)
        assert [i for f in vocabulary.fragments(data) for i in vocabulary.merge(f)] == whole


def test_rows(spark, reference):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "y"), (None, "a", "y")], "doc_id long, text string, ids string")
    got = bpe.digests(bpe.round_trip(docs, PATH)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = TEXTS[r.doc_id] or "" if r.doc_id is not None else "a"
        ids = np.array(reference.encode(text, add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), PATH).collect() == []
    twice = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(r.text for r in twice) == sorted((t or "") for t in [*TEXTS, "a", "a"])


def test_ascii_texts_are_cut_alike(reference):
    rng = random.Random(4)
    codec = bpe.Codec(bpe.Vocabulary(open(PATH, encoding="utf-8").read()))
    texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} {chr(c)}" for c in range(128)]
    texts += ["".join(chr(rng.randrange(128)) if rng.random() < 0.5 else rng.choice(" 'stmdrevl") for _ in range(60)) for _ in range(2000)]
    for text, mine in zip(texts, codec.encode_all(texts), strict=True):
        assert bpe.ASCII_WORDS.findall(text) == codec.words.findall(text)
        assert np.frombuffer(mine, "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_new_words_are_merged_together(monkeypatch):
    vocabulary = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    rng = random.Random(6)
    words = ["".join(chr(rng.choice(range(97, 123))) for _ in range(rng.randrange(1, 60))) for _ in range(3000)] + ["é日本語", "x", " ñ" * 9]
    alone = [np.array([i for f in vocabulary.fragments(w.encode()) for i in vocabulary.merge(f)], "<u4").tobytes() for w in words]
    assert vocabulary.ids_of_words(words) == alone
    monkeypatch.setattr(bpe, "REMEMBERED", 100)
    calls = []
    monkeypatch.setattr(bpe.Vocabulary, "_merge_short", lambda self, fragment: calls.append(fragment))
    codec = bpe.Codec(vocabulary)
    short = [w for w in words if len(w) <= 30]
    assert list(codec.encode_all([" ".join(short)] * 3)) == [codec.encode(" ".join(short))] * 3
    assert calls == [] and len(codec.of_words) <= 100 and len(codec.of_words.old) <= 100
