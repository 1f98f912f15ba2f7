from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from attestra.llm import fim


def brute(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    alphabet = "ab <>PSM\n" + "é日😀́\x00"
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    shared = "".join(rng.choice("abcdefgh é日") for _ in range(30000))
    return [None, "", "x", "<", "<P", "<S<P", "日" * 9000, "a" * 20000, *some, shared, shared[5000:20000] + "x", "é" + shared,
            "a" * 8191 + "<P>" + "b" * 9000, "a" * 8190 + "<S" + "b" * 100]


def test_rows_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fim, "REMEMBERED", 1 << 16)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (3, "x"), (3, "x")]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, form string, N int")
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr) == sorted(
        ((k, *brute(k, t)) for k, t in rows), key=repr)
    assert sorted((str(r.doc_id), r.back) for r in out) == sorted((str(k), t or "") for k, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_marks_across_chunk_borders(monkeypatch):
    monkeypatch.setattr(fim, "SMALLEST", 1)
    monkeypatch.setattr(fim, "LARGEST", 1)
    for text in texts():
        body = (text or "").encode()[:400]
        layout = fim.Layout(body, fim.Chunks())
        assert layout.marked == any(m in body for m in (b"<P>", b"<S>", b"<M>"))
        assert layout.points == sum(b & 0xC0 != 0x80 for b in body)


def chunks(text):
    ends = list(fim.chunk_ends(text))
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def test_chunks_follow_content_and_are_shared(monkeypatch):
    rng = random.Random(1)
    shared = bytes(rng.randrange(256) for _ in range(60000))
    a, b = chunks(shared), chunks(b"another start " + shared)
    assert b"".join(a) == shared and max(map(len, a)) <= fim.LARGEST
    assert len(set(a) & set(b)) > 0.9 * len(a)
    calls, summarise = [], fim.summarise
    monkeypatch.setattr(fim, "summarise", lambda chunk: calls.append(chunk) or summarise(chunk))
    known = fim.Chunks()
    for text in (shared, b"another start " + shared, shared):
        fim.Layout(text, known)
    assert len(calls) == len(set(calls)) == len({*a, *b})


def test_hash_does_not_depend_on_spans(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.randrange(256) for _ in range(50000))
    whole = list(fim.chunk_ends(text))
    monkeypatch.setattr(fim, "SPAN", 777)
    assert list(fim.chunk_ends(text)) == whole


def test_draws_follow_rates():
    forms = [fim.transform(b"some text", str(i), fim.Chunks())[1] for i in range(4000)]
    assert abs(forms.count("plain") / 4000 - 0.1) < 0.02 and abs(forms.count("spm") / 4000 - 0.18) < 0.02
    assert fim.transform(b"abc", "1", fim.Chunks(), rate=0)[1] == "plain"
