from __future__ import annotations

import math
import random
from collections import defaultdict
from itertools import combinations
from pathlib import Path

from attestra.llm import line_templates as lt
from attestra.session import shared_folder


def brute(docs, when=lt.RECURRENCE):
    """By the rules as stated, with plain tokens and fields instead of hashes."""
    holders = defaultdict(set)
    for row, (doc, text) in enumerate(docs):
        for number, line in enumerate((text or "").split("\n")):
            tokens = [lt.masked(t) for t in line.encode().split()]
            n = len(tokens)
            if n < max(when.min_tokens, 1):
                continue
            head, rest = tokens[:3], tokens[3:]
            k = min(len(rest), lt.FIELDS)
            fields = [tuple(rest[len(rest) * i // k : len(rest) * (i + 1) // k]) for i in range(k)]
            places = [(n, "whole", tuple(tokens))]
            places += [(n, "fields", tuple(head), c, tuple(fields[i] for i in c)) for c in combinations(range(k), math.ceil(lt.SIMILARITY * k))]
            places += [(n, "leading", i, tuple(head[:i] + head[i + 1 :]), tuple(rest)) for i in range(3) if k]
            for place in places:
                holders[place].add((-1 if doc is None else doc, row, number))
    gone = set()
    for (n, *_), lines in holders.items():
        needed = when.short_docs if n < when.short else when.min_docs
        if len({d for d, _, _ in lines}) > 1 and len({r for _, r, _ in lines}) >= needed:
            gone |= {(r, i) for d, r, i in lines if d != min(lines)[0]}
    out = []
    for row, (doc, text) in enumerate(docs):
        lines = [] if text is None else text.split("\n")
        left = [x for i, x in enumerate(lines) if (row, i) not in gone]
        out.append((doc, None if text is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["sun", "moon", "star", "sea", "hill", "road"]) + rng.choice("abcdefgh") for _ in range(n))
    passage = say(60)
    docs = []
    for i in range(80):
        lines = [say(rng.choice([2, 5, 12, 30])) for _ in range(rng.randrange(6))]
        if i % 3 == 0:
            lines.insert(0, f"Posted on 2024-0{i % 9}-11 by user{i} in the general discussion forum")
        if i % 4 == 0:
            lines.append(passage)
        if i % 7 == 0:
            lines += ["All rights reserved", "All rights reserved"]
        if i % 5 == 0:
            words = passage.split()
            words[rng.randrange(5, 60)] = "changed"
            lines.append(" ".join(words))
        if i % 2 == 0:
            lines.append(f"This page was last edited by {rng.choice(['Ann', 'Bob', 'Cy'])} of the team")
        docs.append((i, "\n".join(lines)))
    docs += [(None, None), (None, passage), (7, ""), (7, "\n\n"), (500, "x y z w v u t s r\n" * 3000), (501, "a b c d e f g h i\n" * 2), (501, "a b c d e f g h i")]
    return docs


def stored(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_lines_equal_brute_force(spark, tmp_path):
    docs = corpus()
    frame = stored(spark, str(tmp_path / "d"), [(*d, 1, "x") for d in docs], "doc_id long, text string, _drop int, line string")
    got = lt.drop_recurring_lines(frame)
    assert got.columns == [*frame.columns, "n_lines", "n_dropped"]
    rows = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr)
    assert rows == brute(docs)
    assert sum(r[3] for r in rows) > 60


def test_a_repeated_passage_stays_once(spark, tmp_path):
    docs = corpus()
    passage = next(line for _, text in docs if text for line in text.split("\n") if len(line.split()) == 60)
    frame = stored(spark, str(tmp_path / "d"), docs, "doc_id long, text string")
    holders = [r.doc_id for r in lt.drop_recurring_lines(frame).collect() if r.text and passage in r.text]
    assert holders == [None]


def test_clean_documents_stay(spark, tmp_path):
    docs = [(i, "\n".join(f"the one of {' '.join(chr(97 + (i * k + j) % 26) * 3 for k in range(1, n))}" for j, n in ((0, 3), (9, 30)))) for i in range(20)]
    frame = stored(spark, str(tmp_path / "d"), docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in lt.drop_recurring_lines(frame).collect()) == docs


def test_empty(spark, tmp_path):
    frame = stored(spark, str(tmp_path / "d"), [], "doc_id long, text string")
    assert lt.drop_recurring_lines(frame).collect() == []


def test_a_leaf_has_several_templates(spark, tmp_path):
    """Near copies that each differ in a word, a template with a name, and strangers in the leaves of both."""
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(60)]
    copies = [" ".join([*words[: 5 + i], "changed", *words[6 + i :]]) for i in range(20)]
    names = [f"This page was last edited by {n} of the whole team yesterday" for n in ("Ann", "Bob", "Cyr", "Dee")]
    strange = [" ".join([*words[:3], *words[59:2:-1]]), "This page was never seen in any book or on any wall"]
    few = [f"one two three four {w} six seven" for w in ("a", "b", "c", "d", "e", "f", "g", "h", "i")]
    docs = [(i, "\n".join(x)) for i, x in enumerate([*([c] for c in copies), *([n] for n in names), strange, *([f, f] for f in few)])]
    frame = stored(spark, str(tmp_path / "d"), docs, "doc_id long, text string")
    left = {r.doc_id: r.text for r in lt.keep_new_text(frame).collect()}
    # Of seven tokens, ten documents are needed: there are nine.
    assert left == {0: copies[0], 20: names[0], **dict(docs[24:])}
    assert len({lt.line_of(c.encode())[1] for c in [*copies, strange[0]]}) == 1 == len({lt.line_of(c.encode())[1] for c in [*names, strange[1]]})


def test_names_among_the_leading_tokens(spark, tmp_path):
    lines = [f"user {chr(97 + i) * 4} has logged in to the main site now" for i in range(20)]
    others = ["user aaaa had logged in to the main page now", "the user has seen all of the main site now"]
    docs = list(enumerate([*lines, *others]))
    frame = stored(spark, str(tmp_path / "d"), docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lt.drop_recurring_lines(frame).collect() if r.text} == {0: lines[0], **dict(docs[20:])}


def test_one_threshold_for_all_lines(spark, tmp_path):
    docs = corpus() + [(900, "One\ntwo words\nOne"), (901, "two words\nOne"), (902, "\n\n")]
    frame = stored(spark, str(tmp_path / "d"), docs, "doc_id long, text string")
    when = lt.Recurrence(1, 2, 0, 2)
    rows = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in lt.drop_recurring_lines(frame, when=when).collect()), key=repr)
    assert rows == brute(docs, when)
    assert (901, "", 2, 2) in rows and (902, "\n\n", 3, 0) in rows


def test_keys_of_lines_take_little_disk(spark):
    """28 keys a line, of which all but the key is the same: stored by column they take 8 bytes each, as checkpointed rows 14."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    docs = [(d, "\n".join("one two three " + " ".join(word() for _ in range(8)) for _ in range(700))) for d in range(3)]
    lines = lt._lines(spark.createDataFrame([(d, d, t) for d, t in docs], "row long, doc long, text string"), "row", "doc", "text", 3)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    used = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = used()
    found = lt.recurring_lines(lines)
    assert used() - before < 3 * 700 * 28 * 11
    assert found.count() == 0
