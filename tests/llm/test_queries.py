"""The registered queries on the sample tables, against SQL where there is some and brute force elsewhere."""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import pytest

import corpus_pipeline
from attestra.llm import decontamination, oracle, queries, simhash
from attestra.llm.rows import read, tokenizer_file
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_line_templates import brute as without_lines
from tests.llm.test_simhash import brute_components

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="sample tables are not here")


@pytest.mark.parametrize("name", list(oracle.STATEMENTS))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = queries.REGISTRY[name](spark, SF_DIR)
    cursor = con.execute(oracle.STATEMENTS[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == sorted(df.columns)
    mine = Counter(tuple(str(row[c]) for c in order) for row in df.collect())
    assert mine == Counter(tuple(str(v) for v in row) for row in cursor.fetchall())


def test_every_operator_has_a_query():
    assert [n for n in queries.REGISTRY if n != "pipeline"] == [f"op{i}_{n.split('_', 1)[1]}" for i, n in enumerate(queries.REGISTRY, 1) if n != "pipeline"]


def brute_keep_one(docs):
    sets = {d.doc_id: set(simhash.shingle_set((d.text or "").encode()).tolist()) for d in docs}
    ids = sorted(sets)
    close = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if close(sets[a], sets[b])]
    return {i for i, root in brute_components(pairs, ids).items() if i == root}


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    docs = read(spark, SF_DIR, "documents")
    columns, held = docs.columns, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        held[name] = (before, docs.collect())
        assert docs.columns == columns or number == len(corpus_pipeline.STAGES) - 1
    before, after = held["quality classifier"]
    predicted = {r.doc_id: r.predicted for r in queries.REGISTRY["op6_quality"](spark, SF_DIR).collect()}
    assert sorted(after) == sorted(r for r in before if predicted[r.doc_id])
    before, after = held["line dedup"]
    cleaned = [r for r in without_lines([(d.doc_id, d.text) for d in before]) if not r[3] or r[1].strip()]
    assert sorted((d.doc_id, d.text) for d in after) == sorted((r[0], r[1]) for r in cleaned)
    assert all(d.n_chars == len(d.text) for d in after)
    before, after = held["SimHash near-dedup"]
    assert sorted(after) == sorted(d for d in before if d.doc_id in brute_keep_one(before))
    before, after = held["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in read(spark, SF_DIR, "benchmark").collect()]
    bad = {r[0] for r in contaminated([(d.doc_id, d.text) for d in before], items) if r[-1]}
    assert bad and sorted(after) == sorted(d for d in before if d.doc_id not in bad)
    before, after = held["BPE encoding and decoding"]
    library = tokenizers.Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    texts = {d.doc_id: d.text for d in before}
    assert len(after) == len(texts)
    for r in after:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(after)


ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\n ", "en", "s", 4), (None, "a b c", "en", "s", 5), (4, "word " * 40000, None, "s", 1),
    (5, "same text here again\nand a second line of it", "en", "s", 1), (5, "same text here again\nand a second line of it", "en", "s", 1),
    (6, "same text here again\nand a second line of it", "en", "s", 1),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_and_empty_tables(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, _drop int, row int, n_words int, fingerprint int"
    spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], schema).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    assert docs.count() <= len(rows)


def test_one_row_of_each_group_stays(spark, tmp_path):
    spark.createDataFrame([*ODD, (9, "same text here again\nand a second line of it", "de", "t", 2)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in")
    kept = simhash.keep_one(spark.read.parquet(f"{tmp_path}/in")).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 4, 5]
    assert decontamination.SHARE == 20
