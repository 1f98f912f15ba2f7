"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import (
    bpe, decontamination, embeddings, fim, language_model, line_templates, quality, sharding, simhash, token_counts, urls, warc, whitening,
)
from attestra.llm.rows import read, tokenizer_file
from attestra.session import prepare

URL_RULES = (
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/"),
)
SHARDS = 16

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return build(spark, sf_dir)

    REGISTRY[build.__name__] = run
    return run


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.fit(urls.labelled_urls(spark))
    return urls.judge(read(spark, sf_dir, "pages"), model, URL_RULES)


@query
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(read(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.payload_report(warc.read(spark, manifest))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontamination.build_index(read(spark, sf_dir, "documents"))
    found = decontamination.contamination(index, decontamination.search(index, read(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.regular_tree(SHARDS)
    placed = sharding.shards(read(spark, sf_dir, "documents"), tree, sharding.grow(tree))
    return placed.withColumn("law", F.lit("key"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.drop_recurring_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(read(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened_rows(read(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.train(docs))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
