"""The registered queries: each operator over its whole table, with production parameters."""
from __future__ import annotations

import os
import secrets

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

#: Where the public vocabulary files are; the same on every machine.
TOKENIZERS = os.environ.get("TOKENIZER_FILES") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodequery.llm import byte_bpe

    ranks, pattern = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", byte_bpe.PATTERN
    ids = byte_bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", ranks, pattern)
    back = byte_bpe.decode_ids(ids, "doc_id", ranks, pattern)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodequery.llm import simple8b

    return simple8b.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/word_bpe_49k.json", "word", 1)


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodequery.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json", "byte", 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodequery.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", k=3, radius=2)


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodequery.llm import weighted_sampling

    return weighted_sampling.fingerprint_edits(table(spark, sf_dir, "documents"), "doc_id", "text")


def op6_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodequery.llm import quality_rules

    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "quality")


def op5_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodequery.llm import quality_rank

    return quality_rank.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "quality")


def op7_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodequery.llm import main_text

    return main_text.extract(table(spark, sf_dir, "pages"), "page_id", "html", ["url"])


#: Keys the surrogates: one's own secret, for the same surrogates in every run, or else one drawn for this run, which nobody can undo.
SURROGATE_KEY = os.environ.get("SURROGATE_KEY") or secrets.token_hex(32)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodequery.llm import pii

    done = pii.replace_entities(table(spark, sf_dir, "documents"), "text", SURROGATE_KEY, ["doc_id"])
    return done.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join("entities.kind", " ").alias("kinds"))


def op1_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodequery.llm import warc

    return warc.archive(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodequery.llm import divergence

    return divergence.audit(table(spark, sf_dir, "documents"), "text", "lang", "source")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodequery.llm import lexical_search

    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodequery.llm import top_k

    return top_k.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
