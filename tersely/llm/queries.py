"""The operators' registered queries over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.llm import (
    bpe,
    chat,
    decontaminate,
    merkle,
    near_copies,
    pii,
    quality,
    substrings,
    token_files,
    top_k,
    toxicity,
    url_rules,
    whitening,
)
from tersely.llm.common import table
from tersely.llm.oracles import ORACLES

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the rules on the url of every page."""
    rules = spark.createDataFrame(URL_RULES, url_rules.RULES)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, rules).drop("url")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words in all documents."""
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13
    )
    return decontaminate.judged(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without windows of 20 words that start earlier."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th embedding with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of all documents, read back from the token files."""
    docs = table(spark, sf_dir, "documents")
    return token_files.token_places(spark, docs, BYTE_VOCABULARY, END_ID)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as each of its speakers sees it; the mask as start:end pairs."""
    seen = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"]))
    return seen.withColumn("mask", F.array_join(spans, ","))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents, by shingles of four words."""
    docs = table(spark, sf_dir, "documents")
    return near_copies.near_copies(docs, shingle=4, percent=80).drop("doc_key")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the text decoded from them, as digests."""
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document under the models of trusted text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality.quality(docs, labels)
    return judged.select(
        "doc_id",
        "lang",
        "n_chars",
        F.round("score", 6).alias("score"),
        F.round("threshold", 6).alias("threshold"),
        F.round("toxic_score", 6).alias("toxic_score"),
        F.round("toxic_threshold", 6).alias("toxic_threshold"),
        "kept",
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and whether a copy, tampered with in part, still fits."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.COLUMNS]
    made = merkle.manifest(docs, changed=F.when(tampered, merkle.leaf(more)))
    found = merkle.proofs(made)
    return found.select(
        F.col("id").alias("doc_id"),
        *[merkle.hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")],
        F.sha2(F.array_join(F.transform("proof", merkle.hex_text), ""), 256).alias("proof_sha256"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding."""
    found = whitening.whitened(table(spark, sf_dir, "embeddings"), components=16)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by weights learnt from labelled ones outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs, toxicity.train(docs, labels))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_rules,
        op2_decontaminate,
        op3_substrings,
        op4_top_k,
        op5_token_files,
        op6_chat,
        op7_pii,
        op8_near_copies,
        op9_bpe,
        op10_quality,
        op11_merkle,
        op12_whitening,
        op13_toxicity,
    )
}
