"""The thin queries over the operators, one for each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barkeep.llm import bpe, embed_dedup, exact_dedup, fingerprint, jaccard_join, packing, pii, quality, sharding, spelling, token_count, url_filter, vector_codes
from barkeep.llm._util import table, written
from barkeep.llm.oracles import LISTED_HOSTS, ORACLES, RULES

__all__ = ["ORACLES", "QUERIES"]

N_SHARDS = 40
RANKS = "byte_bpe_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.minimax_shards(table(spark, sf_dir, "documents"), N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    out = quality.score(docs, quality.train(docs, labels))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is every URL of the listed hosts and their subdomains that the table has."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(rf"(^|\.)({'|'.join(LISTED_HOSTS)})\."))
    return url_filter.judge(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", fingerprint.edited_text(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_lanes", fingerprint.edited_lanes(F.col("text"), F.col("fingerprint"), F.col("edited")))
    own = F.col("fingerprint")
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_hex(own).alias("fingerprint"),
        fingerprint.as_hex(F.col("edited_lanes")).alias("edited_fingerprint"),
        fingerprint.likeness(own, F.col("edited_lanes")).alias("near_edited"),
        fingerprint.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in pii.BASE]
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    text = pii.as_text(F.filter("spans", lambda s: s["kind"].isin(base)))
    return found.select("doc_id", *[count(k) for k in base], F.sha2(text, 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, written and kept, and each under four edits: an insertion, a deletion, a replaced middle and a replaced end."""
    docs = table(spark, sf_dir, "documents")
    trees = written(token_count.grown(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN), "token-trees", compression="zstd")
    text, n = F.col("text"), F.char_length("text")
    at = lambda share: F.floor(n * share).cast("int")
    edit = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), new.alias("text"))
    edits = F.array(
        edit(at(0.3), at(0.3), F.substring(text, 1, 20)),
        edit(at(0.5), at(0.5) + 25, F.lit("")),
        edit(at(0.7), at(0.7) + 40, F.substring(text, at(0.1) + 1, F.lit(30))),
        edit(F.greatest(n - 15, F.lit(0)), n, F.lit("the end")),
    )
    out = token_count.edited(trees.withColumn("edits", edits), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("edited_n_tokens"), "n_pretokens", "n_encoded_again", F.sha2("text", 256).alias("edited_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (op1_byte_bpe, op2_embedding_dedup, op3_sharding, op4_quality, op5_jaccard_join, op6_url_filter, op7_fingerprint, op8_packing, op9_pii, op10_token_count, op11_exact_dedup, op12_vector_codes, op13_spelling_variants)}
