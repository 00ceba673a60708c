"""The thin queries op<N>_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from locusmill.llm import ann, bpe, chat, html, jaccard, langid, mixing, suffix, topk
from locusmill.session import ship


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.length_histogram(bpe.token_lengths(docs, byte_bpe(), keep=[]))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return suffix.repeated_passages(docs).select("doc_id", "start", "stop", "n_words", "kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("NOT held_out AND doc_id IS NOT NULL"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ship(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return chat.preference_pairs(turns, chat.consecutive_pairs(turns)).drop("chosen_segments", "rejected_segments")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), byte_bpe())


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(ship(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_ann": op5_ann,
    "op6_bpe": op6_bpe,
    "op7_exact_topk": op7_exact_topk,
    "op8_html_extraction": op8_html_extraction,
    "op9_mixing": op9_mixing,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLES: dict[str, str] = {"op2_suffix_dedup": suffix.SQL, "op4_chat_formatting": chat.SQL, "op7_exact_topk": topk.SQL, "op9_mixing": mixing.targets_sql(), "op10_jaccard_join": jaccard.SQL}
