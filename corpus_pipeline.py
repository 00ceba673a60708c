"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.llm import bpe, jaccard, langid, mixing, suffix
from locusmill.llm._tables import bitmap, with_bit, written
from locusmill.llm.queries import byte_bpe
from locusmill.session import ship

#: Documents whose language is predicted with less posterior probability go.
LEAST_SCORE = 0.5

# Stages work on rows: ids may be null or shared, equal rows are rows of their own until the join makes one group of them. Columns besides those of documents
# are passed on, whatever their names. An empty table gives an empty one, and so does a table that loses all its rows on the way.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language: not those predicted `und` (null text, empty or without a letter) or with a score under LEAST_SCORE.

    Learns from rows with text and lang whose doc_id isn't held out (a null id isn't). Texts are read whole. Of languages that tie the first by name is predicted."""
    ship(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return langid.predict(rows, model, keep=["__row"]).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("__row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the one with the smallest doc_id (null last), among equal ones with the smallest digest.

    Rows are written with a number first, as doc_ids may be null or shared. Rows without words (null or blank texts) are in no group and stay."""
    ship(spark)
    digest = F.xxhash64(*[c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns])
    rows = written(docs.withColumn("__h", digest).withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = jaccard.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__id"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__h", "__row")
    ids = rows.select("doc_id", "__h", "__row")
    keep = ids.join(found, F.col("__row") == F.col("__id")).groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.__row").alias("__keep"))
    return with_bit(rows, F.col("__row"), bitmap(keep, F.col("__keep"), "keep"), "__stays").where("__stays").select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut; documents of nothing else go, and so do null and empty texts.

    Earlier is by doc_id (null first), then by a digest of the words. Rows with one doc_id (or none) and the same words don't cut each other. n_chars follows the text."""
    ship(spark)
    return suffix.without_repeats(docs).where("text <> ''").withColumns({"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {})


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source of its own, texts without words are never taken."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids of every whole text of the mix, with the digests of ids and decoded text; a null or empty text has no ids."""
    ship(spark)
    return bpe.encode_decode(docs, byte_bpe(), keep=["doc_id", "source"], ids=True)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)


#: Byte-pair merges, naive Bayes and connected components are not expressed in SQL; tests hold run() against plain Python.
ORACLE_SQL = None
