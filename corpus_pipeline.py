"""From raw documents to token files: five stages, each over all that the one before it kept.

A document travels through a stage as one struct, so its columns may have any names beside ``doc_id``, ``text``
and ``source``.  Null, empty and blank texts fail the quality rules and go there; rows without an id are never removed as near
copies; equal rows stay once after the join; of rows with one id and different texts, those linked elsewhere go by their own text;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import decontaminate, jaccard, mixing, quality, token_files
from quirefold.llm.queries import tokenizer_path
from quirefold.llm.shared import cut, likely, scratch, without


#: Words of a token memo: workers live on and keep theirs while the other stages run in them.
MEMO = 1 << 18


def rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Each document as the struct ``row``, and the columns that a stage reads."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *columns)


def known(doc_id: Column) -> Column:
    """An id as a key; the least long stands for null."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("key")


def named(docs: DataFrame) -> DataFrame:
    """Each document as ``row``, with the id and the hash of the text that name it."""
    return rows(docs).select("row", known(F.col("row.doc_id")), F.xxhash64("row.text").alias("text_hash"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the full policy rejects."""
    return quality.apply_policy(quality.ledger(rows(docs, "text")), quality.FULL, "kept").where("kept").select("row.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least id; equal rows once."""
    links = cut(jaccard.link_documents(docs), "links")
    removed = cut(links.where("doc_id <> component_id").select(known(F.col("doc_id")), "text_hash").distinct(), "removed")
    twice = cut(links.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(known(F.col("doc_id"))), "twice")
    kept = without(named(docs), removed, ["key", "text_hash"])
    if not twice.isEmpty():
        kept = without(kept, twice, ["key"]).unionByName(likely(kept, twice, ["key"]).join(twice, "key", "left_semi").dropDuplicates().select("row", "key", "text_hash"))
    return kept.select("row.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    leaks = cut(decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(known(F.col("doc_id")), "text_hash").distinct(), "leaks")
    return without(named(docs), leaks, ["key", "text_hash"]).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.repeat_documents(mixing.mix_sources(rows(docs, "doc_id", "text", "source"), weights=(5, 2, 1), max_epochs=3), ["row"]).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document, read back from the token files written: id, start, number and checksum of its ids."""
    folder = f"{scratch(spark)}/token-files"
    token_files.write_token_files(docs, folder, tokenizer_path("byte_bpe_50k.json"), end_id=2, memo=MEMO)
    return token_files.read_documents(spark, folder)


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("decontaminate", decontaminated), ("mixing", mixed), ("token_output", token_output)]

#: Shingle similarity, spaced seeds and tokenization are beyond SQL over whole tables; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
