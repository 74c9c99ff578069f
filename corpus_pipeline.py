"""Corpus preparation in stages; each reads what the one before wrote.

Quality rules, near duplicates, benchmark passages, the mixture of domains, shards. All stages
but the last return the columns of their input, so each works on everything that was kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import content_hash, table
from riskloom.llm.decontamination import contained_items
from riskloom.llm.mixing import WEIGHTS, label_domains, mix_documents
from riskloom.llm.ngram_join import drop_near_copies
from riskloom.llm.quality import keep_good
from riskloom.llm.sharding import SHARDS, shard_documents
from riskloom.sources.staging import stage

#: Words per shingle and least similarity in percent of near duplicates.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and do not repeat themselves."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links hold together: the one with the least id."""
    return drop_near_copies(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Texts go by their hash, so rows without an id or with a repeated one are judged alike."""
    texts = docs.select(content_hash(docs["text"]).alias("doc_id"), docs["text"].alias("text"))
    found = contained_items(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(stage(found, "contaminated"), content_hash(docs["text"]) == F.col("__found"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its fitted rate says, down to not at all."""
    mixed = mix_documents(docs, label_domains(table(spark, sf_dir, "labels")), WEIGHTS)
    # Copies depend on the id and the text alone, so rows that repeat an id are told apart by the text.
    copies = stage(mixed.select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"), F.col("copies").alias("__copies")).distinct(), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__content"))
    often = docs.join(copies, same).where("__copies > 0")
    return often.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    return shard_documents(docs, [1.0] * SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]
#: Components, a fitted classifier and fitted rates have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
