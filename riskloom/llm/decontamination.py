"""Benchmark decontamination by size-partitioned MinHash containment search.

An item with n shingles is contained in a document when at least ``ceil(t n)`` of its
shingles are among the document's. Its sketch is its ``n - ceil(t n) + 1`` least shingle
hashes: any document that contains it holds one of them, whatever else it holds, so
short items are found inside documents of any length and none is missed.

Items are partitioned by size (powers of two). Each partition has a threshold, the
greatest hash in its sketches, and a least size of documents that can contain its
items. A document looks up only hashes below the threshold of the partitions that it
is large enough for. Documents that hit a sketch are read again and verified on the
shingles themselves, as text.

Defined cases: null and blank texts have no shingles and match nothing; a text of
fewer words than a shingle is one shingle, so such an item is found only as a whole
document; a null id is a value of its own; repeated rows give one pair; empty tables
match nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import only, shingle_hashes, shingles, split_words, table
from riskloom.sources.staging import stage

SHINGLE_WORDS = 5
CONTAINMENT = 0.8


def _size_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double") + 0.5)).cast("int")


def _needed(n: Column, containment: float) -> Column:
    """Shingles of an item that a document has to hold, in whole numbers."""
    return F.ceil(n * F.lit(round(containment * 1000)) / 1000 - F.lit(1e-9)).cast("int")


def item_sketches(items: DataFrame, size: int, containment: float) -> DataFrame:
    """item_id, n, needed, size_class, hash: the least hashes of every item that has shingles."""
    items = items.select("item_id", split_words(F.lower("text")).alias("words"))
    hashed = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes("words", size))).alias("hashes"))
    sized = hashed.withColumn("n", F.size("hashes")).withColumn("needed", _needed(F.col("n"), containment))
    least = F.slice("hashes", F.lit(1), F.col("n") - F.col("needed") + 1)
    sketches = sized.select("item_id", "n", "needed", _size_class(F.col("n")).alias("size_class"), F.explode_outer(least).alias("hash"))
    return sketches.where("hash is not null")


def contained_items(docs: DataFrame, items: DataFrame, size: int = SHINGLE_WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles of every document that holds ``containment`` of an item's shingles."""
    docs = only(docs, doc_id="bigint", text="string")
    worded = docs.select("doc_id", split_words(F.lower("text")).alias("words"))
    items = only(items, item_id="bigint", text="string")
    sketches = stage(item_sketches(items, size, containment), "sketches")
    # One row per power of two: the documents' lookup is bounded by these.
    classes = sketches.groupBy("size_class").agg(F.max("hash").alias("most"), F.min("needed").alias("needed")).collect()
    if not classes:
        return docs.join(items, F.lit(False)).select("doc_id", "item_id", F.lit(0).alias("n_shared"), F.lit(0).alias("n_shingles"))
    limits = F.array(*[F.struct(F.lit(c["needed"]).alias("needed"), F.lit(c["most"]).alias("most")) for c in classes])

    sized = worded.select("doc_id", shingle_hashes("words", size).alias("hashes")).withColumn("n", F.size("hashes"))
    most = F.array_max(F.transform(F.filter(limits, lambda c: c["needed"] <= F.col("n")), lambda c: c["most"]))
    # An outer explode, and the limit compared after it: else the planner puts a filter on the array, or the limit,
    # where the words of a text are worked out again for each of its shingles.
    looked = sized.select("doc_id", most.alias("most"), F.explode_outer("hashes").alias("hash")).where("hash <= most")
    # The probing side is never shuffled when the sketches are small; else both are, by hash.
    candidates = stage(looked.join(sketches.select("hash", "item_id"), "hash").select("doc_id", "item_id").distinct(), "candidates")

    wanted = items.select("item_id", split_words(F.lower("text")).alias("words"))
    wanted = wanted.select("item_id", F.array_distinct(shingles("words", size)).alias("item_shingles")).distinct()
    wanted = wanted.select(F.col("item_id").alias("item"), "item_shingles")
    named = candidates.select(F.col("doc_id").alias("doc"), "item_id")
    pairs = named.join(wanted, F.col("item_id").eqNullSafe(F.col("item"))).select("doc", "item_id", "item_shingles")
    held = worded.join(named.select("doc").distinct(), F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
    held = held.select("doc_id", F.array_distinct(shingles("words", size)).alias("held"))
    verified = pairs.join(held, F.col("doc_id").eqNullSafe(F.col("doc"))).select(
        "doc_id", "item_id", F.size("item_shingles").alias("n_shingles"),
        F.size(F.array_intersect("item_shingles", "held")).alias("n_shared"),
    )
    return (
        verified.where(F.col("n_shared") >= _needed(F.col("n_shingles"), containment))
        .select("doc_id", "item_id", "n_shared", "n_shingles").distinct()
    )


def drop_contaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no item; one with a null id cannot be named and stays."""
    return docs.join(found.select(F.col("doc_id").alias("__found")).distinct(), F.col("doc_id") == F.col("__found"), "left_anti")


def op10_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) pair with at least four fifths of the item's shingles."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_SHINGLES = """case when len(w) = 0 then [] else
  list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) end"""
OP10_SQL = f"""
with d as (select doc_id, unnest({_SHINGLES}) as s from (select doc_id, {_WORDS} as w from documents)),
  i as (select item_id, unnest({_SHINGLES}) as s from (select item_id, {_WORDS} as w from benchmark)),
  n as (select item_id, cast(count(*) as int) as n_shingles from i group by item_id),
  shared as (select doc_id, item_id, cast(count(*) as int) as n_shared from d join i using (s) group by doc_id, item_id)
select doc_id, item_id, n_shared, n_shingles from shared join n using (item_id) where 10 * n_shared >= 8 * n_shingles
"""
