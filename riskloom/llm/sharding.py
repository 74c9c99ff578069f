"""Sharding by weighted rendezvous hashing.

Every (record key, shard) pair has a hash; a record goes to the shard with the
greatest ``weight / -ln(hash)``. Adding a shard only adds one more candidate per
record, so rows move into the new shard or stay where they are.

A row's slot in its shard comes from counts, not from sorting a shard in one task:
each shard is cut into buckets by the key's hash, counts are summed up to offsets
of buckets, keys and parts of a key, and rows are numbered inside the last of
these. A key that is repeated in a third of all rows is numbered per part of the
input, so no task gets all of its rows.

Defined cases: a null key is a key of its own; a null text has size 8 and the
CRC of no bytes (0); repeated rows share a shard and get slots of their own;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import only, table
from riskloom.sources.staging import stage

#: Bytes that a record takes besides its text.
RECORD_BYTES = 8
#: Buckets that a shard's rows are numbered in.
SLOT_BUCKETS = 1024
SHARDS = 24


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """Greatest wins; 52 bits of MD5 are a fraction strictly between 0 and 1."""
    digits = F.substring(F.md5(F.concat_ws("/", key, shard.cast("string"))), 1, 13)
    fraction = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return weight / -F.log(fraction)


def choose_shard(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that ``key`` goes to; equal scores go to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    shards = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in enumerate(weights)])
    scores = F.transform(
        shards, lambda s: F.struct(_score(key, s["shard"], s["weight"]).alias("score"), (-s["shard"]).alias("minus"))
    )
    return -F.array_max(scores)["minus"]


def number_slots(rows: DataFrame, shard: str, key: str, bucket: str, part: str) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard. ``part`` splits the rows of a repeated key."""
    unit = [shard, bucket, key, part]
    counts = stage(rows.groupBy(*unit).agg(F.count("*").alias("__n")), "slot-counts")
    in_bucket = Window.partitionBy(shard, bucket).orderBy(key, part).rowsBetween(Window.unboundedPreceding, -1)
    in_shard = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy(shard, bucket).agg(F.sum("__n").alias("__all"))
    buckets = buckets.select(shard, bucket, F.coalesce(F.sum("__all").over(in_shard), F.lit(0)).alias("__before"))
    units = counts.withColumn("__ahead", F.coalesce(F.sum("__n").over(in_bucket), F.lit(0))).join(buckets, [shard, bucket])
    units = stage(units.select(*unit, (F.col("__before") + F.col("__ahead")).alias("__offset")), "slot-offsets")
    alike = [rows[c].eqNullSafe(units[c]) for c in unit]
    joined = rows.join(units, on=alike[0] & alike[1] & alike[2] & alike[3]).select(*[rows[c] for c in rows.columns], units["__offset"])
    numbered = F.row_number().over(Window.partitionBy(*unit).orderBy(*[c for c in rows.columns if c not in unit]))
    return joined.withColumn("slot", (F.col("__offset") + numbered - 1).cast("bigint")).drop("__offset")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """One row per document: size, checksum, shard, slot, and the shard it would have with one more."""
    docs = only(docs, doc_id="bigint", text="string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    content = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(content) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(content).cast("bigint").alias("text_crc32"),
        choose_shard(key, weights).alias("shard"),
        choose_shard(key, [*weights, grown_weight]).alias("grown_shard"),
        F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint").alias("bucket"),
        F.spark_partition_id().alias("part"),
    ).withColumn("bucket", F.col("bucket") % SLOT_BUCKETS)
    rows = number_slots(stage(placed, "placed"), "shard", "doc_id", "bucket", "part")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot",
        F.col("grown_shard").cast("int"),
    )


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


#: The CRC-32 of a text's bytes by the usual 256-entry table, which DuckDB lacks a function for.
OP3_SQL = """
with crc as (
  select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as steps
), keyed as (
  select doc_id, coalesce(cast(doc_id as varchar), 'null') as k, hex(encode(coalesce(text, ''))) as h from documents
), scored as (
  select doc_id, s.range as shard,
    1.0 / -ln((cast('0x' || substr(md5(k || '/' || s.range), 1, 13) as bigint) + 0.5) / 4503599627370496.0) as score
  from keyed cross join range(25) s
), chosen as (
  select doc_id, arg_max(shard, score) filter (shard < 24) as shard, arg_max(shard, score) as grown_shard
  from scored group by doc_id
)
select doc_id, length(h) // 2 + 8 as size,
  xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2),
    lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32,
  'key' as law, cast(shard as int) as shard,
  row_number() over (partition by shard order by cast('0x' || substr(md5(k), 1, 8) as bigint) % 1024, doc_id) - 1 as slot,
  cast(grown_shard as int) as grown_shard
from keyed join chosen using (doc_id) cross join crc
"""
