"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair has a hash u in (0, 1) and the score w / -ln(u); a record
goes to the shard of the highest score. So a record's shard follows from its key
and the shards alone, shares are in proportion to the weights, and a shard that
is added takes records only into itself. Slots number each shard's records from
0 without gaps: records are dealt by (shard, prefix of the key's hash), counted,
and numbered within each such bin from the sum of the bins before it, so no task
holds a whole shard. Texts are not shuffled.

Defined cases: a null text has no bytes (size 1, CRC 0); a null key is a key of
its own and comes back null; repeated rows go to one shard, with slots of their
own; other columns are ignored; an empty table gives no rows; shards of weight 0
get nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
#: Records of a bin, about.
BIN = 4096


def unit(key: Column, shard: int) -> Column:
    """Hash of a key and a shard as a number between 0 and 1, from 52 bits of MD5."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of the highest score; the smaller one on ties."""
    scores = [F.struct((F.lit(float(w)) / -F.ln(unit(key, i))).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return -(F.greatest(*scores) if len(scores) > 1 else scores[0])["i"]


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, grown: list[float] | None = None) -> DataFrame:
    """key, size, text_crc32, shard, slot, grown_shard (the shard under the weights ``grown``)."""
    weights = weights or [1.0] * SHARDS
    grown = grown or [*weights, 1.0]
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.md5(name).alias("order"), shard_of(name, weights).alias("shard"), shard_of(name, grown).alias("grown_shard"))
    digits, bins = 1, docs.count() // (BIN * len(weights))
    while 16**digits < bins and digits < 6:
        digits += 1
    rows = rows.withColumn("bin", F.substring("order", 1, digits))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bin").count().select("shard", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("shard", "bin").orderBy("order", "key", "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(inner) - 1)
    return numbered.join(F.broadcast(starts) if 16**digits * len(weights) <= 1 << 16 else starts, ["shard", "bin"]).select("key", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard")


def op4(spark, sf_dir: str) -> DataFrame:
    rows = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_shard(n: int) -> str:
    score = "1.0 / -ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || s::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
    return f"(SELECT arg_max(s, {score}) FROM (SELECT unnest(generate_series(0, {n - 1})) AS s))"


#: CRC-32 bit by bit for every byte value, then byte by byte over the text.
OP4_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT 0 AS step, range AS b, range::BIGINT AS v FROM range(256)
  UNION ALL
  SELECT step + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8
), tab AS (
  SELECT list(v ORDER BY b) AS t FROM bits WHERE step = 8
), d AS (
  SELECT doc_id, coalesce(text, '') AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), c AS (
  SELECT doc_id, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(0, n - 1), lambda i: ('0x' || substr(hex(encode(x)), (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS crc
  FROM d, tab
), s AS (
  SELECT doc_id, (n + 1)::BIGINT AS size, crc::BIGINT AS text_crc32, {_sql_shard(16)} AS shard, {_sql_shard(17)} AS grown_shard, md5(doc_id::VARCHAR) AS o FROM c
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY o, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INTEGER AS grown_shard FROM s
"""
