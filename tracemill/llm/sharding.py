"""Sharding by rendezvous hashing of stable record keys over weighted shards, with DataFrame functions only."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A prime below 2^31, so that products stay in a long.
PRIME = (1 << 31) - 1
#: Parts into which each shard is cut to number its rows.
PARTS = 1024


def _shard_salt(shard: int) -> int:
    return int(hashlib.md5(f"shard {shard}".encode()).hexdigest()[:8], 16) % PRIME


def _digits(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % PRIME


def key_digest(key: Column) -> Column:
    """MD5 of the key's text in hex, a null key as the empty text; computed once a row, and cheap arithmetic follows for each shard."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def rendezvous(digest: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, whose score -ln(u) / weight is smallest; ties go to the lower shard.

    u depends on the key and that shard alone. A new shard thus takes rows only for itself, a removed one hands its
    rows to all others, and a shard gets rows in proportion to its weight.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights are positive, one for each shard")
    u, v = _digits(digest, 1), _digits(digest, 9)
    scores = []
    for shard, weight in enumerate(weights):
        t = (u.bitwiseXOR(F.lit(_shard_salt(shard)).cast("long")) * F.lit(48271)) % PRIME
        point = (t * t + v * (shard + 1)) % PRIME
        scores.append(F.struct((-F.log((point + 0.5) / PRIME) / float(weight)).alias("score"), F.lit(shard).alias("shard")))
    return F.least(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def assign(docs: DataFrame, n_shards: int, weights: Sequence[float] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs.

    shard follows from doc_id and the shards alone (law `key`); grown_shard is that with one more shard of weight 1.
    slot numbers the rows of a shard from 0 without gaps. size: bytes of the text and 1; a null text has none, and the
    CRC of no bytes, 0. Rows without doc_id go to the shard of the empty key. Rows of one doc_id share a shard;
    fully equal rows get different slots. An empty table gives no rows. Other columns are not read.

    The rows of a shard are never sorted in one task: each shard is cut into PARTS parts by the hashes of key and text (rows
    that share a doc_id, or have none, are in one shard), parts are counted first, and a row's slot is its part's offset
    plus its number in the part. The
    table of counts has at most shards * PARTS rows, whatever the input.
    """
    weights = list(weights or [1.0] * n_shards)
    placed = docs.withColumn("_digest", key_digest(F.col("doc_id"))).select(
        "doc_id",
        F.coalesce(F.octet_length("text") + 1, F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(F.col("_digest"), weights).alias("shard"),
        rendezvous(F.col("_digest"), [*weights, 1.0]).alias("grown_shard"),
        _digits(F.col("_digest"), 17).alias("part"),
    ).withColumn("part", F.col("part").bitwiseXOR(F.col("text_crc32")) % PARTS)
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    ahead = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("offset"))
    number = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    rows = placed.withColumn("number", number).join(offsets, ["shard", "part"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("number") - 1).alias("slot"), "grown_shard")


def _sql_shard(n: int) -> str:
    points = ", ".join(f"(((xor(u, {_shard_salt(s)}) * 48271) % {PRIME}) * ((xor(u, {_shard_salt(s)}) * 48271) % {PRIME}) + v * {s + 1}) % {PRIME}" for s in range(n))
    return f"list_position([{points}], list_max([{points}])) - 1"


#: With equal weights the smallest -ln(u) is the largest u. The CRC is that of polynomial 0xEDB88320, a byte at a time.
ORACLE = f"""
with crc_table as (
  select list(c order by i) as tab from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as i))),
keyed as (
  select doc_id, text, md5(coalesce(doc_id::varchar, '')) as digest from documents),
placed as (
  select doc_id, text,
         ('0x' || substr(digest, 1, 8))::bigint % {PRIME} as u, ('0x' || substr(digest, 9, 8))::bigint % {PRIME} as v,
         ('0x' || substr(digest, 17, 8))::bigint % {PRIME} as by_key
  from keyed),
sized as (
  select doc_id, by_key, octet_length(encode(coalesce(text, '')))::bigint + 1 as size,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(coalesce(text, ''))) + 1), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i - 1, 2))::bigint)),
                         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32,
         ({_sql_shard(16)})::int as shard, ({_sql_shard(17)})::int as grown_shard
  from placed cross join crc_table),
parted as (select *, xor(by_key, text_crc32) % {PARTS} as part from sized)
select doc_id, size, text_crc32, 'key' as law, shard,
       row_number() over (partition by shard order by part, doc_id, text_crc32, size) - 1 as slot, grown_shard
from parted
"""
