"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Words are dealt in blocks of equal size. Sources get whole numbers of blocks by highest quotients target / (2 k + 1);
within a source its documents are spread by a seeded hash over shards of bounded size, and the source's blocks go to
its shards by highest quotients again. Within a shard the documents stand in seeded order, and the shard's quota is
taken from the start of that line, which is read again from the start when it ends. No step needs one task for a
source's documents: only tables with a row per source, or per shard of one source, are sorted in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, Scratch

#: Words in a block; documents in a shard, about; the most often a source or document is repeated.
BLOCK, SHARD_DOCS, REPEATS = 32, 2048, 3


def _key(source: Column) -> Column:
    """A source as text that is never null and keeps null apart; sorts as the source does, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sources: DataFrame) -> DataFrame:
    """sources(source_key, source_size) -> the same with target: weights 1, 2, 3, repeating, of all words, at most REPEATS times a source's size.

    With sources in order of cap / weight, the first k are at their caps, k the first for which the rest, shared by
    weight, leaves no other above its cap: the state in which resharing the excess again and again ends.
    """
    sources = sources.withColumn("weight", (F.row_number().over(W.orderBy("source_key")) - 1) % 3 + 1)
    sources = sources.withColumn("cap", REPEATS * F.col("source_size"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    ranked = sources.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    left, among = F.col("total") - F.col("cap_before"), F.col("weights") - F.col("weight_before")
    ranked = ranked.withColumn("under", left * F.col("weight") <= F.col("cap") * among)  # this one and all after it are below their caps
    first = F.min(F.when(F.col("under"), F.struct(F.col("cap") / F.col("weight"), "source_key", left.alias("left"), among.alias("among")))).over(everything)
    ranked = ranked.withColumn("first", first)
    at_cap = F.col("first").isNull() | (F.struct(F.col("cap") / F.col("weight"), "source_key") < F.struct(F.col("first")[F.lit("col1")], F.col("first")["source_key"]))
    share = (F.col("first")["left"] * F.col("weight")).cast("double") / F.col("first")["among"]
    return ranked.select("source_key", "source_size", "weight", F.when(at_cap, F.col("cap").cast("double")).otherwise(share).alias("target"))


def sainte_lague(parties: DataFrame, weight: str, seats: str, within: list[str], order: str, to: str) -> DataFrame:
    """Adds column `to`: whole seats by highest quotients weight / (2 k + 1) among the rows that share `within`; ties go to the smaller `order`.

    If s parties share n seats, the divisor that rounds to n seats lies so that a share p gets at least
    p (n - s / 2) - 1 / 2 and at most p (n + s / 2) + 1 / 2 of them. Only quotients between these bounds, about three
    a party, are listed and ranked; those below are granted.
    """
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    n, s = F.col(seats).cast("double"), F.count(F.lit(1)).over(group).cast("double")
    share = F.coalesce(F.col(weight) / F.nullif(F.sum(weight).over(group), F.lit(0.0)), F.lit(0.0))
    bounded = parties.withColumn("_share", share).withColumn("_s", s)
    low = F.greatest(F.lit(0), F.floor(F.col("_share") * (n - F.col("_s") / 2) - 0.5)).cast("long")
    high = F.greatest(low, F.ceil(F.col("_share") * (n + F.col("_s") / 2) + 0.5).cast("long"))
    bounded = bounded.withColumn("_low", low).withColumn("_high", high).withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    listed = bounded.withColumn("_k", F.explode(F.sequence("_low", "_high")))
    best = group.orderBy(F.desc(F.col(weight) / (2 * F.col("_k") + 1)), order, "_k")
    won = listed.withColumn("_won", (F.row_number().over(best) <= F.col("_left")) & (F.col(weight) > 0))
    return won.groupBy(*parties.columns).agg((F.min("_low") + F.sum(F.col("_won").cast("long"))).alias(to))


def mix(docs: DataFrame, seed: str = "0", block: int = BLOCK, shard_docs: int = SHARD_DOCS, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, source, ...) -> (doc_id, *carry, size, source_size, target, taken), one row for each row of docs.

    size counts the words of the text, 0 for null or empty texts; taken is how many of them the mix takes, repeats
    counted, at most REPEATS times size. All documents take part, also those without source (a source of its own,
    last in order) or doc_id. Equal rows are interchangeable. Rows of empty sources, and those of a table without
    words, take 0. An empty table gives no rows. Reruns agree: only doc_id, source, text and seed decide; rows that share
    a doc_id, or have none, are spread by their texts.
    """
    scratch = Scratch(docs.sparkSession)
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    sizes = docs.select(
        "doc_id",
        *carry,
        _key(F.col("source")).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        digest.alias("place"),
    )
    sizes = scratch.save(sizes, "sizes")
    sources = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = scratch.save(sources, "sources")
    quotas = targets(sources).withColumn("seats", F.round(F.sum("source_size").over(W.partitionBy(F.lit(0))) / block).cast("long"))
    quotas = sainte_lague(quotas, "target", "seats", [], "source_key", "source_blocks")
    quotas = quotas.join(sources.select("source_key", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_docs)).cast("long").alias("n_shards")), "source_key")
    quotas = scratch.save(quotas, "quotas")  # a row per source

    shard = F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), F.col("n_shards"))
    placed = sizes.join(quotas.select("source_key", "n_shards"), "source_key").withColumn("shard", shard).drop("n_shards")
    shards = placed.groupBy("source_key", "shard").agg(F.sum("size").cast("double").alias("shard_size"))
    shards = shards.join(quotas.select("source_key", "source_size", "target", "source_blocks"), "source_key")
    shards = sainte_lague(shards, "shard_size", "source_blocks", ["source_key"], "shard", "blocks")
    # the last block of a source that is taken whole REPEATS times is cut at its end
    words = F.least(F.col("blocks") * block, REPEATS * F.col("shard_size").cast("long"))
    shards = shards.select("source_key", "shard", "source_size", "target", F.col("shard_size").cast("long").alias("shard_size"), words.alias("quota"))

    line = W.partitionBy("source_key", "shard").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    full = F.coalesce(F.floor(F.col("quota") / F.nullif(F.col("shard_size"), F.lit(0))), F.lit(0)).cast("long")
    rest = F.col("quota") - full * F.col("shard_size")
    taken = full * F.col("size") + F.least("size", F.greatest(F.lit(0), rest - F.coalesce(F.sum("size").over(line), F.lit(0))))
    return placed.join(shards, ["source_key", "shard"]).select("doc_id", *carry, "size", "source_size", "target", taken.alias("taken"))


ORACLE = """
with sizes as (
  select doc_id, coalesce('0' || source, '1') as source_key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('0|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))) as place
  from documents),
sources as (
  select source_key, sum(size)::bigint as source_size, greatest(1, ceil(count(*) / 2048.0))::bigint as n_shards from sizes group by 1),
weighed as (
  select *, (row_number() over (order by source_key) - 1) % 3 + 1 as weight, 3 * source_size as cap, sum(source_size) over ()::bigint as total from sources),
ranked as (
  select *, total - coalesce(sum(cap) over before, 0)::bigint as rest, sum(weight) over ()::bigint - coalesce(sum(weight) over before, 0)::bigint as among,
         row_number() over (order by cap / weight, source_key) as r
  from weighed window before as (order by cap / weight, source_key rows between unbounded preceding and 1 preceding)),
pivot_at as (select min(r) as r0 from ranked where rest * weight <= cap * among),
aimed as (
  select a.source_key, a.source_size, a.n_shards, a.total,
         case when p.r0 is null or a.r < p.r0 then a.cap::double else (b.rest * a.weight)::double / b.among end as target
  from ranked a cross join pivot_at p left join ranked b on b.r = p.r0),
quotients as (
  select source_key, target / (2 * k + 1) as q, k, (select round(max(total) / 32.0)::bigint from aimed) as seats
  from (select source_key, target, unnest(range(0, (target / 32)::bigint + 40)) as k from aimed) where target > 0),
source_won as (
  select source_key, count(*) as blocks from (select *, row_number() over (order by q desc, source_key, k) as r from quotients) where r <= seats group by 1),
placed as (
  select s.*, a.source_size, a.target, ('0x' || substr(place, 1, 8))::bigint % n_shards as shard from sizes s join aimed a using (source_key)),
shards as (
  select source_key, shard, sum(size)::bigint as shard_size from placed group by 1, 2),
shard_quotients as (
  select source_key, shard, shard_size / (2 * k + 1)::double as q, k, blocks
  from (select h.source_key, shard, shard_size, blocks, unnest(range(0, (3 * shard_size / 32)::bigint + 40)) as k from shards h join source_won using (source_key))
  where shard_size > 0),
shard_won as (
  select source_key, shard, count(*) as blocks
  from (select *, row_number() over (partition by source_key order by q desc, shard, k) as r from shard_quotients) where r <= blocks group by 1, 2),
quotas as (
  select source_key, shard, shard_size, least(coalesce(blocks, 0) * 32, 3 * shard_size) as quota from shards left join shard_won using (source_key, shard)),
lined as (
  select p.*, q.shard_size, q.quota,
         coalesce(sum(size) over (partition by source_key, shard order by place, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as ahead
  from placed p join quotas q using (source_key, shard)),
dealt as (
  select *, case when shard_size > 0 then quota // shard_size else 0 end as whole from lined)
select doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, quota - whole * shard_size - ahead)))::bigint as taken
from dealt
"""
