"""A Merkle manifest of a dataset: higher-order functions over ordered blocks of leaves collapse several levels at once.

Leaves of one tree are numbered by a range sort, so that a block of consecutive ones is a group. Each block is an array of
fixed size; `sequence`, `transform`, `slice` and `aggregate` collapse LEVELS levels of it, and the roots of all blocks are
the nodes of the same thing again, until one is left in each tree. Only digests move: texts are hashed where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Scratch

FAN = 8
#: Levels that one block collapses: FAN ** LEVELS nodes, an array of a few tens of kilobytes.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes of a text."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as its byte count, a colon and itself, so that no two rows run together; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """The digest of a row of documents, with `text` in place of its own text."""
    return digest(F.concat(*(field(text if name == "text" else F.col(name)) for name in fields)))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """A-Z in lower case where 3 divides the CRC of the decimal doc_id; a null doc_id leaves the text as it is."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def numbered(nodes: DataFrame, scratch: Scratch, *order: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with `pos`, the place from 0 of each within its `tree` in the given order; `tree` and its size `n`).

    A range sort deals a tree of any size over all tasks; what precedes each task's part is added up over one row for each
    tree in each task.
    """
    # ranges are sampled from rows that are written already; their number breaks the last ties, so equal rows can be split
    rows = scratch.save(nodes.withColumn("_tie", F.monotonically_increasing_id()), "nodes")
    order = ("tree", *order, "_tie")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    ranged = scratch.save(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    scratch.drop(rows)
    parts = ranged.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy("tree").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = scratch.save(parts.withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")), "parts")
    placed = ranged.join(parts.select("tree", "_part", "_shift"), ["tree", "_part"])
    return placed.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"), parts.groupBy("tree").agg(F.sum("_rows").alias("n"))


#: The next level of an array of nodes: every FAN of them, in order, become their digest.
_UP = "transform(sequence(0, cast((size({x}) - 1) div {fan} as int)), i -> sha2(cast(array_join(slice({x}, {fan} * i + 1, {fan}), '') as binary), 256))"
#: The nodes before and after the one at {at} in its run.
_BESIDE = "struct(array_join(slice({x}, {fan} * ({at} div {fan}) + 1, {at} % {fan}), '') as l, array_join(slice({x}, {at} + 2, {fan} - 1 - {at} % {fan}), '') as r)"
PATH = "array<struct<l: string, r: string>>"


def fold(start: Column, path: Column) -> Column:
    """The root that a node and its siblings on the way up give."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["l"], node, s["r"])))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def _collapse(nodes: DataFrame, sizes: DataFrame, most: int, scratch: Scratch, carry: list[str]) -> DataFrame:
    """nodes(tree, pos, node, *carry) -> (tree, node, *carry, path, top): the siblings of each node up to the root of its tree, and that root.

    sizes(tree, n): nodes of each tree; most: the largest of these.
    """
    if most <= 1:
        return nodes.select("tree", "node", *carry, F.expr(f"cast(array() as {PATH})").alias("path"), F.col("node").alias("top"))
    block = FAN**LEVELS
    item = F.struct(F.col("pos"), "node", *carry)
    blocks = nodes.groupBy("tree", F.floor(F.col("pos") / block).cast("long").alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    blocks = blocks.join(sizes, "tree").withColumn("level0", F.expr("transform(items, x -> x.node)"))
    for level in range(LEVELS):  # a level of one node in its whole tree is that tree's root already and stays as it is
        up = _UP.format(x=f"level{level}", fan=FAN)
        blocks = blocks.withColumn(f"level{level + 1}", F.expr(f"if(n > {FAN**level}, {up}, level{level})"))
    blocks = scratch.save(blocks.withColumn("root", F.col(f"level{LEVELS}")[0]), "blocks")
    roots = blocks.select("tree", F.col("block").alias("pos"), F.col("root").alias("node"))
    above = _collapse(roots.withColumn("at", F.col("pos")), sizes.withColumn("n", F.ceil(F.col("n") / block)), -(-most // block), scratch, ["at"])
    above = above.select("tree", F.col("at").alias("block"), F.col("path").alias("above"), "top")
    own = [f"if(n > {FAN**level}, array({_BESIDE.format(x=f'level{level}', at=f'(cast(x.pos - {block} * block as int) div {FAN**level})', fan=FAN)}), cast(array() as {PATH}))" for level in range(LEVELS)]
    each = blocks.join(above, ["tree", "block"]).withColumn("x", F.explode("items"))
    return each.select("tree", "x.node", *(F.col(f"x.{c}") for c in carry), F.expr(f"concat({', '.join(own)}, above)").alias("path"), "top")


def collapse(nodes: DataFrame, scratch: Scratch, order: list[str], carry: list[str]) -> DataFrame:
    """nodes(tree, node, *order, *carry) -> (tree, node, *carry, path, top): see _collapse; leaves ascend by `order`, equal ones by node."""
    placed, sizes = numbered(nodes, scratch, *order, "node")
    sizes = scratch.save(sizes, "sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    return _collapse(placed, sizes, most, scratch, carry)


def manifest(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text, ...) -> one row for each row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A tree over the rows of each lang, in order of doc_id, and one over the trees' roots in order of lang, null first.
    proof_sha256 is the digest of all siblings on a leaf's way to the root. folded_root is the root that the row gives
    after tampering (tampered_text()) with the stored siblings; verified says whether it is the stored one.

    Nulls have a leaf value of their own, other than the empty text's. Rows of one doc_id, or without one, are leaves of
    their own, the latter first, ordered by their leaves; fully equal rows are interchangeable. Texts of any length are
    one hash. A single row is its own root and has the proof of no siblings. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # '' is null and comes first
    leaves = docs.select(
        tree.alias("tree"),
        "doc_id",
        leaf(F.col("text")).alias("node"),
        leaf(tampered_text(F.col("doc_id"), F.col("text"))).alias("_tampered"),
    )
    leaves = leaves.withColumn("_tampered", F.nullif("_tampered", F.col("node")))
    within = scratch.save(collapse(leaves, scratch, ["doc_id"], ["doc_id", "_tampered"]), "within")
    subroots = within.select("tree", "top").distinct()
    over = collapse(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), F.col("top").alias("node")), scratch, ["name"], ["name"])
    over = scratch.save(over.select(F.col("name").alias("tree"), F.col("path").alias("over"), F.col("top").alias("root")), "over")
    whole = F.concat("path", "over")
    found = within.join(over, "tree").select("doc_id", F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", digest(siblings(whole)).alias("proof_sha256"), fold(F.coalesce("_tampered", "node"), whole).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
with recursive crc_table as (
  select list(c order by i) as tab from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select unnest(range(256)) as i))),
changed as (
  select *, case when xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
                     lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0
            then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as other
  from documents cross join crc_table),
head as (
  select doc_id, text, other, coalesce('=' || lang, '') as tree,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as fields
  from changed),
leaves as (
  select tree, doc_id, row_number() over (partition by tree order by doc_id) - 1 as pos,
         sha256(fields || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(fields || coalesce(strlen(other) || ':' || other, '-')) as tampered
  from head),
levels as (
  select tree, 0 as level, list(leaf order by pos) as nodes from leaves group by tree
  union all
  select tree, level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1 : 8 * i + 8], ''))) from levels where len(nodes) > 1),
subroots as (select tree, nodes[1] as subroot, row_number() over (order by tree) - 1 as place, level as height from levels where len(nodes) = 1),
tops as (
  select 0 as level, list(subroot order by tree) as nodes from subroots
  union all
  select level + 1, list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[8 * i + 1 : 8 * i + 8], ''))) from tops where len(nodes) > 1),
root as (select nodes[1] as root from tops where len(nodes) = 1),
steps as (
  select l.doc_id, v.level, v.nodes, (l.pos // (8 ** v.level)::bigint) as spot from leaves l join levels v using (tree) where len(v.nodes) > 1
  union all
  select l.doc_id, s.height + t.level, t.nodes, (s.place // (8 ** t.level)::bigint) from leaves l join subroots s using (tree) cross join tops t where len(t.nodes) > 1),
beside as (
  select doc_id, level, array_to_string(nodes[8 * (spot // 8) + 1 : spot], '') as l, array_to_string(nodes[spot + 2 : 8 * (spot // 8) + 8], '') as r from steps),
paths as (select doc_id, list({'l': l, 'r': r} order by level) as path from beside group by doc_id),
folded as (
  select doc_id, tampered as node, 1 as step from leaves
  union all
  select f.doc_id, sha256(path[step].l || node || path[step].r), step + 1 from folded f join paths using (doc_id) where step <= len(path))
select l.doc_id, l.leaf, s.subroot, root.root, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x.l || x.r), '')) as proof_sha256,
       f.node as folded_root, f.node = root.root as verified
from leaves l join subroots s using (tree) cross join root left join paths using (doc_id)
join folded f on f.doc_id = l.doc_id and f.step = coalesce(len(path), 0) + 1
"""
