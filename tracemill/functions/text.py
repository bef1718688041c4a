"""Canonical JSON, content ids, shard keys and slugs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import SHARDS, TOOL_TEXT

ID_PREFIX = "record_"


def _hex4(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def json_string(text: Column) -> Column:
    """A JSON string in ASCII, escaped as Python's json does; null is null."""

    def escape(c: Column) -> Column:
        code = F.ascii(c)
        high = F.shiftright(code - 65536, 10) + 55296
        low = (code - 65536).bitwiseAND(1023) + 56320
        short = F.when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c == "\b", "\\b").when(c == "\f", "\\f")
        return (
            F.when(c.isin('"', "\\"), F.concat(F.lit("\\"), c))
            .when(code.between(32, 126), c)
            .otherwise(F.coalesce(short, F.when(code >= 65536, F.concat(_hex4(high), _hex4(low))).otherwise(_hex4(code))))
        )

    escaped = F.array_join(F.transform(F.split(text, ""), escape), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r'[^ -~]|["\\]'), escaped).otherwise(text), F.lit('"'))


def json_value(column: Column, quoted: bool = True) -> Column:
    return F.coalesce(json_string(column) if quoted else column.cast("string"), F.lit("null"))


def canonical_turns(turns: Column) -> Column:
    """turns: array of structs with from and value."""
    each = F.transform(turns, lambda t: F.concat(F.lit('{"from": '), json_value(t["from"]), F.lit(', "value": '), json_value(t["value"]), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))


def record_id(turns: Column, prefix: str = ID_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(canonical_turns(turns), 256), F.lit(12)))


def submission_hash(turns: Column, model_name: Column, rating: Column, tags: Column) -> Column:
    """Keys sorted, nulls written, tags sorted."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(tags), json_string), ", "), F.lit("]"))
    parts = [
        (F.lit('{"model_name": '), json_value(model_name)),
        (F.lit(', "rating": '), json_value(rating, quoted=False)),
        (F.lit(', "tags": '), F.coalesce(listed, F.lit("null"))),
        (F.lit(', "trajectory": '), canonical_turns(turns)),
    ]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*(x for pair in parts for x in pair), F.lit("}")), 256))


def shard(id_: Column, n: int = SHARDS) -> Column:
    """Two hex digits from the first byte of the id's SHA-256; over 256 shards nothing changes."""
    byte = F.conv(F.left(F.sha2(id_, 256), F.lit(2)), 16, 10).cast("int")
    return F.lpad(F.lower(F.hex(byte % n)), 2, "0")


def model_slug(name: Column) -> Column:
    s = F.regexp_replace(F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", "")), r"(?U)[\s._]+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9-]", ""), r"-+", "-"), r"^-+|-+$", "")


def record_path(model_name: Column, tier: Column, id_: Column) -> Column:
    """data/{slug}/{tier}/shard_{xx}.jsonl; no usable name is `unknown`, no tier is `review_needed`."""
    slug = F.coalesce(F.nullif(model_slug(model_name), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("data/"), slug, F.lit("/"), F.coalesce(F.nullif(tier, F.lit("")), F.lit("review_needed")), F.lit("/shard_"), shard(id_), F.lit(".jsonl"))


def tool_text(text: Column) -> Column:
    return F.left(text, F.lit(TOOL_TEXT))


def split_tags(text: Column) -> Column:
    """Comma-separated tags without blanks around them; empty ones go."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def byte_label(n: Column) -> Column:
    """B, KB or MB, the latter two with one decimal, halves to the even one."""
    in_units = lambda size: F.bround(n.cast("decimal(20,0)") / F.lit(size), 1).cast("decimal(21,1)").cast("string")
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(in_units(1024), F.lit(" KB"))).otherwise(F.concat(in_units(1024 * 1024), F.lit(" MB")))


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def redaction_markers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[REDACTED_\w+\]"), F.lit(0))
