"""Records from JSON as the format's validator reads them: `"5"` and `5.0` are whole numbers too, and what can't be read is kept and named.

All leaves are parsed as text and typed one by one, so that a value of the wrong type never turns into null without a trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegralType, MapType, StringType, StructField, StructType

UNREAD = "array<struct<field: string, raw: string>>"
_WHOLE = r"^\s*([+-]?\d+)(?:\.0*)?\s*$"


def as_text(kind: DataType) -> DataType:
    """The same type with text in place of all leaves."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, as_text(f.dataType)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(as_text(kind.elementType))
    return MapType(StringType(), as_text(kind.valueType)) if isinstance(kind, MapType) else StringType()


def typed(x: Column, kind: DataType) -> Column:
    """Text leaves as `kind`; null where one can't be read."""
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*(typed(x[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda y: typed(y, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(x, lambda _, y: typed(y, kind.valueType))
    if isinstance(kind, IntegralType):
        return F.when(x.rlike(_WHOLE), F.regexp_extract(x, _WHOLE, 1).try_cast(kind))
    if isinstance(kind, BooleanType):
        low = F.lower(F.trim(x))
        return F.when(low.isin("true", "t", "yes", "y", "on", "1", "1.0"), True).when(low.isin("false", "f", "no", "n", "off", "0", "0.0"), False)
    return x if isinstance(kind, StringType) else F.trim(x).try_cast(kind)


def unread(x: Column, kind: DataType, name: str = "") -> Column:
    """(field, raw) of each leaf that has a value which can't be read as its type; places in lists aren't told apart."""
    none = F.array().cast(UNREAD)
    if isinstance(kind, StructType):
        parts = [unread(x[f.name], f.dataType, f"{name}.{f.name}".lstrip(".")) for f in kind.fields if _can_fail(f.dataType)]
        return F.when(x.isNotNull(), F.concat(none, *parts)).otherwise(none)
    if isinstance(kind, ArrayType):
        return F.coalesce(F.flatten(F.transform(x, lambda y: unread(y, kind.elementType, name))), none) if _can_fail(kind.elementType) else none
    if isinstance(kind, MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(x), lambda y: unread(y, kind.valueType, name))), none) if _can_fail(kind.valueType) else none
    return F.when(x.isNotNull() & typed(x, kind).isNull(), F.array(F.struct(F.lit(name).alias("field"), x.alias("raw")))).otherwise(none)


def _can_fail(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_can_fail(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _can_fail(kind.elementType)
    return _can_fail(kind.valueType) if isinstance(kind, MapType) else not isinstance(kind, StringType)


def parsed(df: DataFrame, ddl: str, value: str = "value") -> DataFrame:
    """df with `r`, the JSON object in `value` by the schema (null where it isn't one), and `unread`, what of it doesn't fit its type (UNREAD)."""
    kind = df.sparkSession.createDataFrame([], ddl).schema
    text = F.when(F.get_json_object(value, "$").startswith("{"), F.from_json(value, as_text(kind), {"mode": "PERMISSIVE"}))
    out = df.withColumn("_text", text)
    return out.withColumn("r", typed(F.col("_text"), kind)).withColumn("unread", unread(F.col("_text"), kind)).drop("_text")
