"""Rows as consumers receive them: JSON with loss-free numbers and RFC 3339 times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import exact


def wire_value(c: Column, dtype: T.DataType) -> Column:
    """One value in its consumer form; nulls stay null."""
    if isinstance(dtype, (T.LongType, T.DecimalType)):
        return c.cast("string")
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if isinstance(dtype, T.TimestampNTZType):  # a zone-free time is read as UTC
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    if isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return c.cast("string")
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: wire_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: wire_value(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        inner = [wire_value(c.getField(f.name), f.dataType).alias(f.name) for f in dtype]
        return F.when(c.isNotNull(), F.struct(*inner))
    if dtype.simpleString().startswith("time("):
        return c.cast("string")
    return c


def wire_json(c: Column) -> Column:
    """A text that holds JSON as the value it stands for; one that is no JSON stays a text."""
    as_text = F.variant_get(F.parse_json(F.to_json(F.array(c))), "$[0]", "variant")
    return F.when(c.isNotNull(), F.coalesce(F.try_parse_json(c), as_text))


def wire_row(schema: T.StructType, json_columns: Sequence[str] = ()) -> Column:
    """JSON text of a whole row, built from the table's schema; nulls are written out.

    ``json_columns`` are text columns whose values go out as JSON, not as quoted text.
    """
    fields = [
        (wire_json(exact(f.name)) if f.name in json_columns else wire_value(exact(f.name), f.dataType)).alias(f.name)
        for f in schema
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
