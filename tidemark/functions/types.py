"""Declared column types to the types seen by consumers of JSON rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import ascii_upper

# Postgres type names by the consumer type they arrive as.
PG_WIRE = {
    "number": ("int2", "int4", "float4", "float8", "oid"),
    "boolean": ("bool",),
    "Json": ("json", "jsonb"),
    "string": (
        "int8", "numeric", "money", "text", "varchar", "bpchar", "char", "name", "uuid", "citext", "inet", "cidr",
        "macaddr", "interval", "time", "timetz", "bit", "varbit", "xml", "tsvector", "tsquery", "point", "date",
        "timestamp", "timestamptz", "bytea",
    ),
}
# Substrings of a SQLite declaration, first hit wins.
SQLITE_WIRE = (
    ("number", ("INT",)),
    ("string", ("CHAR", "CLOB", "TEXT")),
    ("string", ("BLOB",)),
    ("number", ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")),
    ("boolean", ("BOOL",)),
    ("string", ("DATE", "TIME")),
)
UNKNOWN = "unknown"


def pg_element(data_type: Column, udt_name: Column) -> Column:
    """The type name to look up: arrays name their element with a leading underscore."""
    return F.when(data_type == "ARRAY", F.regexp_replace(udt_name, "^_", "")).otherwise(udt_name)


def pg_builtin(element: Column) -> Column:
    """Consumer type of a built-in Postgres type, null for any other name."""
    pairs = [F.lit(x) for wire, names in PG_WIRE.items() for n in names for x in (n, wire)]
    return F.try_element_at(F.create_map(*pairs), element)


def pg_wire(data_type: Column, element: Column, enum_type: Column) -> Column:
    """Consumer type given the enum's type name, if the element is an enum."""
    base = F.coalesce(pg_builtin(element), enum_type, F.lit(UNKNOWN))
    return F.when(data_type == "ARRAY", F.concat(base, F.lit("[]"))).otherwise(base)


def sqlite_wire(declared: Column) -> Column:
    """Consumer type of a SQLite declaration; a missing one counts as empty."""
    decl = ascii_upper(F.coalesce(declared, F.lit("")))
    out = F.when(decl == "", "string")
    for wire, marks in SQLITE_WIRE:
        for mark in marks:
            out = out.when(F.contains(decl, F.lit(mark)), wire)
    return out.otherwise(UNKNOWN)
