"""Type contracts: the shape in which consumers receive each table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import types
from tidemark.functions.text import pascal_case, property_name, quoted
from tidemark.operators.keyed import attach

# The forms of a generated declaration.
JSON_ALIAS = (
    "export type Json = { [key: string]: Json } | Json[] | string | number | boolean | null;"
)
ENUM_FORM = "export type %s = %s;"
TABLE_FORM = "export interface %s {\n%s}"
LINE_FORM = "  %s: %s;\n"


def pg_contract_columns(columns: DataFrame, enum_labels: DataFrame) -> DataFrame:
    """Columns with the type consumers see; enum types by their own names."""
    names = enum_labels.select("db_id", F.col("enum_name").alias("_element")).dropDuplicates()
    typed = names.withColumn("_enum_type", pascal_case(F.col("_element")))
    element = types.pg_element(F.col("data_type"), F.col("udt_name"))
    return (
        columns.withColumn("_element", element)
        .transform(attach, typed, ["db_id", "_element"], large=True)
        .withColumn("wire_type", types.pg_wire(F.col("data_type"), F.col("_element"), F.col("_enum_type")))
        .drop("_element", "_enum_type")
    )


def sqlite_contract_columns(columns: DataFrame) -> DataFrame:
    return columns.withColumn("wire_type", types.sqlite_wire(F.col("data_type")))


def _kept(columns: DataFrame, ledger_table: str) -> DataFrame:
    return columns.where(F.col("table_name") != ledger_table)


def contract_rows(columns: DataFrame, enum_labels: DataFrame | None, ledger_table: str) -> DataFrame:
    """Declarations as rows: db_id, kind (alias, enum, table, member), name, text.

    ``member`` rows are the lines of the aggregate that lists every table.  The alias
    appears only where some column needs it.  Lines of tables, labels of enums and marks of
    the alias are grouped together, in one shuffle.
    """
    shown = F.when(F.col("nullable"), F.concat("wire_type", F.lit(" | null"))).otherwise(
        F.col("wire_type")
    )
    line = F.format_string(LINE_FORM, property_name(F.col("column_name")), shown)

    def part(kind: str, name: Column, order: Column | None = None, tie: Column | None = None, text: Column | None = None) -> Column:
        shape = "struct<o: double, tie: string, text: string>"
        own = F.lit(None) if text is None else F.struct(order.cast("double").alias("o"), tie.alias("tie"), text.alias("text"))
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), own.cast(shape).alias("part"))

    needs = F.col("wire_type").isin("Json", "Json[]")
    pieces = F.array(
        part("table", F.col("table_name"), F.col("position"), line, line),
        F.when(needs, part("alias", F.lit("Json"))),
    )
    rows = _kept(columns, ledger_table).select("db_id", F.inline(F.array_compact(pieces)))
    if enum_labels is not None:
        label = part("enum", F.col("enum_name"), F.col("label_order"), F.col("label"), quoted(F.col("label")))
        rows = rows.unionByName(enum_labels.select("db_id", F.inline(F.array(label))))
    texts = F.transform(F.sort_array(F.collect_list("part")), lambda x: x["text"])
    grouped = rows.groupBy("db_id", "kind", "name").agg(texts.alias("_t"))
    title, kind = pascal_case(F.col("name")), F.col("kind")
    text = (
        F.when(kind == "table", F.format_string(TABLE_FORM, title, F.array_join("_t", "")))
        .when(kind == "enum", F.format_string(ENUM_FORM, title, F.array_join("_t", " | ")))
        .otherwise(JSON_ALIAS)
    )
    member = F.format_string("  %s: %s;", property_name(F.col("name")), title)
    declared = F.array(
        F.struct(kind.alias("kind"), text.alias("text")),
        F.when(kind == "table", F.struct(F.lit("member").alias("kind"), member.alias("text"))),
    )
    out = grouped.select("db_id", "name", F.inline(F.array_compact(declared)))
    return out.select("db_id", "kind", "name", "text")


def contract_counts(columns: DataFrame, enum_labels: DataFrame | None, ledger_table: str) -> DataFrame:
    """Tables and enums per database that has any; no declaration is built for it."""
    table = F.lit("table").alias("kind")
    named = _kept(columns, ledger_table).select("db_id", table, F.col("table_name").alias("name"))
    if enum_labels is not None:
        named = named.unionByName(enum_labels.select("db_id", F.lit("enum").alias("kind"), F.col("enum_name").alias("name")))
    return named.distinct().groupBy("db_id").agg(
        F.count_if(F.col("kind") == "table").alias("tables"),
        F.count_if(F.col("kind") == "enum").alias("enums"),
    )
