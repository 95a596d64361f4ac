"""Catalogue rows as collected from the databases, one folder per kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import schemas

KINDS = {
    "columns": schemas.PG_COLUMNS,
    "tables": schemas.PG_TABLES,
    "table_constraints": schemas.PG_TABLE_CONSTRAINTS,
    "key_column_usage": schemas.PG_KEY_COLUMN_USAGE,
    "pg_constraint": schemas.PG_CONSTRAINT,
    "pg_class": schemas.PG_CLASS,
    "pg_namespace": schemas.PG_NAMESPACE,
    "pg_attribute": schemas.PG_ATTRIBUTE,
    "pg_type": schemas.PG_TYPE,
    "pg_enum": schemas.PG_ENUM,
    "pg_indexes": schemas.PG_INDEXES,
    "triggers": schemas.PG_TRIGGERS,
    "sqlite_master": schemas.SQLITE_MASTER,
    "sqlite_columns": schemas.SQLITE_COLUMNS,
    "sqlite_foreign_keys": schemas.SQLITE_FOREIGN_KEYS,
    "sqlite_index_list": schemas.SQLITE_INDEX_LIST,
    "sqlite_index_info": schemas.SQLITE_INDEX_INFO,
}


def read_rows(spark: SparkSession, root: str, kind: str, fmt: str = "json") -> DataFrame:
    """Catalogue rows of one kind from ``root/<kind>``, with their explicit schema."""
    return spark.read.schema(KINDS[kind]).format(fmt).load(f"{root.rstrip('/')}/{kind}")


def read_live(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Catalogue rows straight from one database over JDBC."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()
