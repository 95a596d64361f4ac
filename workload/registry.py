"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload import inputs as ip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Databases whose catalogue rows one task makes.
DEALT = 10_000
#: Shuffled bytes that Spark may put together for one task. Catalogue rows repeat each other, so they
#: take many times as much memory as they take in a shuffle, where they are compressed.
SHUFFLED = "16m"


class Source:
    """The derived data sets of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self.dialect = ip.SparkDialect(self.view, self.dealt)
        self._tables: dict[str, DataFrame] = {}
        self._views: set[str] = set()
        self._dealt: set[str] = set()

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def view(self, name: str) -> str:
        """The table under a name SQL can use; its schema is read once per query."""
        view = f"given_{name}"
        if name not in self._views:
            self.table(name).createOrReplaceTempView(view)
            self._views.add(name)
        return view

    def dealt(self, name: str) -> str:
        """The same dealt over tasks: one row group becomes dozens of rows per row, and files
        are split by their bytes only."""
        view = f"dealt_{name}"
        if name not in self._dealt:
            rows = self.table(name)
            rows.repartition(-(-rows.count() // DEALT) or 1).createOrReplaceTempView(view)
            self._dealt.add(name)
        return view

    def __getattr__(self, name: str):
        recipe = getattr(ip, name)
        return lambda *a, **k: self.spark.sql(recipe(self.dialect, *a, **k))


def query(name: str, oracle: str | None = None):
    """Register ``fn(src)`` under ``name``, with the DuckDB text that must agree."""

    def add(fn: Callable[[Source], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLED)
            return fn(Source(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def with_(_tail: str, **ctes: str) -> str:
    """``WITH`` clause over DuckDB recipes, in the order given."""
    parts = ", ".join(f"{n} AS ({sql})" for n, sql in ctes.items())
    return ip.duck(f"WITH {parts} {_tail}")


def duck(recipe: str, *args, **kwargs) -> str:
    return getattr(ip, recipe)(ip.DUCK, *args, **kwargs)

