"""Registry of queries and their oracle SQL, and the views both are written against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from listforge.plans.views import VIEW_SQL
from listforge.session import configure
from listforge.sources import tables as tb

NOW = datetime(2024, 1, 31)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Base tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")
        self.names = {t: f"parquet.`{self.folder}/{t}.parquet`" for t in TABLES}

    def dealt(self, name: str, rows_per_task: int = tb.ROWS_PER_TASK) -> DataFrame:
        """A table or view whose rows are dealt over tasks by number."""
        return tb.dealt(getattr(self, name), rows_per_task)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.spark.sql(VIEW_SQL[name].replace("VARCHAR(20)", "STRING").format(**self.names))


def duck(body: str, *views: str) -> str:
    """Oracle text: the views it needs as CTEs in front of it."""
    plain = {t: t for t in TABLES}
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].format(**plain)})" for v in views)
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, oracle: str | None = None, views: tuple[str, ...] | str = ()):
    """Register ``fn(tables) -> DataFrame`` and, when given, its oracle."""
    names = (views,) if isinstance(views, str) else views

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = duck(oracle, *names)
        return fn

    return wrap
