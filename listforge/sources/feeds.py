"""JSON, RSS and paged-API feeds -> rows.

Feeds arrive either as files or as a raw table with one body per fetch; both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

JSON_FEED_SCHEMA = ("id string, url string, company string, position string, description string, location string, "
                    "salary_min double, salary_max double, apply_url string, tags array<string>")
RSS_SCHEMA = "title string, link string, category string, pubDate string, region string, description string"


def _with_id(rows: DataFrame) -> DataFrame:
    """The legal header element of a feed has no id."""
    return rows.where("id <> ''")


def read_json_feed(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one JSON array each; a broken file gives no rows."""
    return _with_id(spark.read.schema(JSON_FEED_SCHEMA).option("multiLine", True).json(path))


def parse_json_feed(raw: DataFrame, body: str = "body") -> DataFrame:
    """Bodies of a raw table; a broken body gives no rows."""
    return _with_id(raw.select(F.inline(F.from_json(body, f"array<struct<{_typed(JSON_FEED_SCHEMA)}>>"))))


def read_rss_feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS items; a file that is not XML gives no rows."""
    items = spark.read.format("xml").schema(RSS_SCHEMA).option("rowTag", "item").option("mode", "DROPMALFORMED").load(path)
    return items.withColumnRenamed("pubDate", "pub_date")


def parse_rss_feed(raw: DataFrame, body: str = "body") -> DataFrame:
    schema = f"struct<channel: struct<item: array<struct<{_typed(RSS_SCHEMA)}>>>>"
    items = raw.select(F.inline(F.from_xml(body, schema, {"mode": "PERMISSIVE"})["channel"]["item"]))
    return items.withColumnRenamed("pubDate", "pub_date")


def read_paged_api(spark: SparkSession, path: str, entry_schema: str, field: str = "data") -> DataFrame:
    """Files with one page {field: [...], ...} each -> one row per entry."""
    return parse_paged_api(spark.read.option("wholetext", True).text(path), entry_schema, field, "value")


def parse_paged_api(raw: DataFrame, entry_schema: str, field: str = "data", body: str = "body") -> DataFrame:
    """Pages of a raw table; entries that are not objects are dropped."""
    entries = F.try_variant_get(F.try_parse_json(body), f"$.{field}", "array<variant>")
    objects = raw.select(F.explode(entries).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    # inline is a generator: the entry is parsed once, not once per field that is read from it
    return objects.select(F.inline(F.array(F.from_json(F.to_json("v"), entry_schema))))


def _typed(schema: str) -> str:
    """'a int, b string' -> 'a: int, b: string'."""
    return ", ".join(": ".join(part.strip().split(" ", 1)) for part in schema.split(", "))
