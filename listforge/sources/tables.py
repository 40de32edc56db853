"""Reading and publishing tables.

Parquet tables have no MERGE, and a path that is being read must not be overwritten.  A new
state is written into its own version folder; a small pointer file then names the current one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listforge.session import configure, scratch_folder

LISTING_SCHEMA = (
    "id long, url string, source_id int, title string, description string, price double, currency string, "
    "location struct<latitude:double,longitude:double>, state string, city string, zip_code string, street string, "
    "contact_name string, contact_phone string, contact_email string, images array<string>, videos array<string>, "
    "documents array<string>, links array<string>, attributes map<string,string>, version int, "
    "created_at timestamp, updated_at timestamp")
RUN_SCHEMA = ("id long, source_id long, source_name string, trigger string, status string, success boolean, "
              "scraped_count int, published_count int, duration_ms long, strategy string, http_status_code int, "
              "error_message string, message string, executed_at timestamp")
QUEUE_SCHEMA = ("id long, source_name string, url string, status string, item_id long, attempts int, last_error string, "
                "last_processed_at timestamp, created_at timestamp")
OFFSET_SCHEMA = "source_name string, chat_id string, last_message_id long, updated_at timestamp"


PART = "__part"


def scan_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    configure(spark)
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet") for name in names}


ROWS_PER_TASK = 10_000


def dealt(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """A table dealt over tasks by its number of rows, for work that costs far more than reading them.  Spark splits
    files by bytes and row groups, so a million short rows can be one task, however many cores there are."""
    tasks = -(-df.count() // rows_per_task)
    return df.repartition(tasks) if tasks > 1 else df


def split(df: DataFrame, rows_per_file: int) -> DataFrame:
    """The same for rows too wide to shuffle and read several times: a table that is read in fewer tasks than there are
    cores is written once in files of so many rows.  Filters cannot move below it, as they do below a repartition."""
    spark = df.sparkSession
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    if len(held) >= spark.sparkContext.defaultParallelism or max(held, default=0) <= rows_per_file:
        return df
    folder = scratch_folder(spark, "split")
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _pointer(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_CURRENT")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def pointer(spark: SparkSession, root: str) -> dict | None:
    """What _CURRENT says: version, the version before it, and the stream and batch that wrote it."""
    fs, path = _pointer(spark, root)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current_version(spark: SparkSession, root: str) -> str | None:
    found = pointer(spark, root)
    return found and found["version"]


def _read(spark: SparkSession, root: str, schema: str, version: str | None) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{version}")


def read_table(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Current state of a versioned table; an empty frame before the first version.  A version that is
    named but gone is an error."""
    return _read(spark, root, schema, current_version(spark, root))


def has_seed(spark: SparkSession, root: str) -> bool:
    fs, _ = _pointer(spark, root)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/seed"))


def _start(spark: SparkSession, root: str, owner: str, batch_id: int) -> str | None:
    """The version a batch starts from: the current one, whoever wrote it, or the one before it when the current
    one is this very batch's (a replay).  Without a pointer the seed folder, else nothing."""
    found = pointer(spark, root)
    if found is None:
        return "seed" if has_seed(spark, root) else None
    return found["before"] if (found.get("owner"), found.get("batch")) == (owner, batch_id) else found["version"]


def state_before(spark: SparkSession, root: str, schema: str, owner: str, batch_id: int) -> DataFrame:
    """The state a batch starts from."""
    return _read(spark, root, schema, _start(spark, root, owner, batch_id))


def _move_pointer(spark: SparkSession, root: str, state: dict) -> None:
    """Write the pointer beside its place and rename it over it, so a reader sees the old state or the new one."""
    fs, path = _pointer(spark, root)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_CURRENT.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(state), "utf-8"))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(path), options)


def publish(df: DataFrame, root: str, version: str, partition_by: list[str] | None = None, owner: str | None = None, batch_id: int | None = None) -> None:
    """Write a version and make it current.

    The pointer moves when the data is complete.  A replayed batch writes its version again.  Versions
    older than the one before go, so that a stream keeps two."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root.rstrip('/')}/{version}")
    spark, root = df.sparkSession, root.rstrip("/")
    found = pointer(spark, root)
    if found is None:
        before = "seed" if has_seed(spark, root) else None
    else:
        before = found["before"] if found["version"] == version else found["version"]
    _move_pointer(spark, root, {"version": version, "before": before, "owner": owner, "batch": batch_id})
    fs, _ = _pointer(spark, root)
    for old in {found["version"], found["before"]} - {version, before, "seed", None} if found else ():
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{old}"), True)


def read_evolved_schema(layouts: list[DataFrame], schema: str, defaults: dict[str, object],
                        renamed: dict[str, str] | None = None, dropped: tuple[str, ...] = ()) -> DataFrame:
    """Old layouts read as the current one: columns renamed, retired ones dropped, missing ones
    added with their default, and types brought to the current schema."""
    aligned = []
    for df in layouts:
        for old, new in (renamed or {}).items():
            if old in df.columns and new not in df.columns:
                df = df.withColumnRenamed(old, new)
        aligned.append(df.drop(*dropped))
    union = aligned[0]
    for df in aligned[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    spark = union.sparkSession
    fields = spark.createDataFrame([], schema).dtypes
    out: list[Column] = []
    for name, kind in fields:
        value = F.col(name) if name in union.columns else F.lit(None)
        value = value.cast(kind)
        out.append((F.coalesce(value, F.lit(defaults[name]).cast(kind)) if name in defaults else value).alias(name))
    return union.select(*out)


def append_run_history(runs: DataFrame, path: str, batch: str) -> None:
    """History rows of one named batch, by day of the run; the same batch again replaces itself."""
    out = run_history_rows(runs).withColumn("day", F.to_date("executed_at"))
    out.write.mode("overwrite").partitionBy("day").parquet(f"{path.rstrip('/')}/batch={batch}")


def run_history_rows(runs: DataFrame) -> DataFrame:
    """Rows as the history keeps them: a blank trigger means scheduled."""
    name = "trigger_kind" if "trigger_kind" in runs.columns else "trigger"
    return runs.withColumn(name, F.coalesce(F.nullif(F.lower(F.trim(name)), F.lit("")), F.lit("scheduled")))


def save_offsets(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Offsets after a batch: the greatest id per (source, chat), so a replay never moves back."""
    both = stored.select("source_name", "chat_id", "last_message_id").unionByName(
        seen.select("source_name", "chat_id", "last_message_id"))
    return both.groupBy("source_name", "chat_id").agg(F.max("last_message_id").alias("last_message_id"))


def chat_messages_since(messages: DataFrame, offsets: DataFrame, lookback: int) -> DataFrame:
    """Messages above the stored offset, the newest `lookback` of every chat, oldest first.  A chat is
    named by source and id, where both sides have the source.

    The cut is a rank of distinct ids per chat; Spark filters it before the shuffle (each task
    keeps at most `lookback` rows per chat), so a very busy chat is reduced map-side."""
    from pyspark.sql import Window

    keys = [c for c in ("source_name", "chat_id") if c in messages.columns and c in offsets.columns]
    marks = offsets.groupBy(*keys).agg(F.max("last_message_id").alias("last_message_id"))
    fresh = messages.join(marks, keys, "left").where(
        F.col("last_message_id").isNull() | (F.col("message_id") > F.col("last_message_id"))).drop("last_message_id")
    newest = Window.partitionBy(*keys).orderBy(F.col("message_id").desc())
    return fresh.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= lookback).drop("rn")


def envelope_json(listings: DataFrame, category: str) -> DataFrame:
    """Listing -> nested contract document with every field, absent ones as null; a null location is
    written as an empty object."""
    kinds = {"price": "double"} | {n: "array<string>" for n in ("images", "videos", "documents", "links")} | {"attributes": "map<string,string>"}
    body = [(F.col(c) if c in listings.columns else F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in (
        "title", "description", "price", "currency", "state", "city", "zip_code", "street", "contact_name", "contact_phone", "contact_email",
        "images", "videos", "documents", "links", "attributes")]
    category_id = F.col("category_id") if "category_id" in listings.columns else F.lit(0)
    point = F.create_map(F.lit("latitude"), F.col("location.latitude"), F.lit("longitude"), F.col("location.longitude"))
    location = F.when(F.col("location").isNotNull(), point).otherwise(F.create_map().cast("map<string,double>"))
    document = F.struct(
        F.col("url"), F.struct(F.col("source_id").alias("id"), F.col("source_name").alias("name")).alias("source"),
        F.struct(category_id.alias("id"), F.lit(category).alias("name")).alias("category"),
        F.struct(*body, location.alias("location")).alias("scraped_data"))
    return listings.select("id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))
