"""The re-fetch queue as set operations on a queue table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listforge.functions import classify as cl, urls
from listforge.operators.merge import with_row_ids


def queue_keys(df: DataFrame) -> DataFrame:
    """Normalized (source, url); rows without one of them go."""
    return df.withColumn("source_name", F.lower(F.trim("source_name"))).withColumn(
        "url", urls.norm_queue_url(F.col("url"))).where("source_name <> '' and url <> ''")


def new_requests(requests: DataFrame, queue: DataFrame) -> DataFrame:
    """First request per (source, url) that is not queued or in process already."""
    asked = queue_keys(requests)
    first = asked.groupBy("source_name", "url").agg(F.min(F.struct("pos", "item_id")).alias("f")).select(
        "source_name", "url", F.col("f.pos").alias("pos"), F.col("f.item_id").alias("item_id"))
    active = queue_keys(queue.where(F.col("status").isin("queued", "processing"))).select("source_name", "url").distinct()
    return first.join(active, ["source_name", "url"], "left_anti")


def enqueue_new(requests: DataFrame, queue: DataFrame, now: Column | None = None) -> DataFrame:
    """Distinct new queue rows.  Ids follow the greatest id of the queue in the order of the requests."""
    fresh = with_row_ids(new_requests(requests, queue), queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base")), "pos")
    return fresh.withColumns({"status": F.lit("queued"), "attempts": F.lit(0), "created_at": F.current_timestamp() if now is None else now})


def enqueue_report(requests: DataFrame, queue: DataFrame) -> DataFrame:
    """How many requests were queued and how many were duplicates."""
    zero = F.lit(0).cast("long")
    total = queue_keys(requests).agg(F.count(F.lit(1)).alias("n")).select("n", zero.alias("queued"))
    fresh = new_requests(requests, queue).agg(F.count(F.lit(1)).alias("queued")).select(zero.alias("n"), "queued")
    both = total.union(fresh).agg(F.sum("n").alias("n"), F.sum("queued").alias("queued"))
    return both.select("queued", (F.col("n") - F.col("queued")).alias("deduplicated"))


def fifo_pending(queue: DataFrame, limit: int) -> DataFrame:
    return queue.where("status = 'queued'").orderBy("created_at", "id").limit(max(1, limit))


def queue_list(queue: DataFrame, status: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    wanted = (status or "").strip().lower()
    rows = queue.where(F.col("status") == wanted) if wanted else queue
    rows = rows.orderBy(F.col("created_at").desc(), F.col("id").desc())
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def mark_processing(pending: DataFrame) -> DataFrame:
    """Rows that are being worked on: one more attempt, no error."""
    return pending.withColumns({"status": F.lit("processing"), "attempts": F.coalesce("attempts", F.lit(0)) + 1,
                                "last_error": F.lit(None).cast("string")})


def apply_deletes(listings: DataFrame, processed: DataFrame) -> DataFrame:
    """Listings without those whose queue row ended in a delete."""
    return listings.join(processed.where("delete_item").select(F.col("item_id").alias("id")), "id", "left_anti")


def process_queue(pending: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Queue rows after one tick: claimed and finished at once."""
    return finish_queue(mark_processing(pending), outcomes, now)


def finish_queue(claimed: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Claimed rows after their tick: completed, completed with a delete, or error.

    ``outcomes`` has found (an item came back), chat_missing, status_code, blocked, fetch_error and raised
    for a queue id.  Of several outcomes of one id the least counts, so that a replay changes nothing."""
    names = [c for c in outcomes.columns if c != "id"]
    single = outcomes.groupBy("id").agg(F.min(F.struct(*names)).alias("o")).select("id", "o.*")
    joined = claimed.join(single, "id", "left")
    gone = cl.item_missing(F.col("item_id"), F.col("url"), F.col("chat_missing"), F.col("status_code"), F.col("blocked"),
                           F.col("fetch_error"), F.col("raised"))
    found = F.coalesce(F.col("found"), F.lit(False)) & F.col("raised").isNull()
    status = F.when(found | gone, "completed").otherwise("error")
    message = F.coalesce(F.col("raised"), F.lit("Scraper não retornou item para a URL solicitada"))
    keep = [c for c in claimed.columns if c not in ("status", "attempts", "last_error", "last_processed_at")]
    return joined.select(
        *keep, status.alias("status"), "attempts", F.when(status == "error", F.substring(message, 1, 2000)).alias("last_error"),
        now.alias("last_processed_at"), (gone & ~found).alias("delete_item"))
