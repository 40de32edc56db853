"""Run-history and source roll-ups.  All of them are aggregates with a map-side part."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from listforge import fixed_values as fv
from listforge.functions import dates as dt


def _status(c: str = "status") -> Column:
    return F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))


def _extracted() -> Column:
    return F.greatest(F.coalesce(F.col("scraped_count"), F.lit(0)), F.lit(0)).cast("long")


def _failed() -> Column:
    return (_status() == "ERROR") | ~F.coalesce(F.col("success"), F.lit(False))


def recent_runs(runs: DataFrame, period: str, now: datetime, limit: int | None = None) -> DataFrame:
    """Runs since now - period, newest first; an unknown period means 30 days.  Without a limit all of them."""
    since = now - timedelta(hours=fv.RUN_PERIOD_HOURS.get((period or "").strip().lower(), 720))
    found = runs.where(F.col("executed_at") >= F.lit(since)).orderBy(F.col("executed_at").desc(), F.col("id").desc())
    return found if limit is None else found.limit(limit)


def runs_by_day(runs: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    """Extracted items, runs and failures per local day, today and the days before, zero-filled.

    The time bound is on the stored column, so the scan prunes; only `days` rows leave the
    aggregate, and the day list (one row per day) is the driving side of the join."""
    spark = runs.sparkSession
    today = dt.local_day(F.lit(now))
    calendar = spark.range(days).select(F.date_sub(today, (F.lit(days - 1) - F.col("id")).cast("int")).alias("day"))
    recent = runs.where(F.col("executed_at") >= F.lit(now - timedelta(days=days + 1)))
    per_day = recent.groupBy(dt.local_day(F.col("executed_at")).alias("day")).agg(
        F.sum(_extracted()).alias("extracted"), F.count(F.lit(1)).alias("runs"), F.count_if(_failed()).alias("failures"))
    zero = F.lit(0).cast("long")
    return calendar.join(per_day, "day", "left").select(
        "day", F.date_format("day", "dd/MM").alias("label"),
        *[F.coalesce(c, zero).alias(c) for c in ("extracted", "runs", "failures")])


def extracted_today(runs: DataFrame, now: datetime) -> DataFrame:
    same_day = dt.local_day(F.col("executed_at")) == dt.local_day(F.lit(now))
    recent = runs.where(F.col("executed_at").between(F.lit(now - timedelta(days=1)), F.lit(now + timedelta(days=1))) & same_day)
    return recent.agg(F.coalesce(F.sum(_extracted()), F.lit(0).cast("long")).alias("extracted"))


def failures_in_range(runs: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    return runs_by_day(runs, now, days).agg(F.sum("failures").alias("failures"))


def source_totals(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count_if("enabled").alias("active"), F.count(F.lit(1)).alias("total"))


def recent_status_tally(runs: DataFrame, newest: int = 8) -> DataFrame:
    """SUCCESS / PARTIAL / ERROR among the newest runs: a top-k first, so only k rows are counted."""
    top = runs.select("id", "status", "executed_at").orderBy(F.col("executed_at").desc(), F.col("id").desc()).limit(newest)
    return top.agg(*[F.count_if(_status() == s).alias(s.lower()) for s in ("SUCCESS", "PARTIAL", "ERROR")])


def batch_summary(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("requested"), F.count_if("success").alias("succeeded"),
                    F.count_if(~F.col("success")).alias("failed"))


def scraper_metrics(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("runs_total"),
        F.sum(F.when(F.col("success"), _extracted()).otherwise(0)).alias("items_total"),
        F.count_if(~F.col("success")).alias("errors_total"),
        F.max(F.when(F.col("success"), F.col("executed_at"))).alias("last_success_at")).orderBy("source_name")


def scraper_run_labels(runs: DataFrame, mode: str = "groupBy") -> DataFrame:
    """Runs by scraper and status; also as rollup or cube with sub-totals."""
    return getattr(runs, mode)("source_name", "status").agg(F.count(F.lit(1)).alias("runs"))


def scraper_totals(runs: DataFrame) -> DataFrame:
    newest = F.max(F.struct("executed_at", "id", "status"))
    return runs.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("total_runs"), F.sum(_extracted()).alias("total_items"), newest.alias("n")).select(
        "source_name", "total_runs", "total_items", F.col("n.executed_at").alias("last_run"), F.col("n.status").alias("last_status"))


def monitored_sources(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Enabled sources first, then by newest extraction; never extracted counts as the epoch."""
    last = runs.groupBy("source_id").agg(F.max("executed_at").alias("last_extraction_at"))
    joined = sources.join(last, sources["id"] == last["source_id"], "left").drop("source_id")
    return joined.orderBy(F.col("enabled").desc(), F.col("last_extraction_at").desc_nulls_last(), F.col("id"))


def top_latest(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.col(order).desc_nulls_last(), F.col("id").asc()).limit(n)


def media_counts(listings: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return listings.select("id", *[F.size(F.coalesce(F.col(c), empty)).alias(c) for c in
                                   ("images", "videos", "documents", "links") if c in listings.columns])


def filter_sources(sources: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    token = text.strip().lower()
    found = sources
    if token:
        found = found.where(F.lower("name").contains(token) | F.lower("scraper_schedule").contains(token))
    if status in ("enabled", "disabled"):
        found = found.where(F.col("enabled") == (status == "enabled"))
    return found


def filter_scrapings(sources: DataFrame, text: str) -> DataFrame:
    """Text search over all shown fields and the word for the state of the source."""
    shown = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in
                               ("name", "scraper_type", "scraper_base_url", "scraper_schedule", "analysis")
                               if c in sources.columns],
                        F.when(F.col("enabled"), "ativo").otherwise("inativo"))
    return sources.where(F.lower(shown).contains(text.strip().lower()))


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.where("enabled").orderBy("id")


def sort_sources(sources: DataFrame, by: str = "name", direction: str = "asc") -> DataFrame:
    """By id, status text, cron or name; texts in language order rather than code point order."""
    key = {"id": F.col("id"), "status": F.col("enabled").cast("string"),
           "schedule": F.collate(F.col("scraper_schedule"), "UNICODE")}.get(by, F.collate(F.col("name"), "UNICODE"))
    return sources.orderBy(key.desc() if direction == "desc" else key.asc(), F.col("id").asc())


def queue_summary(queue: DataFrame) -> DataFrame:
    done = F.col("status").isin("completed", "error")
    return queue.agg(F.count_if(done).alias("processed"), F.count_if(F.col("status") == "completed").alias("completed"),
                     F.count_if(F.col("status") == "error").alias("error"), F.count_if(F.col("status") == "queued").alias("queued"))


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key in arrival order, by aggregation: a hot key shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in order and c != key]
    first = F.min(F.struct(*order, *rest)).alias("f")
    return df.groupBy(key).agg(first).select(key, *[F.col(f"f.{c}").alias(c) for c in order + rest])


def first_seen_dedup(df: DataFrame, key: str, order: list[str], max_items: int | None = None) -> DataFrame:
    kept = first_seen(df, key, order)
    return kept.orderBy(*order).limit(max_items) if max_items else kept


def interleaved_cap(records: DataFrame, max_items: int) -> DataFrame:
    """Round robin over scopes page by page, one row per record id, stopped at max_items.  The first
    scope that shows a record keeps it; the output is in scope order."""
    kept = first_seen(records, "record_id", ["page", "scope_idx", "pos"])
    return kept.orderBy("page", "scope_idx", "pos").limit(max_items).orderBy("scope_idx", "page", "pos")

