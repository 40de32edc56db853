"""Run history, metrics, windows over runs, the queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from listforge.functions import classify as cl, dates as dt
from listforge.operators import queue as qu, rollups as ro
from listforge.plans.registry import NOW, query
from listforge.session import scratch_folder
from listforge.sources import tables as tb

R = ("runs_v",)
S = ("sources_v",)
EXTRACTED = "greatest(coalesce(scraped_count, 0), 0)"
LOCAL = "CAST(timezone('America/Sao_Paulo', timezone('UTC', {})) AS DATE)"
NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
DAY = LOCAL.format("executed_at")
TODAY = LOCAL.format(NOW_SQL)


def _period(name, period, hours):
    @query(name, f"""SELECT id, source_name, status FROM runs_v WHERE executed_at >= {NOW_SQL} - INTERVAL {hours} HOUR
ORDER BY executed_at DESC, id DESC""", R)
    def run(t):
        return ro.recent_runs(t.runs_v, period, NOW).select("id", "source_name", "status")


_period("recent_runs", "7d", 168)
_period("recent_runs_24h", "24h", 24)
_period("recent_runs_unknown_period", "1y", 720)
_period("recent_runs_90d", "90d", 2160)

BY_DAY = f"""WITH days AS (SELECT CAST({TODAY} - CAST(i AS INTEGER) AS DATE) AS day FROM range(7) r(i)),
agg AS (SELECT {DAY} AS day, sum({EXTRACTED}) AS extracted, count(*) AS runs,
        count(*) FILTER (status = 'ERROR' OR NOT success) AS failures FROM runs_v GROUP BY 1)
SELECT d.day, strftime(d.day, '%d/%m') AS label, CAST(coalesce(a.extracted, 0) AS BIGINT) AS extracted,
coalesce(a.runs, 0) AS runs, coalesce(a.failures, 0) AS failures FROM days d LEFT JOIN agg a USING (day)"""


@query("runs_by_day", BY_DAY, R)
def runs_by_day(t):
    return ro.runs_by_day(t.runs_v, NOW)


@query("failures_in_range", f"""SELECT CAST(count(*) AS BIGINT) AS failures FROM runs_v
WHERE (status = 'ERROR' OR NOT success) AND {DAY} BETWEEN {TODAY} - 6 AND {TODAY}""", R)
def failures_in_range(t):
    return ro.failures_in_range(t.runs_v, NOW)


@query("extracted_today", f"SELECT CAST(coalesce(sum({EXTRACTED}), 0) AS BIGINT) AS extracted FROM runs_v WHERE {DAY} = {TODAY}", R)
def extracted_today(t):
    return ro.extracted_today(t.runs_v, NOW)


@query("source_totals", "SELECT count(*) FILTER (enabled) AS active, count(*) AS total FROM sources_v", S)
def source_totals(t):
    return ro.source_totals(t.sources_v)


@query("recent_status_tally", """SELECT count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'PARTIAL') AS partial,
count(*) FILTER (status = 'ERROR') AS error FROM (SELECT * FROM runs_v ORDER BY executed_at DESC, id DESC LIMIT 8)""", R)
def recent_status_tally(t):
    return ro.recent_status_tally(t.runs_v)


@query("batch_summary", """SELECT count(*) AS requested, count(*) FILTER (success) AS succeeded,
count(*) FILTER (NOT success) AS failed FROM runs_v""", R)
def batch_summary(t):
    return ro.batch_summary(t.runs_v)


@query("scraper_metrics", f"""SELECT source_name, count(*) AS runs_total,
CAST(sum(CASE WHEN success THEN {EXTRACTED} ELSE 0 END) AS BIGINT) AS items_total,
count(*) FILTER (NOT success) AS errors_total,
strftime(max(executed_at) FILTER (success), '%Y-%m-%d %H:%M:%S') AS last_success_at FROM runs_v GROUP BY 1""", R)
def scraper_metrics(t):
    return ro.scraper_metrics(t.runs_v).withColumn("last_success_at", F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss"))


@query("scraper_run_labels", "SELECT source_name, status, count(*) AS runs FROM runs_v GROUP BY 1, 2", R)
def scraper_run_labels(t):
    return ro.scraper_run_labels(t.runs_v)


@query("scraper_run_labels_rollup", "SELECT source_name, status, count(*) AS runs FROM runs_v GROUP BY ROLLUP (source_name, status)", R)
def scraper_run_labels_rollup(t):
    return ro.scraper_run_labels(t.runs_v, "rollup")


@query("scraper_run_labels_cube", "SELECT source_name, status, count(*) AS runs FROM runs_v GROUP BY CUBE (source_name, status)", R)
def scraper_run_labels_cube(t):
    return ro.scraper_run_labels(t.runs_v, "cube")


@query("scraper_totals", f"""SELECT source_name, count(*) AS total_runs, CAST(sum({EXTRACTED}) AS BIGINT) AS total_items,
strftime(max(executed_at), '%Y-%m-%d %H:%M:%S') AS last_run,
arg_max(status, (executed_at, id)) AS last_status FROM runs_v GROUP BY 1""", R)
def scraper_totals(t):
    return ro.scraper_totals(t.runs_v).withColumn("last_run", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss"))


@query("append_run_history", """SELECT id, CASE WHEN trim(lower(k)) = '' OR k IS NULL THEN 'scheduled' ELSE trim(lower(k)) END AS trigger_kind
FROM (SELECT id, CASE id % 3 WHEN 0 THEN ' MANUAL ' WHEN 1 THEN '' ELSE NULL END AS k FROM runs_v)""", R)
def append_run_history(t):
    raw = t.runs_v.withColumn("trigger_kind", F.expr("CASE id % 3 WHEN 0 THEN ' MANUAL ' WHEN 1 THEN '' ELSE NULL END"))
    path = scratch_folder(t.spark, "history")
    for k in (0, 1, 0):  # the first batch once more replaces itself
        tb.append_run_history(raw.where(F.col("id") % 2 == k), path, f"b{k}")
    return t.spark.read.parquet(path).select("id", "trigger_kind")


STATUS = """CASE WHEN http_status_code <> 200 THEN 'ERROR' WHEN NOT success THEN 'ERROR' WHEN scraped_count <= 0 THEN 'PARTIAL'
WHEN published_count <= 0 THEN 'ERROR' WHEN published_count < scraped_count THEN 'PARTIAL' ELSE 'SUCCESS' END"""


@query("run_status", f"SELECT id, {STATUS} AS run_status FROM runs_v", R)
def run_status(t):
    return t.runs_v.select("id", cl.run_status(F.col("http_status_code"), F.col("success"), F.col("scraped_count"), F.col("published_count")).alias("run_status"))


@query("run_message", f"""SELECT id, CASE WHEN e IS NOT NULL THEN e WHEN s = 'SUCCESS' THEN 'Extraído e publicado' || n
WHEN s = 'PARTIAL' THEN 'Extração/publicação parcial' || n WHEN http_status_code IS NOT NULL THEN 'HTTP ' || http_status_code
ELSE 'Falha na publicação' || n END AS message FROM (SELECT *, {STATUS} AS s,
' (' || published_count || '/' || scraped_count || ' itens)' AS n, CASE WHEN id % 17 = 0 THEN 'timeout' END AS e FROM runs_v)""", R)
def run_message(t):
    status = cl.run_status(F.col("http_status_code"), F.col("success"), F.col("scraped_count"), F.col("published_count"))
    error = F.expr("CASE WHEN id % 17 = 0 THEN 'timeout' END")
    return t.runs_v.select("id", cl.run_message(status, error, F.col("http_status_code"), F.col("scraped_count"), F.col("published_count")).alias("message"))


@query("local_day", f"""SELECT id, {DAY} AS day, strftime({DAY}, '%d/%m') AS label,
strftime(timezone('America/Sao_Paulo', timezone('UTC', executed_at)), '%d/%m/%Y %H:%M') AS shown FROM runs_v""", R)
def local_day(t):
    ts = F.col("executed_at")
    return t.runs_v.select("id", dt.local_day(ts).alias("day"), dt.local_day_label(ts).alias("label"), dt.local_datetime_text(ts).alias("shown"))


@query("monitored_sources", """SELECT s.id, s.name, strftime(r.m, '%Y-%m-%d %H:%M:%S') AS last_extraction_at FROM sources_v s
LEFT JOIN (SELECT source_id, max(executed_at) AS m FROM runs_v GROUP BY 1) r ON r.source_id = s.id""", ("sources_v", "runs_v"))
def monitored_sources(t):
    return ro.monitored_sources(t.sources_v, t.runs_v).select("id", "name", F.date_format("last_extraction_at", "yyyy-MM-dd HH:mm:ss").alias("last_extraction_at"))


@query("filter_sources", "SELECT id FROM sources_v WHERE (name LIKE '%nation_1%' OR scraper_schedule LIKE '%nation_1%') AND enabled", S)
def filter_sources(t):
    return ro.filter_sources(t.sources_v, " NATION_1 ", "enabled").select("id")


@query("filter_scrapings", """SELECT id FROM sources_v WHERE lower(concat_ws(' ', name, scraper_type, scraper_base_url, scraper_schedule,
CASE WHEN enabled THEN 'ativo' ELSE 'inativo' END)) LIKE '%inativo%'""", S)
def filter_scrapings(t):
    return ro.filter_scrapings(t.sources_v, "Inativo").select("id")


@query("enabled_sources", "SELECT id, name FROM sources_v WHERE enabled ORDER BY id", S)
def enabled_sources(t):
    return ro.enabled_sources(t.sources_v).select("id", "name")


@query("sort_sources", "SELECT id, name, row_number() OVER (ORDER BY lower(name), name, id) AS place FROM sources_v", S)
def sort_sources(t):
    from pyspark.sql import Window

    ranked = Window.orderBy(F.collate(F.col("name"), "UNICODE"), "id")
    return ro.sort_sources(t.sources_v, "name").select("id", "name", F.row_number().over(ranked).alias("place"))


# --- queue ---------------------------------------------------------------------------------
Q = ("queue_v",)


@query("queue_summary", """SELECT count(*) FILTER (status IN ('completed', 'error')) AS processed, count(*) FILTER (status = 'completed') AS completed,
count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'queued') AS queued FROM queue_v""", Q)
def queue_summary(t):
    return ro.queue_summary(t.queue_v)


@query("fifo_pending", "SELECT id, source_name FROM queue_v WHERE status = 'queued' ORDER BY created_at, id LIMIT 10", Q)
def fifo_pending(t):
    return qu.fifo_pending(t.queue_v, 10).select("id", "source_name")


@query("queue_list", "SELECT id, status FROM queue_v WHERE status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 30", Q)
def queue_list(t):
    return qu.queue_list(t.queue_v, " Completed", 100, 30).select("id", "status")


REQUESTS_SQL = """req AS (SELECT l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber = 7 THEN ' ' ELSE concat(' SRC', l_orderkey % 5) END AS source_name,
concat('https://q.example/', l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN '#a' ELSE '' END) AS url, l_partkey AS item_id FROM lineitem),
norm AS (SELECT pos, item_id, lower(trim(source_name)) AS source_name, split_part(url, '#', 1) AS url FROM req WHERE trim(source_name) <> ''),
first AS (SELECT source_name, url, min(pos) AS pos FROM norm GROUP BY 1, 2),
active AS (SELECT DISTINCT lower(trim(source_name)) AS source_name, split_part(url, '#', 1) AS url FROM queue_v WHERE status IN ('queued', 'processing'))"""


def _requests(t):
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.expr("CASE WHEN l_linenumber = 7 THEN ' ' ELSE concat(' SRC', l_orderkey % 5) END").alias("source_name"),
        F.expr("concat('https://q.example/', l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN '#a' ELSE '' END)").alias("url"),
        F.col("l_partkey").alias("item_id"))


@query("enqueue_new", f"""WITH {REQUESTS_SQL} SELECT (SELECT max(id) FROM queue_v) + row_number() OVER (ORDER BY f.pos) AS id, f.source_name, f.url, f.pos, 'queued' AS status, 0 AS attempts,
{NOW_SQL} AS created_at FROM first f
WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.source_name = f.source_name AND a.url = f.url)""", Q)
def enqueue_new(t):
    return qu.enqueue_new(_requests(t), t.queue_v, F.lit(NOW)).select("id", "source_name", "url", "pos", "status", "attempts", "created_at")


@query("enqueue_report", f"""WITH {REQUESTS_SQL}, fresh AS (SELECT count(*) AS n FROM first f
WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.source_name = f.source_name AND a.url = f.url))
SELECT (SELECT n FROM fresh) AS queued, (SELECT count(*) FROM norm) - (SELECT n FROM fresh) AS deduplicated""", Q)
def enqueue_report(t):
    return qu.enqueue_report(_requests(t), t.queue_v)


MISSING_SQL = """CASE WHEN coalesce(item_id, 0) <= 0 THEN FALSE WHEN chat THEN chat_missing
ELSE coalesce(code IN (404, 410), FALSE) OR (NOT blocked AND coalesce(err LIKE '%not found%', FALSE)) OR coalesce(raised LIKE '%gone%', FALSE) END"""
OUTCOME_SQL = """o AS (SELECT id, item_id, id % 7 = 0 AS chat, id % 2 = 0 AS chat_missing,
CASE id % 6 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 500 ELSE NULL END AS code, id % 5 = 0 AS blocked,
CASE WHEN id % 4 = 0 THEN 'page not found' WHEN id % 4 = 1 THEN 'timeout' END AS err,
CASE WHEN id % 9 = 0 THEN 'resource is gone' WHEN id % 9 = 1 THEN 'boom' END AS raised, attempts, status FROM queue_v)"""


def _outcomes(t):
    return t.queue_v.select(
        "id", F.expr("id % 3 = 2").alias("found"), F.expr("id % 2 = 0").alias("chat_missing"),
        F.expr("CASE id % 6 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 500 ELSE NULL END").alias("status_code"),
        F.expr("id % 5 = 0").alias("blocked"),
        F.expr("CASE WHEN id % 4 = 0 THEN 'Page NOT found' WHEN id % 4 = 1 THEN 'timeout' END").alias("fetch_error"),
        F.expr("CASE WHEN id % 9 = 0 THEN 'resource is gone' WHEN id % 9 = 1 THEN 'boom' END").alias("raised"))


def _queue(t):
    return t.queue_v.withColumn("url", F.expr("CASE WHEN id % 7 = 0 THEN concat('telegram://1/', id) ELSE url END"))


@query("item_missing", f"WITH {OUTCOME_SQL} SELECT id, {MISSING_SQL} AS missing FROM o", Q)
def item_missing(t):
    df = _queue(t).join(_outcomes(t), "id")
    return df.select("id", cl.item_missing(F.col("item_id"), F.col("url"), F.col("chat_missing"), F.col("status_code"),
                                           F.col("blocked"), F.col("fetch_error"), F.col("raised")).alias("missing"))


@query("process_queue", f"""WITH {OUTCOME_SQL}, r AS (SELECT *, id % 3 = 2 AND raised IS NULL AS found, {MISSING_SQL} AS gone FROM o)
SELECT id, CASE WHEN found OR gone THEN 'completed' ELSE 'error' END AS status, attempts + 1 AS attempts,
CASE WHEN NOT (found OR gone) THEN coalesce(raised, 'Scraper não retornou item para a URL solicitada') END AS last_error,
gone AND NOT found AS delete_item FROM r WHERE status = 'queued'""", Q)
def process_queue(t):
    pending = _queue(t).where("status = 'queued'")
    outcomes = _outcomes(t)
    return qu.process_queue(pending, outcomes.unionByName(outcomes), F.lit(NOW)).select("id", "status", "attempts", "last_error", "delete_item")


# --- messages and offsets ------------------------------------------------------------------
M = ("messages_v",)


@query("chat_messages_since", """SELECT m.chat_id, m.message_id FROM messages_v m
JOIN (SELECT chat_id, CASE WHEN chat_id % 3 = 0 THEN NULL ELSE min(message_id) END AS last FROM messages_v GROUP BY 1) o USING (chat_id)
WHERE o.last IS NULL OR m.message_id > o.last
QUALIFY row_number() OVER (PARTITION BY m.chat_id ORDER BY m.message_id DESC) <= 3""", M)
def chat_messages_since(t):
    offsets = t.messages_v.groupBy("chat_id").agg(F.min("message_id").alias("m")).select(
        "chat_id", F.expr("CASE WHEN chat_id % 3 = 0 THEN NULL ELSE m END").alias("last_message_id"))
    return tb.chat_messages_since(t.messages_v, offsets, 3).select("chat_id", "message_id")


@query("save_offsets", """SELECT 'chat' AS source_name, CAST(chat_id AS VARCHAR) AS chat_id,
greatest(max(message_id), CASE WHEN chat_id % 2 = 0 THEN 999999999 ELSE 0 END) AS last_message_id FROM messages_v GROUP BY chat_id""", M)
def save_offsets(t):
    seen = t.messages_v.select(F.lit("chat").alias("source_name"), F.col("chat_id").cast("string").alias("chat_id"), F.col("message_id").alias("last_message_id"))
    stored = t.messages_v.select(F.lit("chat").alias("source_name"), F.col("chat_id").cast("string").alias("chat_id"),
                                 F.expr("CASE WHEN chat_id % 2 = 0 THEN 999999999L ELSE 0L END").alias("last_message_id")).distinct()
    return tb.save_offsets(stored, seen)


# --- dedup and interleave ------------------------------------------------------------------
@query("first_seen_dedup", """SELECT url, page_id FROM (SELECT url, page_id, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn
FROM (SELECT regexp_replace(url, '[?#].*$', '') AS url, page_id FROM pages)) WHERE rn = 1""")
def first_seen_dedup(t):
    df = t.pages.select(F.regexp_replace("url", "[?#].*$", "").alias("url"), "page_id")
    return ro.first_seen_dedup(df, "url", ["page_id"]).select("url", "page_id")


@query("interleaved_cap", """SELECT record_id, scope_idx, page FROM (
SELECT o_custkey AS record_id, arg_min((o_orderkey % 7, o_orderkey // 700, o_orderkey), (o_orderkey // 700, o_orderkey % 7, o_orderkey)) AS a,
a[1] AS scope_idx, a[2] AS page, a[3] AS pos FROM orders GROUP BY 1) ORDER BY page, scope_idx, pos LIMIT 500""")
def interleaved_cap(t):
    df = t.orders.select(F.col("o_custkey").alias("record_id"), F.expr("o_orderkey % 7").alias("scope_idx"),
                         F.expr("o_orderkey div 700").alias("page"), F.col("o_orderkey").alias("pos"))
    return ro.interleaved_cap(df, 500).select("record_id", "scope_idx", "page")


@query("latest_match", """SELECT source_id, arg_max(id, (executed_at, -id)) AS match_id FROM runs_v GROUP BY 1""", R)
def latest_match(t):
    from listforge.operators.merge import latest_by

    return latest_by(t.runs_v, ["source_id"], F.col("executed_at")).select("source_id", "match_id")
