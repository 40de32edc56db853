"""Source catalog: sync, overrides, names and cron."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from listforge.operators import catalog as ca
from listforge.plans.registry import query

S = ("sources_v",)
DEPRECATED = ["nation_21", "nation_22"]


def _stored(t):
    """Stored catalog: the first sources are missing, some differ, some hold their own config."""
    return t.sources_v.where("id > 3").select(
        "id", "name", "enabled", F.expr("CASE WHEN id % 4 = 0 THEN 'https://old.example' ELSE scraper_base_url END").alias("scraper_base_url"),
        "scraper_type", "scraper_schedule", F.expr("CASE WHEN id % 5 = 0 THEN map('pages', '9', 'own', 'x') ELSE map('pages', '2') END").alias("extra_config"))


def _desired(t):
    return t.sources_v.where("id <= 22").select(
        "name", F.lit(True).alias("enabled"), "scraper_base_url", "scraper_type", "scraper_schedule",
        F.expr("CASE WHEN id % 7 = 0 THEN map('pages', '2', 'extra', '1') ELSE map('pages', '2') END").alias("extra_config"))


ACTION = """SELECT name, id, CASE WHEN id > 3 AND name IN ('nation_21', 'nation_22') THEN 'removed' WHEN id <= 3 THEN 'created' WHEN id > 22 THEN 'kept'
WHEN id % 4 = 0 OR id % 7 = 0 THEN 'updated' ELSE 'skipped' END AS action, CASE WHEN id <= 3 THEN TRUE ELSE enabled END AS enabled,
CASE WHEN id > 3 AND id % 5 = 0 THEN '9' ELSE '2' END AS pages FROM sources_v"""


@query("sync_catalog", f"SELECT name, action, enabled, pages FROM ({ACTION})", S)
def sync_catalog(t):
    return ca.sync_catalog(_desired(t), _stored(t), DEPRECATED).select("name", "action", "enabled", F.col("extra_config")["pages"].alias("pages"))


@query("sync_counts", f"""SELECT count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'updated') AS updated,
count(*) FILTER (action = 'skipped') AS skipped, count(*) FILTER (action = 'removed') AS removed FROM ({ACTION})""", S)
def sync_counts(t):
    return ca.sync_counts(ca.sync_catalog(_desired(t), _stored(t), DEPRECATED))


@query("except_deprecated", "SELECT id, name FROM sources_v WHERE name NOT IN (SELECT 'nation_' || (r_regionkey + 20) FROM region)", S)
def except_deprecated(t):
    old = t.region.select(F.concat(F.lit("nation_"), F.col("r_regionkey") + 20).alias("name"))
    return ca.except_deprecated(t.sources_v, old).select("id", "name")


@query("apply_source_overrides", """SELECT name, CASE WHEN id % 2 = 0 THEN scraper_base_url ELSE 'https://default' END AS base_url, CASE WHEN id % 3 = 0 THEN scraper_schedule ELSE '0 1 * * *' END AS schedule,
CASE scraper_type WHEN 'http' THEN 'http_antibot' ELSE scraper_type END AS strategy, CASE WHEN id % 2 = 0 THEN '5' ELSE '1' END AS pages, CASE WHEN scraper_type <> 'http_basic' THEN 'p1,p2' END AS proxies FROM sources_v""", S)
def apply_source_overrides(t):
    defaults = t.sources_v.select("name", F.lit("https://default").alias("base_url"), F.lit("0 1 * * *").alias("schedule"), F.expr("map('pages', '1')").alias("extra_config"))
    stored = t.sources_v.select("name", F.expr("CASE WHEN id % 2 = 0 THEN scraper_base_url ELSE '' END").alias("scraper_base_url"),
                                F.expr("CASE WHEN id % 3 = 0 THEN scraper_schedule END").alias("scraper_schedule"), "scraper_type",
                                F.expr("CASE WHEN id % 2 = 0 THEN map('pages', '5') END").alias("extra_config"))
    out = ca.apply_source_overrides(defaults, stored, " p1, p2,")
    return out.select("name", "base_url", "schedule", "strategy", F.col("extra_config")["pages"].alias("pages"), F.try_element_at("extra_config", F.lit("proxy_pool")).alias("proxies"))


@query("find_or_create_source", """SELECT (SELECT max(id) FROM sources_v) + row_number() OVER (ORDER BY k) AS id, k AS name FROM (SELECT DISTINCT lower(n) AS k FROM (SELECT CASE WHEN trim(c_mktsegment) = '' THEN 'unknown' WHEN c_nationkey % 6 = 0 THEN 'unknown'
WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'NATION_' || c_nationkey END AS n FROM customer)) WHERE k NOT IN (SELECT lower(name) FROM sources_v)""", S)
def find_or_create_source(t):
    names = t.customer.select(F.expr("CASE WHEN c_nationkey % 6 = 0 THEN ' ' WHEN c_nationkey % 2 = 0 THEN concat(' ', c_mktsegment) ELSE concat('NATION_', c_nationkey) END").alias("name"))
    return ca.find_or_create_source(names, t.sources_v)


# Cron at 15:43 UTC of a Wednesday; the oracle finds the first fitting minute of a calendar.
CRON = """WITH m AS (SELECT TIMESTAMP '2024-01-31 12:43:00' + to_minutes(CAST(i AS INTEGER)) AS t FROM range(0, 130000) r(i)),
fire AS (SELECT '0 */6 * * *' AS cron, min(t) AS t FROM m WHERE minute(t) = 0 AND hour(t) % 6 = 0
UNION ALL SELECT '30 2 * * 1-5', min(t) FROM m WHERE minute(t) = 30 AND hour(t) = 2 AND dayofweek(t) IN (2, 3, 4, 5, 6)
UNION ALL SELECT '*/15 * 1 * *', min(t) FROM m WHERE minute(t) % 15 = 0 AND day(t) = 1)
SELECT s.id, CASE WHEN s.enabled THEN strftime(timezone('UTC', timezone('America/Sao_Paulo', f.t)), '%Y-%m-%d %H:%M') END AS next_fire_at FROM sources_v s JOIN fire f ON f.cron = s.scraper_schedule"""


@query("schedule_expand", CRON, S)
def schedule_expand(t):
    out = ca.schedule_expand(t.sources_v, F.lit(datetime(2024, 1, 31, 15, 43)))
    return out.select("id", F.date_format("next_fire_at", "yyyy-MM-dd HH:mm").alias("next_fire_at"))
