"""Listing filters, sorts, paging and lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from listforge.functions import classify as cl, geo
from listforge.operators import listing_query as lq, rollups as ro
from listforge.plans.registry import query

L = ("listings_v",)
LS = ("listings_v", "sources_v")
F_ = lq.ListingFilter


def _filtered(name: str, f: lq.ListingFilter, where: str, with_source: bool = False):
    join = " LEFT JOIN sources_v s ON s.id = l.source_id" if with_source else ""

    @query(name, f"SELECT l.id, l.price FROM listings_v l{join} WHERE {where}", LS if with_source else L)
    def run(t):
        return lq.filter_listings(t.listings_v, f, t.sources_v).select("id", "price")


_filtered("filter_source", F_(source="  NATION_3 "), "s.name = 'nation_3'", True)
_filtered("filter_text", F_(text="Nation_7"), "lower(l.title || ' ' || l.description || ' ' || coalesce(s.name, '') || ' ' || l.company) LIKE '%nation\\_7%' ESCAPE '\\'", True)
_filtered("filter_min_price", F_(min_price=200000), "l.price >= 200000")
_filtered("filter_max_price", F_(max_price=150000), "l.price <= 150000")
_filtered("filter_max_price_zero", F_(max_price=0), "l.price IS NULL")
_filtered("filter_currency", F_(currency="usd"), "lower(l.currency) = 'usd'")
_filtered("filter_currency_other", F_(currency="other"), "lower(coalesce(l.currency, '')) NOT IN ('', 'brl', 'usd')")
_filtered("filter_state", F_(state="RJ"), "upper(l.state) = 'RJ'")
_filtered("filter_city", F_(city="rio de"), "lower(regexp_replace(l.city, '\\s+', ' ', 'g')) LIKE '%rio de%'")
_filtered("filter_created_since", F_(created_since=datetime(1998, 6, 1)), "l.created_at IS NULL OR l.created_at >= TIMESTAMP '1998-06-01'")
_filtered("filter_contract_type", F_(contract_type="PJ"), "lower(l.contract_type) IN ('pj', 'pessoa juridica', 'pessoa jurídica')")
_filtered("filter_contract_type_ignored", F_(contract_type="estagio"), "TRUE")
_filtered("filter_seniority", F_(seniority="senior"), "lower(l.seniority) IN ('senior', 'sênior', 'sr')")
_filtered("filter_has_contact", F_(has_contact=True), "length(regexp_replace(coalesce(l.contact_phone, ''), '[^0-9]', '', 'g')) >= 8 OR regexp_matches(coalesce(l.contact_email, ''), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')")
_filtered("filter_has_salary", F_(has_salary=True), "l.salary_range > 0")
_filtered("filter_has_salary_false", F_(has_salary=False), "coalesce(l.salary_range, 0) <= 0")
_filtered("filter_flag", F_(software_focus=True), "lower(l.software_focus) IN ('true', '1', 'sim')")
_filtered("filter_flag_false", F_(software_focus=False), "coalesce(lower(l.software_focus), '') NOT IN ('true', '1', 'sim')")

COMBINED = F_(text="senior", min_price=50000, max_price=400000, has_contact=False, seniority="junior")
COMBINED_SQL = ("lower(l.title || ' ' || l.description || ' ' || coalesce(s.name, '') || ' ' || l.company) LIKE '%senior%' "
                "AND l.price >= 50000 AND l.price <= 400000 AND lower(l.seniority) IN ('junior', 'júnior', 'jr') "
                "AND NOT (length(regexp_replace(coalesce(l.contact_phone, ''), '[^0-9]', '', 'g')) >= 8 OR "
                "regexp_matches(coalesce(l.contact_email, ''), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'))")


@query("query_listings", f"""SELECT l.id, l.title, l.price, s.name AS source_name
FROM listings_v l LEFT JOIN sources_v s ON s.id = l.source_id WHERE {COMBINED_SQL}
ORDER BY l.price ASC NULLS LAST, l.id LIMIT 100 OFFSET 20""", LS)
def query_listings(t):
    return lq.query_listings(t.listings_v, t.sources_v, COMBINED, "price", "asc", 100, 20).select(
        "id", "title", "price", "source_name")


@query("count_listings", f"""SELECT count(*) AS total FROM listings_v l LEFT JOIN sources_v s ON s.id = l.source_id
WHERE {COMBINED_SQL}""", LS)
def count_listings(t):
    return lq.count_listings(t.listings_v, t.sources_v, COMBINED)


@query("search_listings", """SELECT l.id FROM listings_v l LEFT JOIN sources_v s ON s.id = l.source_id
WHERE lower(l.title || ' ' || l.description || ' ' || coalesce(s.name, '') || ' ' || l.company) LIKE '%building%'
ORDER BY l.created_at DESC NULLS LAST, l.id""", LS)
def search_listings(t):
    return lq.search_listings(t.listings_v, t.sources_v, "building").select("id")


def _sorted(name: str, by: str, direction: str, order: str, value: str, sql_value: str):
    @query(name, f"SELECT id, {sql_value} AS v FROM listings_v ORDER BY {order}", L)
    def run(t):
        df = lq.query_listings(t.listings_v, t.sources_v, F_(), by, direction)
        return df.select("id", F.expr(value).alias("v"))


_CREATED = ("date_format(created_at, 'yyyy-MM-dd')", "strftime(created_at, '%Y-%m-%d')")
_sorted("sort_created", "created_at", "desc", "created_at DESC NULLS LAST, id", *_CREATED)
_sorted("sort_created_asc", "whatever", "asc", "created_at ASC NULLS FIRST, id", *_CREATED)
_sorted("sort_price", "price", "asc", "price ASC NULLS LAST, id", "price", "price")
_sorted("sort_price_desc", "price", "desc", "price DESC NULLS FIRST, id", "price", "price")
_sorted("sort_title", "title", "asc", "lower(coalesce(title, '')), id", "title", "title")


@query("sort_updated", """SELECT id, strftime(created_at, '%Y-%m-%d') AS v FROM listings_v
ORDER BY created_at ASC NULLS FIRST, id""", L)
def sort_updated(t):
    df = t.listings_v.withColumn("updated_at", F.col("created_at"))
    return lq.query_listings(df, t.sources_v, F_(), "updated_at", "asc").select(
        "id", F.date_format("updated_at", "yyyy-MM-dd").alias("v"))


@query("page_slice", "SELECT id, price FROM listings_v ORDER BY price DESC NULLS FIRST, id LIMIT 50 OFFSET 100", L)
def page_slice(t):
    return lq.page_slice(t.listings_v.orderBy(*lq.sort_columns("price", "desc")), 50, 100).select("id", "price")


@query("page_clamp", """SELECT count(*) AS n, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS total_pages,
CAST(least(999999, greatest(1, ceil(count(*) / 20.0))) AS BIGINT) AS current_page FROM listings_v""", L)
def page_clamp(t):
    return lq.page_clamp(t.listings_v, 20, 999999)


@query("join_source_name", """SELECT l.id, s.name AS source_name, CASE WHEN l.source_id IS NOT NULL THEN
coalesce(s.name, 'Fonte #' || l.source_id) ELSE coalesce(nullif(trim(l.company), ''), 'Fonte local') END AS label
FROM listings_v l LEFT JOIN sources_v s ON s.id = l.source_id AND s.enabled""", LS)
def join_source_name(t):
    df = lq.join_source_name(t.listings_v, t.sources_v.where("enabled"))
    return df.select("id", "source_name", lq.source_label(F.col("source_id"), F.col("source_name"), F.col("company")).alias("label"))


@query("scan_tables", """SELECT 'listings' AS name, count(*) AS n FROM listings_v UNION ALL
SELECT 'sources', count(*) FROM sources_v UNION ALL SELECT 'runs', count(*) FROM runs_v UNION ALL
SELECT 'queue', count(*) FROM queue_v UNION ALL SELECT 'offsets', count(DISTINCT chat_id) FROM messages_v""",
       ("listings_v", "sources_v", "runs_v", "queue_v", "messages_v"))
def scan_tables(t):
    def count(name, df):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")

    offsets = t.messages_v.select("chat_id").distinct()
    return (count("listings", t.listings_v).union(count("sources", t.sources_v)).union(count("runs", t.runs_v))
            .union(count("queue", t.queue_v)).union(count("offsets", offsets)))


@query("lookup_by_ids", """SELECT r.pos, l.id, l.title FROM (SELECT l_orderkey * 10 + l_linenumber AS pos,
l_orderkey - 5 AS id FROM lineitem) r JOIN listings_v l ON l.id = r.id WHERE r.id > 0""", L)
def lookup_by_ids(t):
    wanted = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_orderkey") - 5).alias("id"))
    return lq.lookup_by_ids(t.listings_v, wanted).select("pos", "id", "title")


@query("top_latest", "SELECT id, title FROM listings_v ORDER BY created_at DESC NULLS LAST, id LIMIT 12", L)
def top_latest(t):
    return ro.top_latest(t.listings_v, "created_at", 12).select("id", "title")


@query("remote_listing", """SELECT id, (lower(coalesce(city, '') || chr(10) || coalesce(state, '') || chr(10) || m)
SIMILAR TO '(.|\\n)*(remote|remoto|home office|anywhere|worldwide)(.|\\n)*') AS remote FROM (SELECT id, city, state,
CASE id % 4 WHEN 0 THEN 'Home Office' WHEN 1 THEN 'presencial' WHEN 2 THEN 'REMOTO' ELSE 'hibrido' END AS m FROM listings_v)""", L)
def remote_listing(t):
    model = F.expr("CASE id % 4 WHEN 0 THEN 'Home Office' WHEN 1 THEN 'presencial' WHEN 2 THEN 'REMOTO' ELSE 'hibrido' END")
    return t.listings_v.select("id", cl.remote_listing(F.col("city"), F.col("state"), model).alias("remote"))


@query("contract_tag", """SELECT id, CASE WHEN lower(contract_type) = 'pj' OR lower(contract_type) LIKE '%pessoa jurid%' THEN 'PJ'
WHEN lower(contract_type) = 'clt' THEN 'CLT' ELSE upper(trim(contract_type)) END AS tag FROM listings_v""", L)
def contract_tag(t):
    return t.listings_v.select("id", cl.contract_tag(F.col("contract_type")).alias("tag"))


@query("location_label", """SELECT id, coalesce(nullif(concat_ws(' / ', nullif(trim(city), ''), nullif(trim(state), '')), ''),
nullif(trim(r), ''), 'Local não informado') AS label FROM (SELECT *, CASE WHEN id % 2 = 0 THEN ' Brasil ' END AS r FROM listings_v)""", L)
def location_label(t):
    raw = F.expr("CASE WHEN id % 2 = 0 THEN ' Brasil ' END")
    return t.listings_v.select("id", geo.location_label(F.col("city"), F.col("state"), raw).alias("label"))


@query("media_counts", """SELECT id, id % 4 AS images, 0 AS videos, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS documents, 1 AS links
FROM listings_v""", L)
def media_counts(t):
    df = t.listings_v.select("id", F.expr("transform(filter(array(1, 2, 3), x -> x <= id % 4), x -> cast(x as string))").alias("images"),
                             F.expr("cast(null as array<string>)").alias("videos"),
                             F.expr("case when id % 2 = 0 then array(title) else array() end").alias("documents"),
                             F.array("url").alias("links"))
    return ro.media_counts(df)
