"""Views over the test tables, as SQL that Spark and the oracle engine read alike.

The tables have no listings, so the views build them: amounts, dates and places are written as
text from numeric and date columns, which is also where the oracle takes its answers from.
"""

VIEW_SQL: dict[str, str] = {}

VIEW_SQL["sources_v"] = """
SELECT n_nationkey + 1 AS id, lower(n_name) AS name, n_nationkey % 5 <> 0 AS enabled,
       concat('https://', lower(n_name), '.example.com') AS scraper_base_url,
       CASE n_nationkey % 3 WHEN 0 THEN 'http_basic' WHEN 1 THEN 'http' ELSE 'browser_playwright' END AS scraper_type,
       CASE n_regionkey % 3 WHEN 0 THEN '0 */6 * * *' WHEN 1 THEN '30 2 * * 1-5' ELSE '*/15 * 1 * *' END AS scraper_schedule
FROM {nation}"""

VIEW_SQL["listings_v"] = """
SELECT o_orderkey + 1 AS id,
       concat('https://jobs.example.com/', CAST(o_orderkey AS VARCHAR(20)), '/?ref=', CAST(o_orderkey % 3 AS VARCHAR(20))) AS url,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_nationkey + 1 END AS source_id,
       concat(o_orderpriority, '  ', c_mktsegment) AS title,
       concat('<p>Senior ', lower(c_mktsegment), ' &amp; co</p>') AS description,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
       CASE o_orderkey % 5 WHEN 0 THEN 'BRL' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN '' ELSE NULL END AS currency,
       CASE o_orderkey % 4 WHEN 0 THEN 'SP' WHEN 1 THEN 'rj' WHEN 2 THEN 'MG' ELSE NULL END AS state,
       CASE o_orderkey % 3 WHEN 0 THEN 'São Paulo' WHEN 1 THEN 'Rio  de Janeiro' ELSE NULL END AS city,
       CASE WHEN o_orderkey % 6 = 0 THEN '(11) 98765-4321' WHEN o_orderkey % 6 = 1 THEN '123' ELSE NULL END AS contact_phone,
       CASE WHEN o_orderkey % 8 = 0 THEN 'a@b.co' WHEN o_orderkey % 8 = 1 THEN 'bad@' ELSE NULL END AS contact_email,
       c_name AS company,
       CASE o_orderkey % 4 WHEN 0 THEN 'PJ' WHEN 1 THEN 'clt' WHEN 2 THEN 'Pessoa Jurídica' ELSE NULL END AS contract_type,
       CASE o_orderkey % 5 WHEN 0 THEN 'Sênior' WHEN 1 THEN 'sr' WHEN 2 THEN 'pleno' WHEN 3 THEN 'Jr' ELSE NULL END AS seniority,
       CASE WHEN o_orderkey % 9 = 0 THEN 0.0 WHEN o_orderkey % 9 < 5 THEN o_totalprice / 12 ELSE NULL END AS salary_range,
       CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'Sim' ELSE NULL END AS software_focus,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS created_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

VIEW_SQL["runs_v"] = """
SELECT event_id AS id, user_id + 1 AS source_id, concat('src', CAST(user_id AS VARCHAR(20))) AS source_name,
       CASE WHEN event_id % 4 = 0 THEN 'manual' ELSE 'scheduled' END AS trigger_kind,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
       event_type <> 'error' AS success,
       CAST(floor(value) AS INT) - 5 AS scraped_count,
       CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN CAST(floor(value / 2) AS INT) ELSE CAST(floor(value) AS INT) END AS published_count,
       CASE WHEN event_id % 10 = 0 THEN 404 WHEN event_id % 3 = 0 THEN NULL ELSE 200 END AS http_status_code,
       CAST(ts AS TIMESTAMP) AS executed_at
FROM {events}"""

VIEW_SQL["messages_v"] = """
SELECT conv_id AS chat_id, conv_id * 100 + turn AS message_id, role, text FROM {conversations}"""

# Amounts: whole reais r and cents c, written in Brazilian and plain forms.
VIEW_SQL["amounts_v"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber AS n, l_quantity AS qty, l_discount AS disc,
       CAST(floor(l_extendedprice) AS BIGINT) AS r,
       CAST(floor(l_tax * 100) AS BIGINT) AS c,
       CASE WHEN l_extendedprice >= 1000 THEN concat(
              CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS VARCHAR(20)), '.',
              lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS VARCHAR(20)), 3, '0'))
            ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20)) END AS r_text,
       lpad(CAST(CAST(floor(l_tax * 100) AS BIGINT) AS VARCHAR(20)), 2, '0') AS c_text,
       l_returnflag AS flag
FROM {lineitem}"""

# Places, coordinates, dates and phones as text, with the value the text was made from.
VIEW_SQL["places_v"] = """
SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS d, o_totalprice AS v,
       CAST(o_orderkey % 90 AS INT) AS deg, CAST(o_custkey % 60 AS INT) AS mnt,
       CASE o_orderkey % 5 WHEN 0 THEN 'SP' WHEN 1 THEN 'RJ' WHEN 2 THEN 'MG' WHEN 3 THEN 'BA' ELSE 'XX' END AS uf,
       CASE o_custkey % 4 WHEN 0 THEN 'campinas' WHEN 1 THEN 'são josé' WHEN 2 THEN 'belo vale' ELSE 'Ouro Preto' END AS town
FROM {orders}"""

# Stored and incoming listings for the merge.  Both sides use every order; the incoming keys are
# shifted so that some match by url, some by a shared link, some by dedupe key and some not at all.
VIEW_SQL["stored_v"] = """
SELECT o_orderkey + 1 AS id, concat('https://a.example/', CAST(o_orderkey AS VARCHAR(20))) AS url,
       CAST(o_custkey % 7 + 1 AS INT) AS source_id, o_orderpriority AS title, 'old text' AS description,
       o_totalprice AS price, 'BRL' AS currency, 'SP' AS state,
       CASE WHEN o_custkey % 2 = 0 THEN 'Campinas' ELSE NULL END AS city,
       concat('https://ext.example/', CAST(o_orderkey AS VARCHAR(20))) AS link,
       concat('k', CAST(o_orderkey AS VARCHAR(20))) AS dedupe_key,
       1 AS version, CAST(o_orderdate AS TIMESTAMP) AS updated_at
FROM {orders}"""

VIEW_SQL["incoming_v"] = """
SELECT o_orderkey AS row_id,
       concat('https://a.example/', CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE o_orderkey + 900000000 END AS VARCHAR(20))) AS url,
       CAST(o_custkey % 7 + 1 AS INT) AS source_id,
       CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('new ', o_orderstatus) END AS title,
       CASE WHEN o_custkey % 5 = 0 THEN 'new text' ELSE NULL END AS description,
       CASE WHEN o_orderkey % 6 = 0 THEN 0.0 ELSE o_totalprice + 1 END AS price,
       'USD' AS currency, 'RJ' AS state, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE 'Rio' END AS city,
       CASE WHEN o_orderkey % 4 = 1 THEN concat('https://ext.example/', CAST(o_orderkey AS VARCHAR(20)), '?utm=1')
            ELSE concat('https://new.example/', CAST(o_orderkey AS VARCHAR(20)), '/') END AS link,
       CASE WHEN o_orderkey % 4 = 2 THEN concat(' k', CAST(o_orderkey AS VARCHAR(20)))
            ELSE concat('n', CAST(o_orderkey AS VARCHAR(20))) END AS dedupe_key
FROM {orders}"""

VIEW_SQL["queue_v"] = """
SELECT o_orderkey AS id, concat('Src', CAST(o_custkey % 5 AS VARCHAR(20)), ' ') AS source_name,
       concat('https://q.example/', CAST(o_orderkey AS VARCHAR(20)), '#top') AS url,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status,
       o_custkey AS item_id, CAST(o_orderkey % 3 AS INT) AS attempts, CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM {orders}"""
