"""Page kernels.  Structure that the test pages lack (state scripts, meta tags, images) is put
around the real page text from the page's own columns, so every kernel reads all pages in full."""

from __future__ import annotations

from pyspark.sql import functions as F

from listforge import fixed_values as fv
from listforge.operators import rollups as ro
from listforge.plans.registry import query
from listforge.plans.text_queries import ENT, WS
from listforge.sources import pages as pg

VISIBLE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '@', 'g'), '(?is)<style\\b[^>]*>.*?</style>', '@', 'g'), '(?s)<!--.*?-->', '@', 'g')"
TEXT = ENT.format("regexp_replace(" + VISIBLE.replace("'@'", "' '") + ", '<[^>]+>', ' ', 'g')")
LINES = ENT.format("regexp_replace(" + VISIBLE.replace("'@'", "chr(10)") + ", '<[^>]+>', chr(10), 'g')")


def around(head: str = "''", tail: str = "''"):
    return F.expr(f"concat({head}, html, {tail})")


@query("scan_pages", "SELECT page_id, url, length(html) AS n FROM pages WHERE length(url) > 20")
def scan_pages(t):
    return t.pages.where(F.length("url") > 20).select("page_id", "url", F.length("html").alias("n"))


@query("page_title", f"SELECT page_id, trim(regexp_replace({ENT.format('''regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')''')}, '{WS}+', ' ', 'g')) AS v FROM pages")
def page_title(t):
    return t.pages.select("page_id", pg.page_title(F.col("html")).alias("v"))


@query("page_text", f"SELECT page_id, trim(regexp_replace({TEXT}, '{WS}+', ' ', 'g')) AS v FROM pages")
def page_text(t):
    return t.pages.select("page_id", pg.page_text(F.col("html")).alias("v"))


@query("page_lines", f"""SELECT page_id, len(ls) AS n, array_to_string(ls, chr(10)) AS v FROM (SELECT page_id,
list_filter(list_transform(string_split(replace({LINES}, chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') AS ls FROM pages)""")
def page_lines(t):
    return t.pages.select("page_id", pg.page_lines(F.col("html")).alias("ls")).select("page_id", F.size("ls").cast("long").alias("n"), F.array_join("ls", "\n").alias("v"))


LINKS = """WITH h AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS root, regexp_extract(url, '^([a-zA-Z]+:)', 1) AS scheme,
regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([a-zA-Z]+://[^/]+.*/)[^/]*$', 1) AS folder,
regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS hrefs FROM pages),
f AS (SELECT page_id, list_filter(list_transform(hrefs, lambda x: regexp_replace(CASE WHEN regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN replace(x, '&amp;', '&')
WHEN starts_with(x, '//') THEN scheme || x WHEN starts_with(x, '/') THEN root || x ELSE CASE WHEN folder = '' THEN root || '/' ELSE folder END || x END, '[?#].*$', '')), lambda u: u <> '') AS l
FROM h) SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS v FROM f"""


@query("page_links", LINKS)
def page_links(t):
    return t.pages.select("page_id", F.array_join(pg.page_links(F.col("html"), F.col("url")), " ").alias("v"))


@query("page_images", """SELECT page_id, 'https://img.example/' || page_id || '.jpg?x=1&y=2 https://img.example/b.PNG' AS v FROM pages""")
def page_images(t):
    tail = """'<img src="https://img.example/', page_id, '.jpg?x=1&amp;y=2"><img src="https://s.example/assets/a.png"><img src=https://img.example/b.PNG><img src="https://img.example/', page_id, '.jpg?x=1&amp;y=2"><i url="https://h/logo.webp">'"""
    return t.pages.select("page_id", F.array_join(pg.page_images(F.expr(f"concat(html, {tail})")), " ").alias("v"))


@query("best_image", """SELECT page_id, 'https://i/?url=a' || page_id || '&width=' || (300 + page_id % 5) || ' https://i/?url=b&width=900&v=2' AS v FROM pages""")
def best_image(t):
    found = F.expr("""array(concat('https://i/?url=a', page_id, '&width=250'), 'https://i/?url=b&width=900', concat('https://i/?url=a', page_id, '&width=', 300 + page_id % 5),
        concat('https://i/?url=a', page_id, '&width=100'), 'https://i/?url=b&width=900&v=2')""")
    return t.pages.select("page_id", F.array_join(pg.best_images(found, r"url=([^\s&]+)"), " ").alias("v"))


@query("longest_text", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || ' b' ELSE url || ' a' END AS v FROM pages")
def longest_text(t):
    texts = F.expr("array('x', concat(url, ' a'), CASE WHEN page_id % 2 = 0 THEN concat(url, '  b') END, concat('  ', url, '    '))")
    longer = F.expr("array('x', CASE WHEN page_id % 2 = 1 THEN concat(url, ' a') ELSE url END, concat(url, '  b', CASE WHEN page_id % 2 = 1 THEN '' ELSE '' END))")
    picked = F.when(F.expr("page_id % 2 = 0"), pg.longest_text(longer)).otherwise(pg.longest_text(texts))
    return t.pages.select("page_id", picked.alias("v"))


@query("page_meta", "SELECT page_id, 'T & ' || page_id AS a, 'd ' || page_id AS b FROM pages")
def page_meta(t):
    html = around("""'<meta property="og:title" content="T  &amp; ', page_id, '"><meta content=\\'d ', page_id, '\\' name="description">'""")
    return t.pages.select("page_id", pg.page_meta(html, "og:title").alias("a"), pg.page_meta(html, "description").alias("b"))


@query("extract_json_key", """SELECT page_id, 'Rua ' || page_id AS street, 'Vila' AS town, CAST(page_id AS DOUBLE) + 0.5 AS price FROM pages""")
def extract_json_key(t):
    html = F.expr(r"""concat(html, '{"street" : "Rua ', page_id, '"}', '{\\"town\\":\\"Vila\\",\\"price\\":', page_id, '.5}')""")
    return t.pages.select("page_id", pg.json_key(html, "street").alias("street"), pg.json_key(html, "town").alias("town"), pg.json_number(html, "price").alias("price"))


@query("extract_jsonld", """SELECT page_id, 'Dev ' || page_id AS title, 'C' || (page_id % 7) AS company FROM pages""")
def extract_jsonld(t):
    html = around("""'<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":["X","jobPosting"],"title":"Dev ', page_id,
        '","hiringOrganization":{"name":"C', page_id % 7, '"}}]}</script>'""", """'<script type="application/ld+json">{"@type":"JobPosting","title":"late"}</script>'""")
    df = t.pages.select("page_id", pg.jsonld(html, "JobPosting").alias("j"))
    return df.select("page_id", F.try_variant_get("j", "$.title", "string").alias("title"), F.try_variant_get("j", "$.hiringOrganization.name", "string").alias("company"))


@query("extract_next_data", "SELECT page_id, 'Job ' || page_id AS title, CAST(page_id AS DOUBLE) AS price FROM pages")
def extract_next_data(t):
    html = around(tail="""'<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"jobData":{"title":"Job ', page_id, '"},"dehydratedState":{"queries":[{"queryKey":["other"],"state":{"data":{"price":0}}},{"queryKey":["Wanted:Key",1],"state":{"data":{"price":', page_id, '}}}]}}}}</script>'""")
    df = t.pages.select("page_id", html.alias("h"))
    return df.select("page_id", F.try_variant_get(pg.next_data(F.col("h"), "$.props.pageProps.jobData"), "$.title", "string").alias("title"),
                     F.try_variant_get(pg.next_data_query(F.col("h"), "Wanted:Key"), "$.price", "double").alias("price"))


@query("extract_hidden_json", "SELECT page_id, i AS pos, CASE i WHEN 0 THEN 'A & B ' || page_id ELSE 'C' END AS title FROM pages, (VALUES (0), (1)) v(i)")
def extract_hidden_json(t):
    html = around("""'<input type="hidden" id="jobs" value="[{&quot;t&quot;:&quot;A &amp; B ', page_id, '&quot;},{&quot;t&quot;:&quot;C&quot;}]">'""")
    return t.pages.select("page_id", F.posexplode(pg.hidden_json(html, "jobs", "struct<t:string>")).alias("pos", "j")).select("page_id", "pos", F.col("j.t").alias("title"))


H1 = ENT.format("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')")
AD = ENT.format("regexp_replace(regexp_extract(html, '(?is)<div class=\"ad\">(.*?)</div>', 1), '<[^>]+>', ' ', 'g')")


@query("page_blocks", f"""SELECT page_id, 'heading' AS field, trim(regexp_replace({H1}, '{WS}+', ' ', 'g')) AS value FROM pages WHERE html LIKE '%<h1>%'
UNION ALL SELECT page_id, 'ad', trim(regexp_replace({AD}, '{WS}+', ' ', 'g')) FROM pages WHERE html LIKE '%<div class="ad">%'
UNION ALL SELECT page_id, 'lang', regexp_extract(html, '<html lang="([^"]+)"', 1) FROM pages""")
def page_blocks(t):
    return pg.page_blocks(t.pages, [{"field": "heading", "tag": "h1"}, {"field": "ad", "tag": "div", "class": "ad"}, {"field": "lang", "tag": "html", "attr": "lang"}])


# --- line rules: lines are written from the columns of part ---------------------------------
@query("page_label_values", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'VW' ELSE 'Fiat ' || p_size END AS brand, CASE WHEN p_size % 3 > 0 THEN p_name END AS model FROM part""")
def page_label_values(t):
    lines = F.expr("""concat(array('Marca', concat('Fiat ', p_size), 'Modelo'), CASE WHEN p_size % 3 > 0 THEN array(p_name) ELSE array('Cor', 'azul') END,
        CASE WHEN p_size % 2 = 0 THEN array('Marca', 'VW') ELSE array('Marca') END)""")
    df = t.part.select("p_partkey", pg.label_values(lines, fv.VEHICLE_LABELS).alias("m"))
    return df.select("p_partkey", F.try_element_at("m", F.lit("Marca")).alias("brand"), F.try_element_at("m", F.lit("Modelo")).alias("model"))


@query("next_line", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_name END AS v FROM part")
def next_line(t):
    lines = F.expr("array('x', 'Ano', CASE WHEN p_size % 3 > 0 THEN p_name ELSE 'Cor' END, 'y')")
    return t.part.select("p_partkey", F.try_element_at(pg.label_values(lines, ["Ano", "Cor"]), F.lit("Ano")).alias("v"))


@query("page_label_prefix_values", "SELECT p_partkey, p_name AS city, CASE WHEN p_size % 2 = 0 THEN 'SP ' || p_size ELSE 'Bahia' END AS state FROM part")
def page_label_prefix_values(t):
    lines = F.expr("array('Informações', concat('cidade: ', p_name), 'Estado/Província - Bahia', CASE WHEN p_size % 2 = 0 THEN concat('Estado/Província: SP ', p_size) ELSE 'x' END)")
    df = t.part.select("p_partkey", pg.label_prefix_values(lines, fv.JOB_INFO_LABELS).alias("m"))
    return df.select("p_partkey", F.try_element_at("m", F.lit("Cidade")).alias("city"), F.try_element_at("m", F.lit("Estado/Província")).alias("state"))


@query("page_block_between", "SELECT p_partkey, p_name || '|' || p_type AS v FROM part")
def page_block_between(t):
    text = F.expr("concat('antes\\nItens de veículo\\n', p_name, '\\nx\\nExibir todas 9\\n', p_type, '\\n', p_name, '\\nSobre o vendedor\\nfim')")
    return t.part.select("p_partkey", F.array_join(pg.block_between(text, "Itens de veículo", "Sobre o vendedor"), "|").alias("v"))


@query("page_section_after_heading", "SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '|' || p_type ELSE '' END AS v FROM part")
def page_section_after_heading(t):
    lines = F.expr("concat(array('About', 'About the job', p_name), CASE WHEN p_size % 2 = 0 THEN array(p_type) ELSE array() END, array('About the company', 'z', 'About the job'))")
    return t.part.select("p_partkey", F.array_join(pg.section_after(lines, "(?i)^about the job", "(?i)^about the company"), "|").alias("v"))


@query("enrich_listing_detail", """SELECT l.id, coalesce(nullif(d.title, ''), l.title) AS title, coalesce(l.company, d.company) AS company, coalesce(d.city, l.city) AS city
FROM listings_v l LEFT JOIN (SELECT url, CASE WHEN id % 3 = 0 THEN '' ELSE 'detail ' || id END AS title, 'other' AS company, CASE WHEN id % 4 = 0 THEN 'Natal' END AS city
FROM listings_v) d ON d.url = CASE WHEN l.id % 5 > 0 THEN l.url END""", "listings_v")
def enrich_listing_detail(t):
    from listforge.operators.detail import enrich_listing_detail as enrich

    detail = t.listings_v.select(F.expr("CASE WHEN id % 5 > 0 THEN url ELSE concat(url, '&gone') END").alias("url"), F.expr("CASE WHEN id % 3 = 0 THEN '' ELSE concat('detail ', id) END").alias("title"),
                                                     F.lit("other").alias("company"), F.expr("CASE WHEN id % 4 = 0 THEN 'Natal' END").alias("city"))
    return enrich(t.listings_v.select("id", "url", "title", "company", "city"), detail, detail_first=["title", "city"], list_first=["company"]).select("id", "title", "company", "city")


@query("first_seen_links", """WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)
SELECT href, min(page_id) AS page_id FROM x GROUP BY 1""")
def first_seen_links(t):
    links = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pg.ANCHOR_HREF), F.lit(1))).alias("pos", "href"))
    return ro.first_seen(links, "href", ["page_id", "pos"]).select("href", "page_id")
