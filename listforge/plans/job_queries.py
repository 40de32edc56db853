"""Batch jobs: feeds, pages, tenders and messages to listings; normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from listforge.operators import normalize as nm
from listforge.plans.registry import NOW, query
from listforge.session import scratch_folder
from listforge.sources import feeds as fe, mappings as mp, tables as tb

A = ("amounts_v",)
P = ("places_v",)


# --- feeds: bodies built from orders ------------------------------------------------------------
def _bodies(df, entry, opening, closing):
    """One fetched body per order."""
    return df.select(F.col("o_orderkey").alias("page"), F.concat(F.lit(opening), entry, F.lit(closing)).alias("body"))


JSON_ENTRY = """to_json(struct(concat('', o_orderkey) as id, concat('https://f.example/', o_orderkey) as url, concat(' Co ', o_custkey) as company,
CASE WHEN o_custkey % 2 = 0 THEN concat('Senior Python dev ', o_orderkey) ELSE concat('Cook ', o_orderkey) END as position,
'<p>Full-time role</p><p>5+ years</p>' as description, o_totalprice as salary_min, o_totalprice + 1000 as salary_max, 'https://apply.example' as apply_url, array('remote') as tags))"""


def json_bodies(t):
    good = _bodies(t.dealt("orders"), F.expr(JSON_ENTRY), '[{"legal":"read the terms"},', "]")
    return good.union(good.select("page", F.concat(F.lit("{broken "), "body")))


def _files(t, entry, opening, closing, name, broken=None):
    """Feed files of a thousand orders each, and one that cannot be read."""
    folder = scratch_folder(t.spark, name)
    pages = t.orders.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("page")).agg(F.collect_list(F.expr(entry)).alias("entries"))
    pages.select("page", F.concat(F.lit(opening), F.array_join("entries", ","), F.lit(closing)).alias("body")).write.partitionBy("page").text(folder)
    if broken:
        t.spark.range(1).select(F.lit(-1).alias("page"), F.lit(broken).alias("body")).write.mode("append").partitionBy("page").text(folder)
    return folder


@query("read_json_feed", "SELECT CAST(o_orderkey AS VARCHAR) AS id, 'https://f.example/' || o_orderkey AS url, o_totalprice AS salary_min FROM orders")
def read_json_feed(t):
    folder = _files(t, JSON_ENTRY, '[{"legal":"read the terms"},', "]", "json-feed", '{broken [{"id":"1"}]')
    return fe.read_json_feed(t.spark, folder).select("id", "url", "salary_min")


RSS_ENTRY = """concat('<item><title>Co ', o_custkey, ': ', CASE WHEN o_custkey % 2 = 0 THEN 'Backend Engineer' ELSE 'Nurse' END, '</title><link>https://r.example/', o_orderkey,
'</link><category>', CASE WHEN o_custkey % 3 = 0 THEN 'Design' ELSE 'Back-End Programming' END, '</category><region>Anywhere</region><description><![CDATA[<p>Pays $', cast(floor(o_totalprice / 1000) as int), 'k</p>]]></description></item>')"""


def rss_bodies(t):
    return _bodies(t.dealt("orders"), F.expr(RSS_ENTRY), "<rss><channel>", "</channel></rss>")


@query("read_rss_feed", "SELECT 'https://r.example/' || o_orderkey AS link, CASE WHEN o_custkey % 3 = 0 THEN 'Design' ELSE 'Back-End Programming' END AS category FROM orders")
def read_rss_feed(t):
    folder = _files(t, RSS_ENTRY, "<rss><channel>", "</channel></rss>", "rss-feed", "no feed at all")
    return fe.read_rss_feed(t.spark, folder).select("link", "category")


TENDER_ENTRY = """concat('{"numeroControlePNCP":"', lpad(o_orderkey, 14, '1'), '-1-', lpad(o_custkey, 6, '0'), '/2024","numeroCompra":"', o_orderkey, '","objetoCompra":"',
CASE WHEN o_custkey % 2 = 0 THEN 'Desenvolvimento de software' ELSE 'Aquisição de toner' END, '","situacaoCompraNome":"', CASE WHEN o_custkey % 5 = 0 THEN 'Suspensa' ELSE 'Divulgada no PNCP' END,
'","valorTotalEstimado":', o_totalprice, ',"modalidadeNome":"Pregão - Eletrônico","dataEncerramentoProposta":"2024-02-0', 1 + o_custkey % 9, 'T12:00:00",',
'"orgaoEntidade":{"cnpj":"11.222","razaoSocial":"Prefeitura de X"},"unidadeOrgao":{"ufSigla":"MG","municipioNome":"Belo Vale","codigoIbge":"3106408"},"fontesOrcamentarias":["a",null]}')"""


def tender_bodies(t):
    return _bodies(t.dealt("orders"), F.expr(TENDER_ENTRY), '{"data":[3,', '],"totalPaginas":9}')


@query("read_paged_api", "SELECT lpad(CAST(o_orderkey AS VARCHAR), 14, '1') || '-1-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '/2024' AS number, CAST(o_orderkey AS VARCHAR) AS notice FROM orders")
def read_paged_api(t):
    folder = _files(t, TENDER_ENTRY, '{"data":[3,', '],"totalPaginas":9}', "paged-api", "{not json")
    return fe.read_paged_api(t.spark, folder, mp.TENDER_SCHEMA).select(F.col("numeroControlePNCP").alias("number"), F.col("numeroCompra").alias("notice"))


@query("extract_job_feed", """SELECT 'https://f.example/' || o_orderkey AS url, 'Senior Python dev ' || o_orderkey AS title, o_totalprice AS price, 'senior' AS seniority, 'clt' AS contract_type, 5 AS years,
'Co ' || o_custkey AS company FROM orders WHERE o_custkey % 2 = 0
UNION ALL SELECT 'https://r.example/' || o_orderkey, 'Backend Engineer', floor(o_totalprice / 1000) * 1000, NULL, NULL, NULL, 'Co ' || o_custkey FROM orders WHERE o_custkey % 2 = 0 AND o_custkey % 3 > 0""")
def extract_job_feed(t):
    json_rows = mp.extract("json_feed_jobs", fe.parse_json_feed(json_bodies(t)))
    rss_rows = mp.extract("rss_feed_jobs", fe.parse_rss_feed(rss_bodies(t)))
    return json_rows.unionByName(rss_rows).select("url", "title", "price", "typed.seniority", "typed.contract_type", F.col("typed.experience_years").alias("years"), "typed.company")


@query("extract_tenders", """SELECT 'https://pncp.gov.br/app/editais/' || lpad(CAST(o_orderkey AS VARCHAR), 14, '1') || '/2024/' || o_custkey AS url, 'Pregão - Eletrônico ' || o_orderkey || ' - ' ||
CASE WHEN o_custkey % 2 = 0 THEN 'Desenvolvimento de software' ELSE 'Aquisição de toner' END AS title, o_totalprice AS price, 'MG' AS state, 'PREGAO_ELETRONICO' AS modality, 'ABERTA' AS status,
CASE WHEN o_custkey % 2 = 0 THEN 95 ELSE 0 END AS score, CASE WHEN o_custkey % 2 = 0 THEN 'software_development' END AS subtype, 2 + o_custkey % 9 AS days, 'prefeitura' AS buyer, 'medium' AS region, 1 AS sources,
CASE WHEN o_totalprice <= 100000 THEN 'ate_100k' WHEN o_totalprice <= 500000 THEN '100k_500k' ELSE '500k_1m' END AS band FROM orders WHERE o_custkey % 5 > 0""")
def extract_tenders(t):
    entries = fe.parse_paged_api(tender_bodies(t), mp.TENDER_SCHEMA)
    out = mp.extract("api_tenders", entries, now=F.lit(NOW))
    x = lambda n: F.col(f"typed.{n}")
    return out.select("url", "title", "price", "state", x("modality"), x("status"), x("software_fit_score").alias("score"), x("software_subtype").alias("subtype"),
                      x("closing_window_days").alias("days"), x("buyer_type").alias("buyer"), x("region_priority").alias("region"), x("budget_source_count").alias("sources"), x("estimated_value_band").alias("band"))


# --- pages: every page gets the block its family needs -----------------------------------------
PAGES_PER_TASK = 2_000


class SplitPages:
    """The pages in files of a bounded number, split once for all families that read them."""

    def __init__(self, t):
        self.pages = tb.split(t.pages, PAGES_PER_TASK)


def _page(t, block):
    return t.pages.select("page_id", F.concat(F.lit("https://p.example/x/"), "page_id").alias("url"), F.expr(f"concat({block}, html)").alias("html"))


def _after(t, block):
    return t.pages.select("page_id", F.concat(F.lit("https://p.example/x/"), "page_id").alias("url"), F.expr(f"concat(html, {block})").alias("html"))


URL = "'https://p.example/x/' || page_id AS url"
STATE = """'<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":"""


@query("extract_job_pages", f"""SELECT {URL}, 'ld' AS family, 'Dev Java ' || page_id AS title, CAST(page_id + 100 AS DOUBLE) AS price, 'Acme' AS company, 'Belo Vale' AS city, 'MG' AS state FROM pages
UNION ALL SELECT {URL}, 'next', 'Dev Python ' || page_id, CAST(page_id + 5000 AS DOUBLE), 'Beta', NULL, NULL FROM pages
UNION ALL SELECT 'https://h.example/' || page_id, 'hidden', 'Programador ' || page_id, 4500.5, 'Gama', 'Natal', 'RN' FROM pages
UNION ALL SELECT {URL}, 'key', 'Lead Dev ' || page_id, NULL, 'Delta', 'Campinas', 'SP' FROM pages
UNION ALL SELECT {URL}, 'meta', 'Go Dev ' || page_id, 90000.0, NULL, NULL, NULL FROM pages
UNION ALL SELECT {URL}, 'heading', 'Node Dev ' || page_id, 80000.0, NULL, 'Remote', NULL FROM pages
UNION ALL SELECT {URL}, 'label', 'Arquiteto ' || page_id, NULL, NULL, 'Natal', 'RN' FROM pages""")
def extract_job_pages(t):
    t = SplitPages(t)
    ld = _page(t, """'<script type="application/ld+json">{"@type":"JobPosting","title":"dev  Java ', page_id, '","hiringOrganization":{"name":"Acme"},"jobLocation":{"address":{"addressLocality":"Belo Vale","addressRegion":"MG"}},"baseSalary":{"currency":"BRL","value":{"minValue":"', page_id + 100, '"}}}</script>'""")
    nx = _page(t, STATE + """{{"jobData":{{"title":"Dev Python ', page_id, '","company":{{"name":"Beta"}},"jobSalary":{{"value":{{"minimum":', page_id + 5000, '}}}},"description":"<p>x</p>"}}}}}}}}</script>'""".replace("{{", "{").replace("}}", "}").replace('"pageProps":{{', '"pageProps":{'))
    hidden = _page(t, """'<input id="jobs" value="[{&quot;url&quot;:&quot;https://h.example/', page_id, '&quot;,&quot;title&quot;:&quot;programador ', page_id, '&quot;,&quot;company&quot;:&quot;Gama&quot;,&quot;salary&quot;:&quot;R$ 4.500,50&quot;,&quot;city&quot;:&quot;Natal&quot;,&quot;state&quot;:&quot;RN&quot;}]">'""")
    key = _page(t, """'<h1>Lead Dev ', page_id, '</h1><script>{"name":"Delta","addressLocality":"Campinas","addressRegion":"SP","employmentType":"FULL_TIME"}</script>'""")
    meta = _page(t, """'<meta property="og:title" content="Go Dev ', page_id, ' - VanHack"><p>$90,000 up to $99,000 USD/year</p>'""")
    heading = _page(t, """'<h1>Node Dev ', page_id, '</h1><ul><li>Remote (Brazil)</li></ul><p>$80k – $90k</p><h2>About the job</h2><p>Senior role</p><h2>About the company</h2>'""")
    label = _page(t, """'<title>Arquiteto ', page_id, '</title><ul><li>Cidade: Natal</li><li>Estado/Província: Rio Grande do Norte</li><li>Trabalho remoto: Sim</li></ul>'""")
    parts = [("ld", "jsonld_jobs", ld), ("next", "next_data_jobs", nx), ("hidden", "hidden_json_jobs", hidden), ("key", "json_key_jobs", key), ("meta", "meta_jobs", meta), ("heading", "heading_jobs", heading), ("label", "label_jobs", label)]
    out = None
    for family, name, pages in parts:
        df = mp.extract(name, pages).select("url", F.lit(family).alias("family"), "title", "price", "typed.company", "city", "state")
        out = df if out is None else out.unionByName(df)
    return out


@query("extract_vehicles", f"""SELECT {URL}, 'ld' AS family, 'Fiat Uno' AS title, CAST(page_id + 20000 AS DOUBLE) AS price, 'Fiat' AS brand, 2010 + page_id % 9 AS year FROM pages
UNION ALL SELECT {URL}, 'next', 'VW Gol 2015 Trend', CAST(page_id + 30000 AS DOUBLE), 'VW', 2015 FROM pages
UNION ALL SELECT {URL}, 'lines', 'Honda Civic LX', 45000.0, 'Honda', 2012 FROM pages""")
def extract_vehicles(t):
    ld = _page(t, """'<script type="application/ld+json">{"@type":"Vehicle","name":"Fiat Uno","brand":{"name":"Fiat"},"vehicleModelDate":"', 2010 + page_id % 9, '","offers":{"price":', page_id + 20000, '}}</script>'""")
    nx = _page(t, STATE + """{"deal":{"make":"VW","model":"Gol","year":2015,"trim":"Trend","price":', page_id + 30000, '}}}}</script>'""")
    lines = t.pages.select("page_id", F.concat(F.lit("https://p.example/x/"), "page_id").alias("url"), F.expr("""concat('<title>Honda Civic LX</title><p>R$ 45.000,00</p><p>Marca</p><p>Honda</p><p>Modelo</p><p>Honda Civic</p><p>Ano</p><p>2012</p><p>Cor</p>', html)""").alias("html"))
    out = None
    for family, name, pages in (("ld", "jsonld_vehicles", ld), ("next", "next_data_vehicles", nx), ("lines", "line_vehicles", lines)):
        df = mp.extract(name, pages).select("url", F.lit(family).alias("family"), "title", "price", "typed.brand", "typed.year")
        out = df if out is None else out.unionByName(df)
    return out


@query("extract_properties", f"""SELECT {URL}, 'next' AS family, 'Casa com 3 quartos à venda em Centro, Natal' AS title, CAST(page_id + 200000 AS DOUBLE) AS price, 3 AS bedrooms, 'Rua A - Centro' AS street FROM pages
UNION ALL SELECT {URL}, 'query', 'Casa com 5 quartos ou + à venda em Sul, Belo Vale', CAST(page_id + 300000 AS DOUBLE), 6, 'Rua B - Sul' FROM pages
UNION ALL SELECT {URL}, 'key', 'Casa boa', CAST(page_id + 400000 AS DOUBLE), 2, 'Rua C, 9 - Norte' FROM pages
UNION ALL SELECT {URL}, 'text', 'Apartamento Natal - RN', 500000.0, 4, NULL FROM pages""")
def extract_properties(t):
    nx = _page(t, STATE + """{"initialState":{"house":{"houseInfo":{"type":"Casa","bedrooms":3,"salePrice":', page_id + 200000, ',"address":{"street":"Rua A","neighborhood":"Centro","city":"Natal"}}}}}}}</script>'""")
    qr = _page(t, STATE + """{"dehydratedState":{"queries":[{"queryKey":["Sales:X"],"state":{"data":{"bedrooms":6,"price":', page_id + 300000, ',"address":{"streetName":"Rua B","neighborhood":"Sul","city":"Belo Vale"}}}}]}}}}</script>'""")
    key = _page(t, r"""'<title>Casa boa</title><script>{\\"mainValue\\":', page_id + 400000, ',\\"bedrooms\\":\\"2\\",\\"street\\":\\"Rua C\\",\\"streetNumber\\":\\"9\\",\\"neighborhood\\":\\"Norte\\"}</script>'""")
    text = _page(t, """'<title>Apartamento Natal - RN</title><p>4 quartos</p><p>Condomínio</p><p>R$ 900.000</p><p>a</p><p>b</p><p>R$ 500.000</p><p>Venda</p>'""")
    out = None
    for family, name, pages, options in (("next", "next_data_properties", nx, {}), ("query", "query_properties", qr, {"literal": "Sales:X"}), ("key", "json_key_properties", key, {}), ("text", "text_properties", text, {})):
        df = mp.extract(name, pages, **options).select("url", F.lit(family).alias("family"), "title", "price", "typed.bedrooms", "street")
        out = df if out is None else out.unionByName(df)
    return out


@query("extract_auctions", f"""SELECT {URL}, 'next' AS family, 'Casa ' || page_id AS title, CAST(page_id + 100000 AS DOUBLE) AS price, 'aberto' AS status, '7' AS lot FROM pages
UNION ALL SELECT 'https://p.example/leilao/' || page_id || '/lote/3', 'text', 'Terreno em Natal - RN', 80000.0, 'aberto', '3' FROM pages
UNION ALL SELECT 'https://p.example/lot/' || page_id, 'lot', 'Lote bom', 1234.5, NULL, CAST(page_id AS VARCHAR) FROM pages""")
def extract_auctions(t):
    nx = _page(t, STATE + """{"offerDetails":{"offers":[{"title":"Casa ', page_id, '","price":', page_id + 100000, ',"status":"Aberto","lotNumber":"7"}]}}}}</script>'""")
    text = _page(t, """'<title>Terreno em Natal - RN</title><p>1ª praça 10/02/2024 às 10:00 R$ 100.000,00</p><p>2ª praça 20/02/2024 às 10:00 R$ 80.000,00</p>'""").withColumn(
        "url", F.concat(F.lit("https://p.example/leilao/"), "page_id", F.lit("/lote/3")))
    lot = _page(t, """'<title>Lote bom</title><p>R$ 1.234,50</p>'""").withColumn("url", F.concat(F.lit("https://p.example/lot/"), "page_id", F.lit("/?a=1")))
    out = None
    for family, name, pages in (("next", "next_data_auctions", nx), ("text", "text_auctions", text), ("lot", "lot_auctions", lot)):
        df = mp.extract(name, pages).select("url", F.lit(family).alias("family"), "title", "price", F.col("typed.auction_status").alias("status"), F.col("typed.lot_number").alias("lot"))
        out = df if out is None else out.unionByName(df)
    return out


@query("extract_farms", f"""SELECT {URL}, 'key' AS family, 'Fazenda em Natal - RN' AS title, CAST(page_id + 900000 AS DOUBLE) AS price, 12.5 AS area, 'sale' AS kind, 'RN' AS state FROM pages
UNION ALL SELECT {URL}, 'text', 'Sítio 30,5 ha em Belo Vale - MG', 700000.0, 30.5, 'sale', 'MG' FROM pages""")
def extract_farms(t):
    key = _page(t, """'<title>Fazenda em Natal - RN</title><script>{"price":', page_id + 900000, ',"area":125000,"areaType":"m2","businessType":"SELL"}</script>'""")
    text = _page(t, """'<h1>Sítio 30,5 ha em Belo Vale - MG</h1><p>R$ 1,00</p><p>Valor do investimento: R$ 700.000,00</p>'""")
    out = None
    for family, name, pages in (("key", "json_key_farms", key), ("text", "text_farms", text)):
        df = mp.extract(name, pages).select("url", F.lit(family).alias("family"), "title", "price", F.col("typed.area_hectares").alias("area"), F.col("typed.listing_type").alias("kind"), "state")
        out = df if out is None else out.unionByName(df)
    return out


@query("extract_supplements", f"SELECT {URL}, 'Whey ' || page_id AS title, 'po' AS kind, '900g, 1kg' AS size, TRUE AS white_label FROM pages")
def extract_supplements(t):
    pages = _page(t, """'<title>Whey ', page_id, '</title><h5>EMBALAGENS</h5><p>900g</p><p>1kg</p><h5>SABORES</h5><p>Baunilha</p><p>Descrição</p><p>White label</p>'""")
    return mp.extract("text_supplements", pages).select("url", "title", F.col("typed.product_type").alias("kind"), F.col("typed.package_size").alias("size"), "typed.white_label")


# --- messages ----------------------------------------------------------------------------------
@query("extract_messages", """SELECT 'telegram://7/' || p_partkey AS url, 'Desenvolvedor Java ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS title, 'Acme' AS company, 'Campinas' AS city, 'SP' AS state, 9000.0 + p_size AS salary, 'remoto' AS work_model, 'pj' AS contract_type,
'link:https://v.example/' || p_partkey AS dedupe_key FROM part WHERE p_size % 2 = 0""")
def extract_messages(t):
    text = F.expr("""CASE WHEN p_size % 2 = 0 THEN concat('🔥 Vaga: desenvolvedor java ', split(p_name, ' ')[0], ' - Acme - Campinas / SP\\nSalário: R$ ', 9000 + p_size, '\\n100% remoto, PJ\\nhttps://v.example/', p_partkey, '?x=1')
        ELSE concat('novas vagas remotas java ', p_name) END""")
    messages = t.dealt("part").select(F.lit("7").alias("chat_id"), F.lit("Vagas").alias("chat_title"), F.lit(None).cast("string").alias("username"), F.col("p_partkey").alias("message_id"), text.alias("text"),
                             F.lit(None).cast("string").alias("ocr_text"), F.lit(NOW).alias("posted_at"), F.lit(False).alias("has_image"))
    x = lambda n: F.col(f"typed.{n}")
    return mp.extract("chat_jobs", messages).select("url", "title", x("company"), "city", "state", x("salary_range").alias("salary"), x("work_model"), x("contract_type"), x("dedupe_key"))


# --- normalization -----------------------------------------------------------------------------
@query("normalize_listings", """SELECT id, upper(trim(regexp_replace(title, '\\s+', ' ', 'g'))[1]) || trim(regexp_replace(title, '\\s+', ' ', 'g'))[2:] AS title, 'Senior ' || lower(split_part(title, '  ', 2)) || ' & co' AS description,
coalesce(price, 5000.0) AS price, CASE WHEN id % 2 = 0 THEN 'Natal' ELSE coalesce(trim(regexp_replace(city, '\\s+', ' ', 'g')), 'Belo Vale') END AS city,
coalesce(upper(state), CASE WHEN id % 2 = 0 THEN 'RN' ELSE 'MG' END) AS state, 5000.0 AS salary, 'mensal' AS salary_type, 'remoto' AS work_model, CASE contract_type WHEN 'PJ' THEN 'pj' WHEN 'clt' THEN 'clt' END AS contract_type
FROM listings_v""", "listings_v")
def normalize_listings(t):
    raw = nm.payload(
        t.listings_v, keep=("id",), url=F.col("url"), title=F.col("title"), description=F.col("description"), price=F.col("price"), currency=F.col("currency"),
        city=F.expr("CASE WHEN id % 2 = 0 THEN 'Natal' ELSE city END"), state=F.col("state"), location_raw=F.expr("CASE WHEN id % 2 = 0 THEN 'em natal - rn' END"),
        attributes=F.expr("map('Salary_Text', 'R$ 5.000 por mês', 'source', 'x', 'location_raw', 'Belo  vale / MG', 'work_model', 'Home Office', 'contract_type', contract_type, 'other', 'y')"))
    out = nm.normalize_listings(raw, "jobs")
    x = lambda n: F.col(f"typed.{n}")
    return out.select("id", "title", "description", "price", "city", "state", x("salary_range").alias("salary"), x("salary_type"), x("work_model"), x("contract_type"))
