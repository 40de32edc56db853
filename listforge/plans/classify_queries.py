"""Classification rules and attribute typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from listforge import fixed_values as fv
from listforge.functions import attributes as at, classify as cl, dates as dt, messages as ms
from listforge.operators import listing_query as lq
from listforge.plans.registry import NOW, query

PART = "SELECT p_partkey, {} AS v FROM part"


def _part(name, fn, text, sql):
    @query(name, PART.replace("{}", sql))
    def run(t):
        return t.part.select("p_partkey", fn(F.expr(text)).alias("v"))


def _case(column, labels, other=None):
    """CASE over column % n, usable in both engines."""
    n = len(labels)
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(labels))
    return f"(CASE {column} % {n} {arms} END)"


_part("seniority_word", cl.seniority_word, f"concat(p_name, {_case('p_size', [' Senior dev', ' leader', ' mid level', ' JR.', ' Staff'])})",
      _case("p_size", ["senior", None, "pleno", "junior", "senior"]))
_part("seniority_word_site", lambda c: cl.seniority_word(c, "next_data_board"), f"concat(p_name, {_case('p_size', [' Sênior', ' estágio', ' júnior pleno', ' srx'])})",
      _case("p_size", ["senior", "junior", "pleno", None]))
_part("seniority_substr", cl.seniority_substr, _case("p_size", ["x SRx", "mid-level", "júnior", "Estágio", "specialist", "Team Lead", "nada"]),
      _case("p_size", ["senior", "pleno", "junior", "estagio", "especialista", "lider", None]))
_part("contract_type_infer", cl.contract_type_infer, _case("p_size", ["vaga PJ clt", "Pessoa Jurídica", "CLT", "freela", "Temporário", "nada"]),
      _case("p_size", ["pj", "pj", "clt", "freelancer", "temporario", None]))
_part("contract_type_infer_feed", lambda c: cl.contract_type_infer(c, "rss_feed"), _case("p_size", ["Contractor", "Full Time", "part-time", "x"]),
      _case("p_size", ["pj", "clt", "temporario", None]))
_part("contract_type_infer_words", lambda c: cl.contract_type_infer(c, "next_data_board"), _case("p_size", ["upj x", "só PJ", "efetivo", "temporário"]),
      _case("p_size", [None, "pj", "clt", "temporario"]))
_part("work_model_infer", cl.work_model_infer, _case("p_size", ["Híbrido remoto", "home office", "LATAM", "presencial", "on-site", "x"]),
      _case("p_size", ["hibrido", "remoto", "remoto", "presencial", "presencial", None]))
_part("property_type", cl.property_type, _case("p_size", ["Casa em condomínio", "Chácara", "fazenda x", "Sítio", "Lote 5", "apto"]),
      _case("p_size", ["casa", "chacara", "fazenda", "sitio", "terreno", "casa"]))
_part("asset_type", cl.asset_type, f"concat({_case('p_size', ['Belo Sobrado ', 'IMÓVEL ', 'casas ', 'Prédio '])}, p_name)",
      _case("p_size", ["sobrado", "imóvel", None, "prédio"]))
_part("auction_status", cl.auction_status, _case("p_size", [" Aberto p/ lances", "Em andamento", "Encerrado", "Finalizada", "SUSPENSO", " Outro ", " "]),
      _case("p_size", ["aberto", "aberto", "encerrado", "encerrado", "suspenso", "outro", None]))
_part("product_type", cl.product_type, _case("p_size", ["60 Cápsulas", "goma", "Shake", "comprimido", "Whey", "x"]),
      _case("p_size", ["capsula", "goma", "liquido", "comprimido", "po", "outro"]))
_part("white_label", cl.white_label, _case("p_size", ["White Label", "marca própria", "x"]), "CASE WHEN p_size % 3 < 2 THEN TRUE END")
_part("irrigation", cl.irrigation, _case("p_size", ["com Irrigação", "irrigacao", "seco"]), "CASE WHEN p_size % 3 < 2 THEN TRUE END")
_part("riverbank", cl.riverbank, _case("p_size", ["na Cabeceira", "x"]), "p_size % 2 = 0")
_part("strategy_alias", cl.strategy_alias, _case("p_size", [" HTTP ", "playwright", "basic", "", "x", None]),
      _case("p_size", ["http_antibot", "browser_playwright", "http_basic", "http_basic", "http_basic", "http_basic"]))
_part("enum_value", lambda c: cl.enum_value("auction_status", c, fv.CATEGORY_ATTRIBUTES["auctions"]["auction_status"]),
      _case("p_size", ["Em  Andamento", "Próximo", "ARREMATADO", "vendida", "Suspensa", "aberto"]),
      _case("p_size", ["aberto", "futuro", "encerrado", None, "suspenso", "aberto"]))
_part("enum_value_modality", lambda c: cl.enum_value("modality", c, fv.CATEGORY_ATTRIBUTES["tenders"]["modality"]),
      _case("p_size", ["Pregão - Eletrônico", "Concorrência", "Leilão", "x"]), _case("p_size", ["PREGAO_ELETRONICO", "CONCORRENCIA", "LEILAO", None]))
_part("attribute_key", at.attribute_key, _case("p_size", [" Lote_ID ", "salary_text", "Location", "company", " "]),
      _case("p_size", ["lot_number", "salary_range", None, "company", None]))
_part("string_list", lambda c: F.array_join(at.string_list(c), "|"), "concat(' ', p_name, ';; ', upper(p_name), ' | ', p_type, ',  ')", "p_name || '|' || p_type")
_part("buyer_type", cl.buyer_type, _case("p_size", ["Câmara Municipal X", "TJSP", "Universidade Y", "Prefeitura Z", "Governo do Estado", "Ministério", "Companhia", "Fundação", "Loja", " "]),
      _case("p_size", ["camara", "tribunal", "universidade", "prefeitura", "governo_estadual", "governo_federal", "empresa_estatal", "autarquia", "outro", None]))
_part("region_priority", lambda c: cl.region_priority(c, F.expr("CASE WHEN p_partkey % 2 = 0 THEN '5300108' END"), municipalities=("5300108",)), _case("p_size", ["df", "SP", ""]),
      f"CASE WHEN p_partkey % 2 = 0 THEN 'high' ELSE {_case('p_size', ['medium', 'low', 'unknown'])} END")
_part("vehicle_fields", lambda c: F.concat_ws("|", cl.vehicle_fields(c, F.lit("Fiat"), F.expr("concat('Fiat ', split(p_name, ' ')[0])"))["model"],
                                              cl.vehicle_fields(c, F.lit("Fiat"), F.expr("concat('Fiat ', split(p_name, ' ')[0])"))["version"]),
      "concat('Fiat ', p_name, ' ', p_size)", "split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) || ' ' || p_size")
_part("vehicle_fields_by_position", lambda c: F.to_json(cl.vehicle_fields_by_position(c)),
      f"{_case('p_size', ['FIAT UNO MILLE fire 1.0', 'honda Civic lx sedan', 'gol'])}",
      "CASE p_size % 3 WHEN 0 THEN '{\"brand\":\"Fiat\",\"model\":\"Uno Mille\",\"version\":\"Fire 1.0\"}' WHEN 1 THEN '{\"brand\":\"Honda\",\"model\":\"Civic\",\"version\":\"Sedan\"}' ELSE '{\"brand\":\"Gol\"}' END")

TECH = "developer|engineer|software|python|java|javascript|typescript|backend|frontend|fullstack|full-stack|react|angular|golang|ruby|devops|data|cloud|qa"


@query("tech_listing", f"SELECT doc_id, regexp_matches(lower(text), '{TECH}') AS json_feed, regexp_matches(lower(text), 'programador|desenvolvedor|developer|software|backend|back-end|frontend|front-end|full stack|\\.net|java|php|python') AS title_only FROM documents")
def tech_listing(t):
    return t.documents.select("doc_id", cl.tech_listing(F.col("text")).alias("json_feed"), cl.tech_listing(F.col("text"), "title_only").alias("title_only"))


@query("target_property", "SELECT p_partkey, p_size % 3 = 0 AS cards, p_size % 3 = 0 OR p_size % 3 = 2 AS lots FROM part")
def target_property(t):
    text = F.expr(f"concat({_case('p_size', ['Casa ', 'Casa com sala ', 'Lote '])}, p_brand)")
    return t.part.select("p_partkey", cl.target_property(text).alias("cards"), cl.target_property(text, "auction_lots").alias("lots"))


@query("allowed_category", "SELECT p_partkey, p_size % 4 IN (0, 2) AS v FROM part")
def allowed_category(t):
    return t.part.select("p_partkey", cl.allowed_category(F.expr(_case("p_size", [None, "Design", " Back-End  Programming", "Programming"])),
                                                         F.expr("CASE WHEN p_size % 4 = 3 THEN p_name ELSE concat('Co: ', p_name) END")).alias("v"))


@query("candidate_url", """SELECT page_id, regexp_matches(url, '^https?://') AND len(list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[?#].*$', ''), '/'), lambda x: x <> '')) >= 2 AS detail,
regexp_matches(url, '/lot/\\d+') AS lot, contains(url, '/oferta/') AS offer FROM pages""")
def candidate_url(t):
    u = F.col("url")
    return t.pages.select("page_id", cl.candidate_url(u, "detail_page").alias("detail"), cl.candidate_url(u, "catalog_lot").alias("lot"), cl.candidate_url(u, "offer_page").alias("offer"))


@query("blocked_page", """SELECT page_id, page_id % 10 IN (3, 4) OR page_id % 7 = 0 OR contains(html, 'Sorry, you have been blocked') AS v FROM pages""")
def blocked_page(t):
    status = F.expr("CASE page_id % 10 WHEN 3 THEN 403 WHEN 4 THEN 429 WHEN 5 THEN NULL ELSE 200 END")
    title = F.expr("CASE WHEN page_id % 7 = 0 THEN 'Access DENIED!' ELSE 'ok' END")
    return t.pages.select("page_id", cl.blocked_page(status, title, F.col("html")).alias("v"))


@query("listing_type", f"SELECT p_partkey, {_case('p_size', ['sale', 'rent', 'auction', 'catalog', 'rent'])} AS v FROM part")
def listing_type(t):
    code = F.expr(_case("p_size", [" sell ", None, "AUCTION", None, "lease"]))
    text = F.expr(_case("p_size", ["x", "Para aluguel", "venda", "vendas", "leilão"]))
    return t.part.select("p_partkey", cl.listing_type(code, text).alias("v"))


@query("active_tenders", """SELECT id FROM runs_v WHERE id % 4 NOT IN (0, 1) AND (id % 5 = 0 OR executed_at >= TIMESTAMP '2024-01-20')""", "runs_v")
def active_tenders(t):
    status = F.expr(_case("id", [" Suspensa ", "REVOGADA", "Divulgada", None]))
    end = F.expr("CASE WHEN id % 5 > 0 THEN executed_at END")
    return t.runs_v.where(cl.active_tender(status, end, F.lit("2024-01-20").cast("timestamp"))).select("id")


@query("actionable_now", """SELECT id, id % 3 < 2 AND id % 5 > 0 AS v FROM runs_v""", "runs_v")
def actionable_now(t):
    kind = F.expr(_case("id", ["processo_eletronico", "sistema_origem", "pncp"]))
    window = dt.closing_window_days(F.expr("CASE WHEN id % 5 > 0 THEN executed_at END"), F.lit(NOW))
    return t.runs_v.select("id", cl.actionable_now(kind, window).alias("v"))


@query("auction_ids", """SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS auction, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS code,
CASE WHEN p_size % 2 = 0 THEN '7' ELSE CAST(p_size AS VARCHAR) END AS lot FROM part""")
def auction_ids(t):
    text = F.expr("CASE WHEN p_size % 2 = 0 THEN concat('Leilão ', p_partkey, ' - ', p_size, ' 7 casa') ELSE 'x' END")
    url = F.expr("concat('https://h/leilao/', p_partkey, '/lote/', p_size)")
    return t.part.select("p_partkey", cl.auction_ids(text, url).alias("s")).select("p_partkey", "s.auction", "s.code", "s.lot")


@query("tender_fields", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Lei ' || p_size WHEN p_size % 3 = 1 THEN p_name END AS basis,
CASE p_size % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN FALSE END AS secret,
CASE WHEN p_size % 3 > 0 THEN CAST(p_size % 3 AS INTEGER) END AS sources, CASE WHEN p_size % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 7, '3') END AS code FROM part""")
def tender_fields(t):
    legal = F.expr("map('descricao', CASE WHEN p_size % 3 = 0 THEN concat('Lei  ', p_size) ELSE ' ' END, 'titulo', CASE WHEN p_size % 3 = 1 THEN p_name END)")
    flag = F.expr(_case("p_size", ["Sim", "0", None, None, None]))
    note = F.expr(_case("p_size", [None, "sigiloso", "Sigiloso", "Não se aplica", "talvez"]))
    sources = F.expr("transform(array(1, 2, 3), i -> CASE WHEN i <= p_size % 3 THEN i END)")
    unit = F.expr("map('nome', '1234567', 'codigoIbge', CASE WHEN p_size % 2 = 0 THEN concat(lpad(p_partkey, 7, '3'), ' ') ELSE '12' END)")
    return t.part.select("p_partkey", at.legal_basis(legal).alias("basis"), at.confidential_budget(flag, note).alias("secret"),
                         at.budget_sources(sources).alias("sources"), at.municipality_code(unit).alias("code"))


@query("target_scopes", """SELECT p_partkey, 'SP|RJ' AS ufs, lpad(CAST(p_partkey AS VARCHAR), 7, '3') AS codes, CASE WHEN p_size % 2 = 0 THEN '20240131' ELSE '20240101' END AS since FROM part""")
def target_scopes(t):
    code = "lpad(p_partkey, 7, '3')"
    return t.part.select("p_partkey", F.array_join(at.target_ufs(F.lit(" sp,XX, RJ ,SP,")), "|").alias("ufs"),
                         F.array_join(at.target_codes(F.expr(f"concat({code}, ',12, ', {code})")), "|").alias("codes"),
                         at.scope_date(F.expr("CASE WHEN p_size % 2 = 0 THEN '2024-01-31' ELSE 'x' END"), "20240101").alias("since"))


@query("feature_list", "SELECT p_partkey, p_name || '|' || p_type AS named, CASE WHEN p_size % 2 = 0 THEN lower(p_name) END AS flagged FROM part")
def feature_list(t):
    items = F.expr("""array(map('name', concat(' ', p_name), 'value', 'SIM'), map('label', p_type, 'value', 'NAO'), map('name', p_name, 'value', 'NAO'))""")
    gated = F.expr("array(map('text', upper(p_name), 'value', CASE WHEN p_size % 2 = 0 THEN 'SIM' ELSE 'NAO' END))")
    return t.part.select("p_partkey", F.array_join(at.feature_list(items), "|").alias("named"),
                         F.nullif(F.array_join(at.feature_list(gated, "value", ("text",), lower=True), "|"), F.lit("")).alias("flagged"))


@query("typed_attributes", """SELECT p_partkey, 'Brand ' || p_size AS brand, 1950 + p_size AS year, CAST(p_size * 1000 AS BIGINT) AS mileage_km, CASE WHEN p_size % 2 = 0 THEN 'etanol' END AS fuel_type,
'ar|som' AS features, CAST(NULL AS BIGINT) AS doors FROM part""")
def typed_attributes(t):
    raw = F.expr("""map(' Brand ', concat('Brand  ', p_size), 'YEAR', concat('ano ', 1950 + p_size), 'Mileage', concat(p_size, '.000 km'), 'source', 'x',
        'fuel_type', CASE WHEN p_size % 2 = 0 THEN 'Álcool' ELSE 'água' END, 'features', 'ar; som,AR', 'unknown', '1', 'doors', 'sem')""")
    df = t.part.select("p_partkey", at.typed_attributes(raw, "vehicles").alias("a"))
    return df.select("p_partkey", "a.brand", "a.year", "a.mileage_km", "a.fuel_type", F.array_join("a.features", "|").alias("features"), "a.doors")


@query("message_candidate", """SELECT message_id, regexp_matches(lower(text), 'desenvolvedor|developer|engenheiro|engineer|software|backend|back-end|frontend|front-end|fullstack|full stack|mobile|ios|android|react|angular|vue|node|python|java|golang|go |php|laravel|django|flask|ruby|rails|devops|sre|cloud|dados|data scientist|machine learning|consultor|sap|abap|pmo|qa|tester|tech lead|ti')
AND message_id % 3 = 0 AS v FROM messages_v""", "messages_v")
def message_candidate(t):
    text = F.concat(F.col("text"), F.expr("CASE WHEN message_id % 3 = 0 THEN ' 100% Remoto' ELSE '' END"))
    return t.messages_v.select("message_id", ms.message_candidate(text).alias("v"))


@query("message_aggregate", """SELECT message_id, message_id % 3 = 0 OR message_id % 3 = 1 OR len(list_filter(string_split(text, chr(10)), lambda x:
regexp_matches(lower(x), 'desenvolvedor|developer|engenheiro|engineer|software|backend|back-end|frontend|front-end|fullstack|full stack|mobile|ios|android|react|angular|vue|node|python|java|golang|go |php|laravel|django|flask|ruby|rails|devops|sre|cloud|dados|data scientist|machine learning|consultor|sap|abap|pmo|qa|tester|tech lead|ti'))) >= 4 AS v FROM messages_v""", "messages_v")
def message_aggregate(t):
    extra = F.expr("CASE message_id % 3 WHEN 0 THEN ' Diversas VAGAS' WHEN 1 THEN ' http://a https://b HTTP://c' ELSE '' END")
    return t.messages_v.select("message_id", ms.message_aggregate(F.concat(F.col("text"), extra)).alias("v"))


@query("message_dedupe_key", f"""SELECT message_id, CASE WHEN message_id % 3 = 0 THEN 'link:https://x.example/' || message_id ELSE 'text:' || substr(sha256(concat_ws('|', 'vaga ti', '',
trim(regexp_replace(regexp_replace(lower(translate(text[1:280], 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy')), '[^a-z0-9\\s]', ' ', 'g'), '\\s{{2,}}', ' ', 'g')))), 1, 24) END AS v FROM messages_v""", "messages_v")
def message_dedupe_key(t):
    links = F.expr("CASE WHEN message_id % 3 = 0 THEN array('https://t.me/a/1', concat('https://x.example/', message_id, '/?u=1')) ELSE array('telegram://1/2') END")
    return t.messages_v.select("message_id", ms.message_dedupe_key(F.lit("Vaga TI"), F.lit(None).cast("string"), F.col("text"), links).alias("v"))


ROLE = "split(p_name, ' ')[0]"


@query("message_title", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Desenvolvedor ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] WHEN 1 THEN 'Analista De ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:]
WHEN 2 THEN 'Python Dev ' || p_type ELSE 'Vaga de TI remota' END AS v FROM part""")
def message_title(t):
    text = F.expr(f"""CASE p_size % 4 WHEN 0 THEN concat('🔥 Olá\\nVaga: desenvolvedor ', {ROLE}) WHEN 1 THEN concat('Cargo analista de ', {ROLE}, ' - X')
        WHEN 2 THEN concat('Requisitos: java\\n* python dev ', p_type, '\\nfim') ELSE '' END""")
    return t.part.select("p_partkey", ms.message_title(text, F.array().cast("array<string>")).alias("v"))


@query("message_company", """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Acme ' || p_size WHEN 1 THEN 'Grupo' || p_size WHEN 2 THEN 'Firma X' WHEN 3 THEN 'Beta' || p_size END AS v FROM part""")
def message_company(t):
    text = F.expr("""CASE p_size % 5 WHEN 0 THEN concat('Vaga\\nEmpresa: Acme ', p_size) WHEN 1 THEN concat('Dev\\nvem ser Grupo', p_size)
        WHEN 2 THEN 'envie cv: rh@firma-x.com.br' WHEN 3 THEN concat('Dev\\nconsultoria Beta', p_size) ELSE 'dev java' END""")
    return t.part.select("p_partkey", ms.message_company(text, F.array().cast("array<string>"), F.lit("Dev")).alias("v"))


@query("message_location", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'São Paulo' WHEN p_size % 3 = 1 THEN 'Belo Horizonte' END AS city,
CASE WHEN p_size % 3 = 0 THEN 'SP' WHEN p_size % 3 = 1 THEN 'MG' END AS state FROM part""")
def message_location(t):
    text = F.expr("""CASE p_size % 3 WHEN 0 THEN concat(p_name, '\\nLocal: são paulo / sp') WHEN 1 THEN 'presencial em Belo Horizonte - MG' ELSE 'experiência java / SP' END""")
    return t.part.select("p_partkey", ms.message_location(text).alias("s")).select("p_partkey", "s.city", "s.state")


@query("salary_present", "SELECT id, coalesce(salary_range, 0) > 0 AS v FROM listings_v", "listings_v")
def salary_present(t):
    return t.listings_v.select("id", lq.salary_present(t.listings_v).alias("v"))
