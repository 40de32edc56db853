"""Fixed values.

Everything in this module is data that has to be equal on both sides for a query
to give the right answer: attribute whitelists, enum values, alias tables, word
lists, scoring rules and text patterns.  There is no logic here.
"""

# --- fixed values: Brazilian states -------------------------------------------------
STATE_NAMES = {
    "acre": "AC", "alagoas": "AL", "amapa": "AP", "amazonas": "AM", "bahia": "BA",
    "ceara": "CE", "distrito federal": "DF", "espirito santo": "ES", "goias": "GO",
    "maranhao": "MA", "mato grosso": "MT", "mato grosso do sul": "MS",
    "minas gerais": "MG", "para": "PA", "paraiba": "PB", "parana": "PR",
    "pernambuco": "PE", "piaui": "PI", "rio de janeiro": "RJ",
    "rio grande do norte": "RN", "rio grande do sul": "RS", "rondonia": "RO",
    "roraima": "RR", "santa catarina": "SC", "sao paulo": "SP", "sergipe": "SE",
    "tocantins": "TO",
}
UFS = list(STATE_NAMES.values())

# --- fixed values: attribute whitelist per category (type, or list of enum values) --
CATEGORY_ATTRIBUTES = {
    "vehicles": {
        "year": "year", "mileage_km": "int", "brand": "string", "model": "string",
        "version": "string", "body_type": "string",
        "fuel_type": ["gasolina", "etanol", "flex", "diesel", "eletrico", "hibrido", "gnv"],
        "doors": "int", "color": "string", "engine": "string", "features": "list_string",
        "transmission": ["manual", "automatica", "cvt", "automatizada"],
    },
    "properties": {
        "listing_type": ["sale", "rent", "auction"],
        "property_type": ["apartamento", "casa", "cobertura", "terreno", "chacara", "sitio",
                          "fazenda", "galpao", "comercial", "rural", "outro"],
        "bedrooms": "int", "bathrooms": "int", "parking_spots": "int", "floor": "int",
        "total_area_m2": "float", "building_area_m2": "float",
    },
    "jobs": {
        "company": "string", "country": "string", "salary_range": "salary",
        "salary_type": ["anual", "mensal", "semanal", "diario", "horario", "outro"],
        "seniority": ["estagio", "junior", "pleno", "senior", "especialista", "lider", "outro"],
        "contract_type": ["clt", "pj", "temporario", "estagio", "freelancer", "cooperado",
                          "aprendiz", "intermitente"],
        "work_model": ["presencial", "hibrido", "remoto"],
        "experience_years": "int", "telegram_chat": "string", "telegram_chat_id": "string",
        "telegram_message_id": "int", "telegram_posted_at": "datetime",
        "source_message_type": ["text", "image", "mixed"], "ocr_used": "bool",
        "telegram_public_url": "string", "telegram_canonical_url": "string",
        "dedupe_key": "string",
    },
    "tenders": {
        "agency_name": "string", "agency_tax_id": "string", "portal_name": "string",
        "source_record_id": "string", "process_number": "string", "notice_number": "string",
        "complementary_info": "string", "mode_dispute": "string", "instrument_type": "string",
        "amparo_legal": "string",
        "modality": ["PREGAO_ELETRONICO", "PREGAO_PRESENCIAL", "CONCORRENCIA", "DISPENSA",
                     "INEXIGIBILIDADE", "LEILAO", "CONCURSO", "CREDENCIAMENTO",
                     "CHAMAMENTO_PUBLICO", "OUTRO"],
        "status": ["ABERTA", "RECEBENDO_PROPOSTAS", "EM_DISPUTA", "SUSPENSA", "ADIADA",
                   "ENCERRADA", "HOMOLOGADA", "FRACASSADA", "DESERTA", "REVOGADA", "ANULADA"],
        "publication_date": "date", "opening_at": "datetime", "proposal_end_at": "datetime",
        "closing_window_days": "int", "estimated_value": "float",
        "estimated_value_band": ["ate_100k", "100k_500k", "500k_1m", "acima_1m"],
        "proposal_url": "string",
        "proposal_link_type": ["processo_eletronico", "sistema_origem", "pncp"],
        "actionable_now": "bool",
        "buyer_type": ["prefeitura", "camara", "tribunal", "universidade", "empresa_estatal",
                       "governo_estadual", "governo_federal", "autarquia", "outro"],
        "region_priority": ["high", "medium", "low", "unknown"],
        "srp": "bool", "budget_confidential": "bool", "budget_source_count": "int",
        "software_focus": "bool", "software_fit_score": "int",
        "software_subtype": ["software_licensing", "software_development", "systems_maintenance",
                             "data_bi", "cloud_infra", "mixed_ti", "other_ti"],
        "delivery_model_hint": ["licenca", "implantacao", "sustentacao", "fabrica_software",
                                "servico_continuado", "desenvolvimento", "outro"],
        "technology_keywords": "list_string", "judgment_criterion": "string",
        "document_count": "int", "dedupe_key": "string",
    },
    "auctions": {
        "listing_type": ["auction", "catalog", "direct_sale"],
        "auction_id": "string", "lot_number": "string", "auction_code": "string",
        "auction_date": "date", "discount_pct": "float",
        "auction_status": ["aberto", "futuro", "encerrado", "suspenso", "cancelado"],
        "auction_start_at": "datetime", "auction_end_at": "datetime", "asset_type": "string",
        "appraisal_value": "float", "minimum_bid": "float", "current_bid": "float",
        "auctioneer": "string",
    },
    "agribusiness": {
        "listing_type": ["sale", "rent", "auction", "catalog"],
        "area_hectares": "float", "offer_count": "int", "auction_date": "date",
        "riverbank": "bool", "irrigation": "bool",
    },
    "supplements": {
        "supplier_count": "int",
        "product_type": ["capsula", "comprimido", "po", "liquido", "goma", "outro"],
        "package_size": "string", "concentration": "string", "certifications": "list_string",
        "white_label": "bool",
    },
}
FORBIDDEN_ATTRIBUTES = ["source", "source_platform", "platform", "location_raw",
                        "raw_location", "location.raw", "location"]
RAW_LOCATION_ATTRIBUTES = ["location_raw", "raw_location", "location.raw"]
ATTRIBUTE_ALIASES = {
    "mileage": "mileage_km", "discount": "discount_pct", "salary_text": "salary_range",
    "salary_period": "salary_type", "salary_frequency": "salary_type",
    "salary_unit": "salary_type", "salary_interval": "salary_type",
    "area_m2": "total_area_m2", "auction_number": "auction_id", "leilao_id": "auction_id",
    "leilao_numero": "auction_id", "lot": "lot_number", "lot_id": "lot_number",
    "lot_code": "lot_number", "lote": "lot_number", "lote_id": "lot_number",
    "lote_numero": "lot_number",
}
# Lookup keys are folded tokens, so only folded spellings are listed.
ENUM_ALIASES = {
    "fuel_type": {"gas": "gasolina", "alcool": "etanol"},
    "transmission": {"automatico": "automatica"},
    "work_model": {"home office": "remoto"},
    "contract_type": {},
    "salary_type": {
        "annual": "anual", "annually": "anual", "yearly": "anual", "monthly": "mensal",
        "month": "mensal", "weekly": "semanal", "week": "semanal", "daily": "diario",
        "day": "diario", "hourly": "horario", "hour": "horario", "hora": "horario",
    },
    "modality": {
        "pregao eletronico": "pregao_eletronico", "pregao presencial": "pregao_presencial",
        "chamamento publico": "chamamento_publico",
    },
    "status": {
        "aberto": "aberta", "divulgada no pncp": "aberta",
        "recebendo proposta": "recebendo_propostas",
        "recebendo propostas": "recebendo_propostas", "em disputa": "em_disputa",
    },
    "listing_type": {
        "leilao": "auction", "catalogo": "catalog", "direct sale": "direct_sale",
        "venda direta": "direct_sale", "compre agora": "direct_sale",
        "proposta": "direct_sale",
    },
    "auction_status": {
        "aberta": "aberto", "aberto para lances": "aberto", "em andamento": "aberto",
        "andamento": "aberto", "agendado": "futuro", "proximo": "futuro",
        "encerrada": "encerrado", "finalizado": "encerrado", "finalizada": "encerrado",
        "arrematado": "encerrado", "vendido": "encerrado", "suspensa": "suspenso",
        "cancelada": "cancelado",
    },
}

# --- fixed values: words for booleans, prices, remote work ---------------------------
TRUE_WORDS = ["1", "true", "sim", "yes", "y", "ativo"]
FALSE_WORDS = ["0", "false", "nao", "no", "n", "inativo"]
PRICE_ON_REQUEST = ["sob consulta", "a combinar", "consulte", "grátis", ""]
REMOTE_WORDS = ["remote", "remoto", "home office", "anywhere", "worldwide"]
CHAT_REMOTE_WORDS = ["remoto", "remote", "home office", "anywhere", "worldwide", "latam", "brazil"]

# --- fixed values: salary period patterns, in the order they are tried ---------------
SALARY_PERIOD_PATTERNS = [
    ("anual", r"\bannual\b|\bannually\b|\byearly\b|\banual\b|/annual\b|/year\b|/yr\b|\bper year\b|\bpor ano\b|\bao ano\b"),
    ("mensal", r"\bmonthly\b|\bmensal\b|/month\b|/mo\b|\bper month\b|\bpor mes\b|\bao mes\b"),
    ("semanal", r"\bweekly\b|\bsemanal\b|/week\b|/wk\b|\bper week\b|\bpor semana\b"),
    ("diario", r"\bdaily\b|\bdiario\b|/day\b|\bper day\b|\bpor dia\b|\bao dia\b"),
    ("horario", r"\bhourly\b|\bhorario\b|/hour\b|/hr\b|\bper hour\b|\bpor hora\b|\ba hora\b"),
]
SALARY_AMOUNT_PATTERN = (
    r"(?<![A-Za-z0-9])(?:r\$\s*|us\$\s*|\$\s*|usd\s*|brl\s*|eur\s*|gbp\s*)?"
    r"(\d[\d.,]*)(?:\s*([kKmM]))?(?![A-Za-z0-9])"
)

# --- fixed values: date formats, in the order they are tried -------------------------
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd/MM/yy", "dd/MM/yyyy HH:mm:ss",
                "dd/MM/yyyy HH:mm", "dd/MM/yy HH:mm:ss", "dd/MM/yy HH:mm",
                "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"]
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss",
                    "dd/MM/yyyy HH:mm", "dd/MM/yy HH:mm:ss", "dd/MM/yy HH:mm",
                    "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm"]

# --- fixed values: map link patterns, in the order they are tried --------------------
MAP_COORD_PATTERNS = [
    r"(?i)@(-?\d{1,3}\.\d+),(-?\d{1,3}\.\d+)",
    r"(?i)!3d(-?\d{1,3}\.\d+)!4d(-?\d{1,3}\.\d+)",
    r"(?i)[?&](?:q|query|ll|center)=(?:loc:)?(-?\d{1,3}\.\d+),(-?\d{1,3}\.\d+)",
    r"(?i)/maps/search/(?:loc:)?(-?\d{1,3}\.\d+),(-?\d{1,3}\.\d+)",
]

# --- fixed values: tender scoring rules (phrase, weight, subtype, delivery) ----------
SIGNAL_RULES = [
    ("licenciamento de software", 55, "software_licensing", "licenca"),
    ("licenca de software", 55, "software_licensing", "licenca"),
    ("licenca de uso de software", 60, "software_licensing", "licenca"),
    ("saas", 60, "software_licensing", "licenca"),
    ("fabrica de software", 65, "software_development", "fabrica_software"),
    ("desenvolvimento de software", 65, "software_development", "desenvolvimento"),
    ("desenvolvimento de sistemas", 60, "software_development", "desenvolvimento"),
    ("aplicacao web", 55, "software_development", "desenvolvimento"),
    ("aplicativo", 55, "software_development", "desenvolvimento"),
    ("sustentacao de sistemas", 55, "systems_maintenance", "sustentacao"),
    ("manutencao evolutiva de sistemas", 60, "systems_maintenance", "sustentacao"),
    ("manutencao corretiva de sistemas", 50, "systems_maintenance", "sustentacao"),
    ("business intelligence", 55, "data_bi", "servico_continuado"),
    ("power bi", 55, "data_bi", "servico_continuado"),
    ("analytics", 40, "data_bi", "servico_continuado"),
    ("dashboard", 35, "data_bi", "servico_continuado"),
    ("banco de dados", 45, "data_bi", "servico_continuado"),
    (" api ", 35, "mixed_ti", "implantacao"),
    ("integracao de sistemas", 45, "mixed_ti", "implantacao"),
    ("sistema informatizado", 45, "mixed_ti", "implantacao"),
    ("sistema integrado de gestao", 55, "mixed_ti", "implantacao"),
    ("sistema de gestao", 45, "mixed_ti", "implantacao"),
    ("sistema de informacao", 45, "mixed_ti", "implantacao"),
    ("sistema web", 45, "mixed_ti", "implantacao"),
    ("portal web", 40, "mixed_ti", "implantacao"),
    ("plataforma digital", 45, "mixed_ti", "implantacao"),
    ("software", 30, "other_ti", "outro"),
    (" erp ", 55, "software_licensing", "implantacao"),
    (" crm ", 55, "software_licensing", "implantacao"),
    ("computacao em nuvem", 50, "cloud_infra", "servico_continuado"),
    ("infraestrutura em nuvem", 50, "cloud_infra", "servico_continuado"),
    (" cloud ", 35, "cloud_infra", "servico_continuado"),
    (" nuvem ", 30, "cloud_infra", "servico_continuado"),
]
ANTI_PHRASES = [
    "cartucho", "toner", "impressora", "impressoras", "notebook", "notebooks", "computador",
    "computadores", "microcomputador", "microcomputadores", "mouse", "teclado", "monitor",
    "monitores", "scanner", "roteador", "switch", "cabeamento", "link de internet",
    "internet dedicada", "camera", "cameras", "nobreak", "equipamento de informatica",
    "equipamentos de informatica", "suprimento de informatica", "suprimentos de informatica",
    "material de expediente", "combustivel", "genero alimenticio", "veiculo", "veiculos",
]
FOCUS_MIN_SCORE = 40
DEFAULT_TARGET_UFS = ["DF", "GO", "MG", "BA", "ES", "PR", "TO"]
CLOSED_TENDER_STATUS = ["suspensa", "encerrada", "homologada", "fracassada", "deserta",
                        "revogada", "anulada"]
BUYER_TYPE_RULES = [
    ("camara", [" camara municipal ", " camara de vereadores ", " camara legislativa "]),
    ("tribunal", [" tribunal ", " tj", " trt ", " tre ", " trf ", " ministerio publico "]),
    ("universidade", [" universidade ", " instituto federal ", " faculdade "]),
    ("prefeitura", [" prefeitura ", " municipio de "]),
    ("governo_estadual", [" governo do estado ", " estado de ", " secretaria de estado "]),
    ("governo_federal", [" ministerio ", " uniao ", " presidencia ", " comando do exercito "]),
    ("empresa_estatal", [" companhia ", " empresa brasileira ", " empresa municipal ",
                         " sociedade de economia mista "]),
    ("autarquia", [" autarquia ", " fundo municipal ", " fundacao "]),
]
LEGAL_BASIS_KEYS = ["descricao", "nome", "titulo", "fundamentacao", "amparoLegalDescricao"]

# --- fixed values: keyword lists that mark a listing as a tech listing ---------------
TECH_KEYWORDS = {
    "json_feed": ["developer", "engineer", "software", "python", "java", "javascript",
                  "typescript", "backend", "frontend", "fullstack", "full-stack", "react",
                  "angular", "golang", "ruby", "devops", "data", "cloud", "qa"],
    "rss_feed": ["developer", "engineer", "software", "python", "java", "javascript",
                 "typescript", "backend", "frontend", "full-stack", "full stack", "react",
                 "angular", "golang", "ruby", "devops"],
    "next_data_board": ["desenvolvedor", "developer", "engenheiro", "engineer", "software",
                        "fullstack", "full-stack", "backend", "back-end", "frontend",
                        "front-end", "mobile", "react", "angular", "java", "python", "node",
                        "php", "golang", "go ", "ruby", "qa", "quality assurance", "devops",
                        "sre", "cloud", "dados", "data", "machine learning", "ml", "ai",
                        "arquiteto", "architect", "scrum", "tech", "ti"],
    "careers_page": ["desenvolvedor", "developer", "fullstack", "full stack", "python",
                     "react", "java", "angular", "software", "arquiteto", "engineer",
                     "engenheiro", "dados", "data", "devops", "cloud", "scrum", "qa",
                     "frontend", "backend", "back-end", "front-end", "ti", "tech", "api",
                     "fastapi"],
    "title_only": ["programador", "desenvolvedor", "developer", "software", "backend",
                   "back-end", "frontend", "front-end", "full stack", ".net", "java", "php",
                   "python"],
    "chat": ["desenvolvedor", "developer", "engenheiro", "engineer", "software", "backend",
             "back-end", "frontend", "front-end", "fullstack", "full stack", "mobile", "ios",
             "android", "react", "react native", "angular", "vue", "node", "nodejs", "python",
             "java", "golang", "go ", "php", "laravel", "django", "flask", "ruby", "rails",
             "devops", "sre", "cloud", "dados", "data engineer", "data scientist",
             "machine learning", "consultor", "sap", "abap", "pmo", "qa", "tester",
             "product engineer", "tech lead", "arquiteto de software", "ti"],
}
FEED_CATEGORIES = ["back-end programming", "front-end programming", "full-stack programming",
                   "devops and sysadmin", "programming"]

# --- fixed values: word rules for seniority, contract and work model -----------------
SENIORITY_WORDS = {
    "feeds": [("senior", "senior|sr|staff|principal|lead"),
              ("pleno", "mid|intermediate|pleno"), ("junior", "junior|jr|entry")],
    "company_site": [("senior", "senior|staff|principal|lead|manager"),
                     ("pleno", "pleno|mid"), ("junior", "junior|jr")],
    "next_data_board": [("senior", "senior|sênior|sr|staff|principal|lead"),
                        ("pleno", "pleno|mid"),
                        ("junior", "junior|júnior|jr|new grad|est[aá]gio")],
    "startup_board": [("senior", "senior|sr|staff|principal|lead"),
                      ("pleno", "mid|intermediate|pleno"),
                      ("junior", "junior|jr|new grad|entry")],
    "abroad_board": [("senior", "senior|staff|principal|lead"), ("pleno", "mid|pleno"),
                     ("junior", "junior|jr")],
}
SENIORITY_SUBSTRINGS = [
    ("senior", ["sênior", "senior", "sr"]), ("pleno", ["pleno", "mid-level", "mid level"]),
    ("junior", ["júnior", "junior", "jr"]), ("estagio", ["estágio", "estagio"]),
    ("especialista", ["especialista", "specialist"]), ("lider", ["lead", "líder", "lider"]),
]
CONTRACT_RULES = {
    "chat": [("pj", ["pj", "pessoa jurídica", "contractor"]), ("clt", ["clt"]),
             ("freelancer", ["freelancer", "freela"]),
             ("temporario", ["temporário", "temporario"])],
    "hidden_json_board": [("pj", ["pj"]), ("pj", ["autonomo", "autônomo"]),
                          ("freelancer", ["freelancer", "freela"]),
                          ("temporario", ["tempor"]), ("clt", ["clt"])],
    "json_feed": [("pj", ["contract", "freelance"]), ("clt", ["full-time", "full time"])],
    "rss_feed": [("pj", ["contract", "freelance"]), ("clt", ["full-time", "full time"]),
                 ("temporario", ["part-time"])],
    "startup_board": [("pj", ["contract", "freelance"]), ("clt", ["full time", "full-time"]),
                      ("temporario", ["part time", "part-time"])],
    "abroad_board": [("pj", ["contract"]), ("clt", ["full-time", "full time"]),
                     ("clt", ["part-time", "part time"]), ("freelancer", ["freelance"])],
}
CONTRACT_REGEX_RULES = {
    "next_data_board": [("pj", r"\bpj\b|contractor|contract\b|freelance"),
                        ("clt", r"full[- ]time|efetivo|clt"),
                        ("temporario", r"temporary|tempor[aá]rio")],
    "company_site": [("clt", r"^(?:full_time|full-time|full time)$"),
                     ("pj", r"^(?:contract|contractor)$"), ("freelancer", r"freelance")],
}

# --- fixed values: words that decide whether a property is wanted --------------------
PROPERTY_INCLUDE = ["casa", "sobrado", "apartamento", "condom", "residencial", "terreno",
                    "imóvel", "imovel", "chácara", "chacara", "fazenda", "sítio", "sitio",
                    "rural"]
PROPERTY_TOKEN_SETS = {
    "auction_cards": (PROPERTY_INCLUDE, ["prédio comercial", "predio comercial", "sala",
                                         "consultório", "consultorio", "galpão", "galpao", "loja"]),
    "auction_lots": (PROPERTY_INCLUDE + ["lote"], ["veiculo", "carro", "moto", "caminh", "sala",
                                                   "consultorio", "consultório", "galp", "loja"]),
    "auction_offers": (PROPERTY_INCLUDE + ["lote", "prédio", "predio"],
                       ["veiculo", "veículo", "sala", "consult", "galp", "loja"]),
    "auction_catalog": (PROPERTY_INCLUDE, ["veiculo", "veículo", "galp", "loja", "sala",
                                           "consult", "comercial"]),
}
ASSET_WORDS = {
    "auction_cards": r"(?iU)\b(casa|apartamento|imovel|imóvel|terreno|chacara|chácara|fazenda|sitio|sítio|rural|sobrado|predio|prédio)\b",
    "auction_catalog": r"(?iU)\b(casa|apartamento|imovel|imóvel|terreno|rural|comercial|galp[aã]o|ve[ií]culo)\b",
    "auction_lots": r"(?iU)\b(casa|terreno|apartamento|galp[aã]o|im[oó]vel|loja|sala|rural)\b",
}
PRODUCT_TYPE_RULES = [
    ("capsula", ["caps", "cáps", "capsul"]), ("goma", ["goma"]),
    ("liquido", ["liquid", "líquid", "bebida", "shake"]),
    ("comprimido", ["tablete", "comprim"]),
    ("po", ["whey", "creatina", "bcaa", "glutamina", "protein", "powder", "pó", "po "]),
]
WHITE_LABEL_WORDS = ["white label", "marca própria", "marca propria"]
BLOCKED_STATUS_CODES = [403, 429]
BLOCKED_TITLE_WORDS = ["operação inválida", "operacao invalida", "access denied", "forbidden",
                       "request unsuccessful"]
BLOCKED_BODY_NOTICES = ["Attention Required! | Cloudflare", "Sorry, you have been blocked"]
MISSING_ITEM_WORDS = ["404", "410", "not found", "não encontrado", "nao encontrado",
                      "não existe", "nao existe", "gone", "removed"]

# --- fixed values: chat message rules ------------------------------------------------
CHAT_TITLE_PREFIXES = ["vaga", "cargo", "posição", "position", "opportunity", "oportunidade", "job"]
CHAT_COMPANY_PREFIXES = ["empresa", "cliente", "company", "contratante"]
CHAT_IGNORED_LINE_PREFIXES = ["salário", "salary", "contrato", "contract", "modelo", "benefícios",
                              "beneficios", "requisitos", "responsabilidades", "interessados",
                              "interested", "contato", "candidate-se", "candidate se"]
CHAT_GENERIC_HEADERS = ["oportunidade de carreira", "novas oportunidades", "vagas ativas",
                        "vagas abertas", "está pronto para", "voce esta pronto para", "junte-se",
                        "junte se", "international remote opportunities",
                        "olá, equipe do home office"]
CHAT_AGGREGATE_PHRASES = ["diversas vagas", "novas vagas remotas", "vagas remotas",
                          "participe de projetos remotos", "oportunidades remotas"]
CHAT_NON_COMPANY = ["remoto", "remote", "presencial", "hibrido", "híbrido", "clt", "pj",
                    "freelancer", "freela", "temporario", "temporário", "whatsapp", "whats",
                    "wpp", "mm", "fuso", "horario", "horário"]
CHAT_COMPANY_STOPWORDS = ["vaga", "vagas", "oferta", "oferece", "diversas", "home", "office",
                          "remoto", "remote", "senior", "sênior", "junior", "júnior", "pleno",
                          "area", "área", "tecnologia", "emprego", "empregos", "trabalho",
                          "urgente", "projetos", "projeto", "ti", "na", "no", "de", "do", "da",
                          "e", "em", "para", "com", "2024", "2025", "2026"]
CHAT_ROLE_WORDS = ["desenvolvedor", "desenvolvedora", "analista", "consultor", "consultora", "engenheiro",
                   "engenheira", "backend", "frontend", "fullstack", "full", "stack", "java", "python",
                   "react", "node", "mobile", "engineer", "cqa"]
CHAT_TITLE_URL_STOPWORDS = CHAT_COMPANY_STOPWORDS + ["grupo", "jobs", "job", "oportunidades", "oficial"]
CHAT_UPPER_TOKENS = ["SAP", "PMO", "QA", "UOL", "CLT", "PJ", "TI", "AI", "ABAP", "CQA"]
CHAT_GENERIC_TITLE_PREFIXES = ["olá", "ola", "bom dia", "boa tarde", "boa noite", "urgente",
                               "opportunity", "vem ser", "estamos com", "está com", "a consultoria"]
CHAT_BAD_LOCATIONS = ["junte", "cadastre", "manter", "vaga", "vagas", "oportunidade", "objetivo",
                      "projeto", "remoto", "remote"]
CHAT_LOCATION_NOISE = ["atividade", "atividades", "beneficio", "beneficios", "benefício",
                       "benefícios", "comunicar", "comunicacao", "comunicação", "conhecimento",
                       "conhecimentos", "experiencia", "experiência", "procedimento",
                       "procedimentos", "requisito", "requisitos", "responsabilidade",
                       "responsabilidades", "solicitada", "solicitadas", "solicitado",
                       "solicitados", "suporte", "usuario", "usuário", "usuarios", "usuários"]
CHAT_MAIL_HOSTS = ["gmail", "hotmail", "outlook", "yahoo"]
CHAT_PROMO_PHRASES = ["estamos a crescer", "vem para", "envie seu cv", "envie seu currículo",
                      "envie seu curriculo"]
CHAT_DEFAULT_TITLE = "Vaga de TI remota"
CHAT_ROLE_PATTERNS = [
    r"(?iU)\b(consultor(?:a)?\s+sap\s+[a-z]{1,5})\b",
    r"(?iU)\b(consultor(?:a)?\s+[a-z0-9+#./ -]{2,30})\b",
    r"(?iU)\b(analista\s+[a-z0-9+#./ -]{2,35})\b",
    r"(?iU)\b(desenvolvedor(?:a)?\s+[a-z0-9+#./ -]{2,35})\b",
    r"(?iU)\b(mobile engineer(?:\s*\([^)]+\))?)\b",
    r"(?iU)\b(back[- ]?end engineer(?:\s*\([^)]+\))?)\b",
    r"(?iU)\b(front[- ]?end engineer(?:\s*\([^)]+\))?)\b",
    r"(?iU)\b(full[- ]?stack engineer(?:\s*\([^)]+\))?)\b",
    r"(?iU)\b(project manager|product manager|tech lead|data engineer|data scientist)\b",
    r"(?iU)\b(pmo)\b",
]
# A brand is a word that starts with a letter and up to N more such words.
CHAT_COMPANY_LINE_PATTERNS = [
    r"(?iU)\bconsultoria\s+([A-Z][A-Za-z0-9.&/\-]+(?:\s+[A-Z][A-Za-z0-9.&/\-]+){0,2})\b",
    r"(?iU)\bvem\s+(?:ser|para)\s+([A-Z][A-Za-z0-9.&/\-]+(?:\s+[A-Z][A-Za-z0-9.&/\-]+){0,2})\b",
    r"(?iU)\bgrupo\s+([A-Z][A-Za-z0-9.&/\-]+(?:\s+[A-Z][A-Za-z0-9.&/\-]+){0,3})\b",
    r"(?iU)\b(?:aqui na|na|no|para a|para o)\s+([A-Z][A-Za-z0-9.&/\-]+(?:\s+[A-Z][A-Za-z0-9.&/\-]+){0,4})\b",
]
CHAT_COMPANY_FIRST_LINE_PATTERN = r"(?iU)\bna\s+([A-Z][A-Za-z0-9.&/\-]+(?:\s+[A-Z][A-Za-z0-9.&/\-]+){0,4})\b"
CHAT_COMPANY_TITLE_PATTERN = r"(?iU)\bna\s+([A-Z][A-Za-z0-9.&/\-]+(?:\s+[A-Z][A-Za-z0-9.&/\-]+){0,3})\b"
CHAT_COMPANY_VERB_PATTERN = (
    r"(?imU)^\s*(?:a|o)?\s*([A-Z][A-Za-z0-9&.\- ]{2,60})\s+"
    r"(?:busca|esta|está|procura|quer|abre|abriu|contrata)\b"
)
CHAT_LOCATION_PATTERNS = [
    r"(?iU)(?:presencial\s+em|em|local(?:ização)?[:\s]|cidade[:\s]|atuação[:\s])\s*([A-Za-zÀ-ÿ'`\-\s]{2,70})\s*/\s*([A-Za-z]{2})\b",
    r"(?iU)(?:presencial\s+em|em|local(?:ização)?[:\s]|cidade[:\s]|atuação[:\s])\s*([A-Za-zÀ-ÿ'`\-\s]{2,70})\s+-\s+([A-Za-z]{2})\b",
    r"(?iU)\b([A-Za-zÀ-ÿ'`\-\s]{2,70})\s*/\s*([A-Za-z]{2})\b",
    r"(?iU)\b([A-Za-zÀ-ÿ'`\-\s]{2,70})\s+-\s+([A-Za-z]{2})\b",
]
EMOJI_CLASS = (r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}"
               r"\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}"
               r"\x{2600}-\x{26FF}\x{2700}-\x{27BF}]+")
BULLET_CLASS = r"[•▪\x{FE0F}▫►▶]+"

# --- fixed values: noise lines of job pages ------------------------------------------
NOISE_LINE_PATTERNS = [
    r"Quero me Candidatar$", r"Desbloqueie o Contato Direto da Empresa\.?$",
    r"Não fique invisível no processo seletivo\.?$", r"Desbloquear contato$",
    r"Contato sem intermediação$", r"Aumente suas chances$", r"Vagas VIP exclusivas$",
    r"Quero Prioridade$", r"Seja Premium$", r"E-mail:\s*.+$", r"Whats:\s*.+$",
    r"Publicada .+$", r"\d+\s+Vaga(?:s)?$", r"Nível:\s*.+$", r"Contratação\s+.+$",
    r"Sal[aá]rio\s+.+$", r"Não informado\.?$",
]
JOB_INFO_LABELS = ["Data da abertura", "Tipo de emprego", "Indústria", "Cidade",
                   "Estado/Província", "Estado", "País", "Pais", "CEP/Código postal", "CEP",
                   "Trabalho remoto"]
VEHICLE_LABELS = ["Categoria", "Modelo", "Marca", "Tipo de veículo", "Ano", "Quilometragem",
                  "Potência do motor", "Combustível", "Câmbio", "Direção", "Cor", "Portas",
                  "Final de placa", "Possui Kit GNV", "Tipo de direção"]

# --- fixed values: source catalog ----------------------------------------------------
DEFAULT_SCHEDULE = "0 */6 * * *"
STRATEGY_ALIASES = {
    "http_basic": "http_basic", "basic": "http_basic", "http": "http_antibot",
    "http_antibot": "http_antibot", "antibot": "http_antibot",
    "browser_playwright": "browser_playwright", "playwright": "browser_playwright",
}
RUN_PERIOD_HOURS = {"24h": 24, "7d": 168, "30d": 720, "90d": 2160}
PATCHABLE_FIELDS = ["source_id", "url", "title", "description", "price", "currency", "location",
                    "state", "city", "zip_code", "street", "contact_name", "contact_phone",
                    "contact_email", "images", "videos", "documents", "links", "attributes"]
TIME_ZONE = "America/Sao_Paulo"


# fixed value: the site name that ends a job title
SITE_TITLE_SUFFIX = r"(?U)\s+-\s+VanHack$"
