"""Rule-based classification of listings, runs and tenders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listforge import fixed_values as fv
from listforge.functions import text as tx, urls


def seniority_word(c: Column, variant: str = "feeds") -> Column:
    return tx.first_pattern(F.lower(c), [(label, rf"(?U)\b(?:{words})\b") for label, words in fv.SENIORITY_WORDS[variant]])


def seniority_substr(c: Column) -> Column:
    return tx.first_rule(F.lower(c), fv.SENIORITY_SUBSTRINGS)


def contract_type_infer(c: Column, variant: str = "chat") -> Column:
    if variant in fv.CONTRACT_REGEX_RULES:
        return tx.first_pattern(F.lower(c), [(label, "(?U)" + p) for label, p in fv.CONTRACT_REGEX_RULES[variant]])
    return tx.first_rule(F.lower(c), fv.CONTRACT_RULES[variant])


def work_model_infer(c: Column) -> Column:
    return tx.first_rule(F.lower(c), [("hibrido", ["híbrido", "hibrido", "hybrid"]),
                                      ("remoto", fv.CHAT_REMOTE_WORDS),
                                      ("presencial", ["presencial", "on-site", "onsite"])])


def remote_listing(*fields: Column) -> Column:
    """Any of the fields holds a word for remote work."""
    joined = F.lower(F.concat_ws("\n", *fields))
    return tx.contains_any(joined, fv.REMOTE_WORDS)


def tech_listing(c: Column, variant: str = "json_feed") -> Column:
    return tx.contains_any(F.lower(F.coalesce(c, F.lit(""))), fv.TECH_KEYWORDS[variant])


def allowed_category(category: Column, title: Column) -> Column:
    token = F.lower(tx.clean_text(category))
    return (token.isNull() | token.isin(fv.FEED_CATEGORIES)) & F.coalesce(title, F.lit("")).contains(":")


def target_property(c: Column, variant: str = "auction_cards") -> Column:
    include, exclude = fv.PROPERTY_TOKEN_SETS[variant]
    text = F.lower(F.coalesce(c, F.lit("")))
    return tx.contains_any(text, include) & ~tx.contains_any(text, exclude)


def enum_value(key: str, c: Column, allowed: list[str]) -> Column:
    """Canonical enum value of a text, or null: folded, aliased, folded again, looked up."""
    aliases = fv.ENUM_ALIASES.get(key, {})
    targets = {_token(value): value for value in allowed}
    lookup = dict(targets)
    for alias, target in aliases.items():
        if _token(target) in targets:
            lookup[alias] = targets[_token(target)]
    return F.try_element_at(tx.lookup_table(lookup), tx.norm_token(tx.clean_text(c)))


def _token(value: str) -> str:
    return value.lower().replace("_", " ")


def run_status(http: Column, success: Column, scraped: Column, published: Column) -> Column:
    """ERROR, PARTIAL or SUCCESS of a finished run."""
    return (F.when(http != 200, "ERROR").when(~success, "ERROR").when(scraped <= 0, "PARTIAL")
            .when(published <= 0, "ERROR").when(published < scraped, "PARTIAL").otherwise("SUCCESS"))


def run_message(status: Column, error: Column, http: Column, scraped: Column, published: Column) -> Column:
    counts = F.concat(F.lit(" ("), published.cast("string"), F.lit("/"), scraped.cast("string"), F.lit(" itens)"))
    return (F.when(tx.empty_to_null(error).isNotNull(), error)
            .when(status == "SUCCESS", F.concat(F.lit("Extraído e publicado"), counts))
            .when(status == "PARTIAL", F.concat(F.lit("Extração/publicação parcial"), counts))
            .when(http.isNotNull(), F.concat(F.lit("HTTP "), http.cast("string")))
            .otherwise(F.concat(F.lit("Falha na publicação"), counts)))


def strategy_alias(c: Column) -> Column:
    token = F.lower(tx.strip_spaces(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.try_element_at(tx.lookup_table(fv.STRATEGY_ALIASES), token), F.lit("http_basic"))


def item_missing(item_id: Column, url: Column, chat_missing: Column, status: Column, blocked: Column,
                 fetch_error: Column, raised: Column) -> Column:
    """Whether a re-fetched item is gone and its stored listing may be deleted."""
    def says_missing(text: Column) -> Column:
        return tx.contains_any(F.lower(tx.strip_spaces(F.coalesce(text, F.lit("")))), fv.MISSING_ITEM_WORDS)

    page_gone = (F.coalesce(status.isin(404, 410), F.lit(False))
                 | (~F.coalesce(blocked, F.lit(False)) & says_missing(fetch_error)) | says_missing(raised))
    chat = urls.norm_queue_url(url).startswith("telegram://")
    return F.when(F.coalesce(item_id, F.lit(0)) <= 0, False).when(
        chat, F.coalesce(chat_missing, F.lit(False))).otherwise(page_gone)


def buyer_type(c: Column) -> Column:
    return tx.let(tx.match_text(c), lambda text: F.when(text != "", tx.first_rule(text, fv.BUYER_TYPE_RULES, "outro")))


def region_priority(state: Column, municipality: Column, ufs: list[str] = fv.DEFAULT_TARGET_UFS,
                    municipalities: tuple[str, ...] = ()) -> Column:
    uf = F.upper(tx.strip_spaces(F.coalesce(state, F.lit(""))))
    high = F.coalesce(municipality.isin(*municipalities), F.lit(False)) if municipalities else F.lit(False)
    return F.when(high, "high").when(uf.isin(ufs), "medium").when(uf != "", "low").otherwise("unknown")


def actionable_now(link_kind: Column, window_days: Column) -> Column:
    return F.coalesce(link_kind.isin("processo_eletronico", "sistema_origem") & (window_days >= 0), F.lit(False))


def active_tender(status: Column, end: Column, now: Column) -> Column:
    closed = tx.norm_token(F.coalesce(status, F.lit(""))).isin(fv.CLOSED_TENDER_STATUS)
    return ~closed & F.coalesce(end >= now, F.lit(True))


def property_type(c: Column) -> Column:
    return tx.first_rule(F.lower(c), [
        ("casa", ["condom"]), ("chacara", ["chácara", "chacara"]), ("fazenda", ["fazenda"]),
        ("sitio", ["sítio", "sitio"]), ("terreno", ["terreno", "lote"])], "casa")


def property_type_portal(c: Column) -> Column:
    return tx.first_rule(F.lower(c), [
        ("apartamento", ["apartamento"]), ("kitnet", ["kitnet", "studio"]), ("terreno", ["terreno"]),
        ("chacara", ["chácara", "chacara"]), ("fazenda", ["fazenda"])], "casa")


def asset_type(c: Column, variant: str = "auction_cards") -> Column:
    return F.lower(tx.extract(c, fv.ASSET_WORDS[variant]))


def listing_type(code: Column, page_text: Column) -> Column:
    known = F.upper(tx.strip_spaces(code))
    text = F.concat(F.lit(" "), F.lower(F.coalesce(page_text, F.lit(""))), F.lit(" "))
    return (F.when(known.isin("SALE", "SELL"), "sale").when(known.isin("RENT", "RENTAL", "LEASE"), "rent")
            .when(known == "AUCTION", "auction").when(text.contains(" venda "), "sale")
            .when(text.contains(" arrendamento ") | text.contains(" aluguel "), "rent")
            .when(text.contains(" leilão ") | text.contains(" leilao "), "auction").otherwise("catalog"))


def auction_status(c: Column) -> Column:
    return _auction_status(tx.empty_to_null(F.lower(tx.strip_spaces(c))))


@tx.bound
def _auction_status(token: Column) -> Column:
    return F.coalesce(tx.first_rule(token, [("aberto", ["abert", "andamento"]),
                                            ("encerrado", ["encerr", "finaliz"]), ("suspenso", ["suspens"])]), token)


def product_type(c: Column) -> Column:
    return tx.first_rule(F.lower(c), fv.PRODUCT_TYPE_RULES, "outro")


def flag_true_or_null(c: Column, words: list[str]) -> Column:
    return F.when(tx.contains_any(F.lower(c), words), True)


def white_label(c: Column) -> Column:
    return flag_true_or_null(c, fv.WHITE_LABEL_WORDS)


def irrigation(c: Column) -> Column:
    return flag_true_or_null(c, ["irrigação", "irrigacao"])


def riverbank(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).contains("cabeceira")


def contract_tag(c: Column) -> Column:
    """Display tag of a contract type."""
    return _contract_tag(tx.empty_to_null(F.lower(tx.strip_spaces(c))))


@tx.bound
def _contract_tag(token: Column) -> Column:
    return (F.when((token == "pj") | token.contains("pessoa jurid"), "PJ").when(token == "clt", "CLT")
            .otherwise(F.upper(token)))


def blocked_page(status: Column, title: Column, body: Column) -> Column:
    return (F.coalesce(status.isin(fv.BLOCKED_STATUS_CODES), F.lit(False))
            | tx.contains_any(F.lower(F.coalesce(title, F.lit(""))), fv.BLOCKED_TITLE_WORDS)
            | tx.contains_any(F.coalesce(body, F.lit("")), fv.BLOCKED_BODY_NOTICES))


def candidate_url(url: Column, variant: str) -> Column:
    """URL shapes that lead to a detail page."""
    if variant == "lot_page":
        return url.contains("/leilao/") & url.contains("/lote/")
    if variant == "property_lot":
        slashes = F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))
        return ~url.contains("/veiculos/") & (url.rlike(r"(?i)-[jx]\d{5,}$") | (url.contains("/imoveis/") & (slashes >= 6)))
    if variant == "offer_page":
        return url.contains("/oferta/")
    if variant == "numbered_page":
        return url.rlike(r"/\d{4,}-\d{4,}$")
    if variant == "catalog_lot":
        return url.rlike(r"/lot/\d+")
    # "detail_page": http(s), no chat or mail schemes, at least two path segments
    segments = F.size(F.filter(F.split(F.regexp_replace(url, r"^https?://[^/?#]+|[?#].*$", ""), "/"), lambda s: s != ""))
    return url.rlike("^https?://") & (segments >= 2)


def vehicle_fields(title: Column, brand: Column, model: Column) -> Column:
    """Model without the brand in front; version = title after the model, else its third word on."""
    words = F.split(tx.collapse(title), " ")
    bare = tx.empty_to_null(F.trim(model))
    cut = F.when(F.lower(bare).startswith(F.concat(F.lower(F.trim(brand)), F.lit(" "))),
                 F.trim(F.substring(bare, F.length(F.trim(brand)) + 1, F.length(bare)))).otherwise(bare)
    at = F.instr(title, F.coalesce(bare, F.lit("\u0001")))
    after = tx.empty_to_null(F.trim(F.substring(title, at + F.length(bare), F.length(title))))
    third = tx.empty_to_null(F.array_join(F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))), " "))
    return F.struct(tx.empty_to_null(cut).alias("model"), F.when(at > 0, after).otherwise(third).alias("version"))


def vehicle_fields_by_position(title: Column) -> Column:
    """Brand = first word, model = second (and third when both are upper case), version = fourth on."""
    words = F.split(tx.collapse(title), " ")
    n = F.size(words)
    w = [F.try_element_at(words, F.lit(i)) for i in (1, 2, 3)]
    both_upper = (n >= 3) & (F.upper(w[1]) == w[1]) & (F.upper(w[2]) == w[2])
    return F.struct(
        tx.title_case(w[0]).alias("brand"),
        F.when(n < 2, None).when(both_upper, F.concat_ws(" ", tx.title_case(w[1]), tx.title_case(w[2])))
        .otherwise(tx.title_case(w[1])).alias("model"),
        F.when(n > 3, tx.title_case(F.array_join(F.slice(words, F.lit(4), F.greatest(n - 3, F.lit(0))), " "))).alias("version"))


def auction_ids(text: Column, url: Column) -> Column:
    """struct<auction, code, lot> from 'Leilão 10 - 20 30', else from the URL."""
    pattern = r"(?iU)Leil[aã]o\s+(\d+)\s*-\s*(\d+)\s+(\d+)"
    path = r"/leilao/(\d+)/lote/(\d+)"
    return F.struct(
        F.coalesce(tx.extract(text, pattern, 1), tx.extract(url, path, 1)).alias("auction"),
        tx.extract(text, pattern, 2).alias("code"),
        F.coalesce(tx.extract(text, pattern, 3), tx.extract(url, path, 2),
                   tx.extract(url, r"/lot/(\d+)", 1)).alias("lot"))
