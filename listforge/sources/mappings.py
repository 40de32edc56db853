"""Listing mappings: page, feed and message families -> payload rows.

A mapping is a plain function DataFrame -> DataFrame.  The registry can be listed, filtered by
category and source type, and turned into a small catalog frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listforge import fixed_values as fv
from listforge.functions import attributes as at, classify as cl, dates as dt, geo, messages as ms, money as mo, text as tx, urls
from listforge.operators import rules as ru
from listforge.operators.normalize import attribute_map, normalize_listings, payload
from listforge.sources import pages as pg


@dataclass(frozen=True)
class Mapping:
    name: str
    category: str
    source_type: str
    build: Callable[..., DataFrame]


MAPPINGS: dict[str, Mapping] = {}


def mapping(name: str, category: str, source_type: str = "web"):
    def wrap(fn):
        MAPPINGS[name] = Mapping(name, category, source_type, fn)
        return fn

    return wrap


def by_category(category: str) -> list[Mapping]:
    return [m for m in MAPPINGS.values() if m.category == category]


def by_source_type(source_type: str) -> list[Mapping]:
    return [m for m in MAPPINGS.values() if m.source_type == source_type]


def listing_mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m.name, m.category, m.source_type) for m in MAPPINGS.values()], "name string, category string, source_type string")


def extract(name: str, raw: DataFrame, **options) -> DataFrame:
    """Payload rows of a mapping, normalized."""
    m = MAPPINGS[name]
    return normalize_listings(m.build(raw, **options), m.category)


def _v(column: str):
    """Getter for paths of a variant column."""
    return lambda path, kind="string": F.try_variant_get(column, path, kind)


def _text(pages: DataFrame, *extra: Column) -> DataFrame:
    return pages.select("url", "html", pg.page_text(F.col("html")).alias("text"), *extra)


def _where_built(df: DataFrame, condition: Column) -> DataFrame:
    """A filter on columns that are costly to build and used again: it stays above the projection, by a number that no
    optimizer moves it below.  Pushed down, it would build them for the filter and once more for the rows that pass."""
    return df.withColumn("__n", F.monotonically_increasing_id()).where(condition & (F.col("__n") >= 0)).drop("__n")


def _join(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


# --- jobs ------------------------------------------------------------------------------------
@mapping("json_feed_jobs", "jobs", "feed")
def json_feed_jobs(feed: DataFrame) -> DataFrame:
    staged = feed.select("*", tx.html_to_text(F.col("description")).alias("body"))
    staged = staged.withColumn("all_text", _join(tx.clean_text(F.col("position")), tx.clean_text(F.col("company")), F.col("body"), F.array_join("tags", " ")))
    staged = staged.where(tx.clean_text(F.col("position")).isNotNull() & tx.clean_text(F.col("url")).isNotNull() & cl.tech_listing(F.col("all_text"), "json_feed"))
    low, high = F.coalesce("salary_min", F.lit(0.0)), F.coalesce("salary_max", F.lit(0.0))
    salary = F.when((low > 0) | (high > 0), F.format_string("$%,d - $%,d", low.cast("long"), high.cast("long")))
    return payload(
        staged, url=tx.clean_text(F.col("url")), title=F.col("position"), description=F.col("body"), currency=F.lit("USD"),
        price=F.when(F.col("salary_min") > 0, F.col("salary_min")), city=F.coalesce(tx.clean_text(F.col("location")), F.lit("Remote")),
        links=F.filter(F.array(tx.clean_text(F.col("apply_url"))), lambda x: x.isNotNull()),
        attributes=attribute_map(company=tx.clean_text(F.col("company")), salary_text=salary, seniority=cl.seniority_word(F.col("all_text")),
                                 contract_type=cl.contract_type_infer(F.coalesce("body", F.lit("")), "json_feed"), work_model=F.lit("remoto"),
                                 experience_years=mo.experience_years(F.col("body"))))


@mapping("rss_feed_jobs", "jobs", "feed")
def rss_feed_jobs(feed: DataFrame) -> DataFrame:
    staged = feed.where(cl.allowed_category(F.col("category"), F.col("title"))).select(
        "*", tx.title_split(F.col("title")).alias("parts"), tx.html_to_text(F.col("description")).alias("body"))
    staged = staged.where(cl.tech_listing(_join(F.col("parts.title"), tx.clean_text(F.col("category")), F.col("body")), "rss_feed"))
    salary = mo.salary_text_dollar(F.col("body"))
    return payload(
        staged, url=F.col("link"), title=F.col("parts.title"), description=F.col("body"), price=mo.parse_price_brl(salary), currency=F.lit("USD"),
        city=F.when(tx.clean_text(F.col("region")).isNotNull(), "Remote"),
        attributes=attribute_map(company=F.col("parts.company"), salary_text=salary, seniority=cl.seniority_word(_join(F.col("parts.title"), F.col("body"))),
                                 contract_type=cl.contract_type_infer(F.coalesce("body", F.lit("")), "rss_feed"), work_model=F.lit("remoto"),
                                 experience_years=mo.experience_years(F.col("body"))))


@mapping("jsonld_jobs", "jobs")
def jsonld_jobs(pages: DataFrame) -> DataFrame:
    df = _text(pages, pg.jsonld(F.col("html"), "JobPosting").alias("j")).where("j is not null")
    g = _v("j")
    address = F.coalesce(g("$.jobLocation.address", "variant"), g("$.jobLocation[0].address", "variant"))
    low = F.coalesce(g("$.baseSalary.value.minValue"), g("$.baseSalary.value.value"))
    salary = mo.structured_salary_text(g("$.baseSalary.currency"), low, g("$.baseSalary.value.maxValue"))
    df = df.select("*", address.alias("a"), salary.alias("salary"), _join(g("$.title"), g("$.description"), F.col("text")).alias("all_text"))
    return payload(
        df, url=F.col("url"), title=g("$.title"), description=tx.html_to_text(g("$.description")), price=mo.parse_price_brl(F.col("salary")), currency=F.lit("BRL"),
        city=_v("a")("$.addressLocality"), state=_v("a")("$.addressRegion"), zip_code=_v("a")("$.postalCode"), street=_v("a")("$.streetAddress"),
        attributes=attribute_map(company=g("$.hiringOrganization.name"), salary_text=F.col("salary"), seniority=cl.seniority_word(F.col("all_text"), "next_data_board"),
                                 contract_type=cl.contract_type_infer(F.col("all_text"), "hidden_json_board"),
                                 work_model=F.when(F.lower("all_text").rlike(r"(?U)\b(?:home office|remot[oa])\b"), "remoto"),
                                 experience_years=mo.experience_years(F.col("all_text"))))


@mapping("next_data_jobs", "jobs")
def next_data_jobs(pages: DataFrame) -> DataFrame:
    df = pages.select("url", pg.next_data(F.col("html"), "$.props.pageProps.jobData").alias("j")).where("j is not null")
    g = _v("j")
    tags = F.array_join(F.transform(g("$.jobTags", "array<variant>"), lambda x: F.try_variant_get(x, "$.tag.name", "string")), " ")
    more = tx.html_to_text(g("$.moreInfos"))
    body = tx.join_parts(tx.html_to_text(g("$.description")), F.concat(F.lit("Outras Informações\n"), more))
    low, high = g("$.jobSalary.value.minimum", "double"), g("$.jobSalary.value.maximum", "double")
    df = df.select("*", body.alias("body"), tags.alias("tags"))
    all_text = _join(g("$.title"), g("$.subtitle"), F.col("body"), g("$.company.name"), F.col("tags"))
    return payload(
        df.where(cl.tech_listing(all_text, "next_data_board")), url=F.col("url"), title=g("$.title"), description=F.coalesce("body", g("$.subtitle")),
        price=F.coalesce(low, high), currency=F.lit("BRL"), city=g("$.city"), state=g("$.state"), location_raw=_join(g("$.country.name"), g("$.subtitle")),
        links=F.filter(F.array(g("$.externalLink")), lambda x: x.isNotNull()),
        attributes=attribute_map(company=F.coalesce(g("$.company.name"), g("$.companyDisplayName")), salary_text=F.coalesce(low, high),
                                 seniority=cl.seniority_word(all_text, "next_data_board"), contract_type=cl.contract_type_infer(all_text, "next_data_board"),
                                 work_model=F.lit("remoto"), experience_years=mo.experience_years(F.col("body"))))


@mapping("hidden_json_jobs", "jobs")
def hidden_json_jobs(pages: DataFrame, field: str = "jobs") -> DataFrame:
    schema = "struct<url:string,title:string,company:string,attributions:string,description:string,city:string,state:string,salary:string,linkType:string>"
    df = pages.select(F.explode(pg.hidden_json(F.col("html"), field, schema)).alias("j")).select("j.*")
    body = tx.join_parts(tx.clean_text(F.col("attributions")), tx.clean_text(F.col("description")))
    all_text = _join(F.col("title"), body, F.col("linkType"))
    return payload(
        df, url=F.col("url"), title=F.col("title"), description=body, price=mo.parse_price_brl(F.col("salary")), currency=F.lit("BRL"), city=F.col("city"), state=F.col("state"),
        attributes=attribute_map(company=F.col("company"), salary_text=F.col("salary"), seniority=cl.seniority_word(all_text, "next_data_board"),
                                 contract_type=cl.contract_type_infer(all_text, "hidden_json_board")))


@mapping("json_key_jobs", "jobs")
def json_key_jobs(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    df = _text(pages, tx.clean_text(F.regexp_replace(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")).alias("h1"))
    kind = pg.json_key(h, "employmentType")
    return payload(
        df.where("h1 is not null"), url=F.col("url"), title=F.col("h1"), description=F.col("text"), currency=F.lit("BRL"), city=pg.json_key(h, "addressLocality"),
        state=pg.json_key(h, "addressRegion"), zip_code=pg.json_key(h, "postalCode"), street=pg.json_key(h, "streetAddress"),
        links=F.filter(F.array(pg.json_key(h, "applicationUrl")), lambda x: x.isNotNull()),
        attributes=attribute_map(company=pg.json_key(h, "name"), seniority=cl.seniority_word(F.col("h1"), "company_site"), contract_type=cl.contract_type_infer(kind, "company_site"),
                                 work_model=F.when(F.lower("text").contains("remote"), "remoto"), experience_years=mo.experience_years(F.col("text"))))


# A run of letters and blanks is tried from its start only and never given back: the comma is not in it, so a later
# start or a shorter run finds nothing more, but would cost the square of the run.
PLACE = r"(?<![A-Za-zÀ-ÿ ])([A-Za-zÀ-ÿ ]++,\s*[A-Z]{2})\b"


@mapping("meta_jobs", "jobs")
def meta_jobs(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    df = _text(pages, tx.title_suffix_strip(pg.page_meta(h, "og:title")).alias("t")).where("t is not null")
    salary = tx.extract(F.col("text"), r"(\$[\d,]+(?:\s+up to\s+\$[\d,]+)?\s+[A-Z]{3}/[A-Za-z]+)")
    return payload(
        df, url=F.coalesce(pg.page_meta(h, "og:url"), F.col("url")), title=F.col("t"), description=pg.page_meta(h, "og:description"), price=mo.salary_floor(salary),
        currency=F.coalesce(tx.extract(salary, r"\b([A-Z]{3})/"), F.lit("USD")), location_raw=tx.extract(F.col("text"), PLACE),
        attributes=attribute_map(salary_text=salary, seniority=cl.seniority_word(F.col("text"), "abroad_board"),
                                 contract_type=cl.contract_type_infer(F.col("text"), "abroad_board"), work_model=F.lit("remoto")))


@mapping("heading_jobs", "jobs")
def heading_jobs(pages: DataFrame) -> DataFrame:
    df = _text(pages, pg.page_lines(F.col("html")).alias("lines"))
    body = F.array_join(pg.section_after(F.col("lines"), "(?i)^about the job", "(?i)^about the company"), "\n\n")
    salary = tx.extract(F.col("text"), r"(\$\d+[kK]?\s*[–-]\s*\$\d+[kK]?)")
    place = tx.extract(F.col("text"), r"(?i)(Remote\s*\([^)]+\)|Remote|Onsite\s*\([^)]+\)|Hybrid\s*\([^)]+\))")
    remote = F.when(F.lower(place).contains("remote"), "remoto")
    df = df.select("*", body.alias("body"), tx.clean_text(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")).alias("h1"))
    return payload(
        _where_built(df, F.col("h1").isNotNull() & (F.col("body") != "")), url=F.col("url"), title=F.col("h1"), description=F.col("body"), price=mo.salary_floor(salary), currency=F.lit("USD"),
        city=F.when(remote.isNotNull(), "Remote"),
        attributes=attribute_map(salary_text=salary, seniority=cl.seniority_word(_join(F.col("h1"), F.col("body")), "startup_board"),
                                 contract_type=cl.contract_type_infer(F.col("text"), "startup_board"), work_model=remote, experience_years=mo.experience_years(F.col("body"))))


@mapping("label_jobs", "jobs")
def label_jobs(pages: DataFrame) -> DataFrame:
    df = _text(pages, pg.label_prefix_values(pg.page_lines(F.col("html")), fv.JOB_INFO_LABELS).alias("m"), pg.page_title(F.col("html")).alias("t"))
    m = lambda *names: F.coalesce(*[F.try_element_at("m", F.lit(n)) for n in names])
    remote = F.lower(m("Trabalho remoto")).isin("sim", "yes", "true") | F.lower("text").contains("trabalho remoto")
    return payload(
        _where_built(df, cl.tech_listing(_join(F.col("t"), F.col("text")), "careers_page") & (F.size("m") > 0)), url=F.col("url"), title=F.col("t"), description=F.col("text"), currency=F.lit("BRL"),
        city=m("Cidade"), state=m("Estado/Província", "Estado"), zip_code=mo.digits(m("CEP/Código postal", "CEP")),
        attributes=attribute_map(country=m("País", "Pais"), seniority=cl.seniority_word(F.col("t")), contract_type=cl.contract_type_infer(m("Tipo de emprego")), work_model=F.when(remote, "remoto")))


# --- tenders ---------------------------------------------------------------------------------
TENDER_SCHEMA = (
    "struct<numeroControlePNCP:string,numeroCompra:string,processo:string,objetoCompra:string,informacaoComplementar:string,valorTotalEstimado:string,"
    "dataAberturaProposta:string,dataEncerramentoProposta:string,dataPublicacaoPncp:string,dataInclusao:string,modalidadeNome:string,situacaoCompraNome:string,modoDisputaNome:string,"
    "criterioJulgamentoNome:string,tipoInstrumentoConvocatorioNome:string,srp:string,orcamentoSigiloso:string,orcamentoSigilosoDescricao:string,linkProcessoEletronico:string,linkSistemaOrigem:string,"
    "orgaoEntidade:struct<cnpj:string,razaoSocial:string>,unidadeOrgao:map<string,string>,amparoLegal:map<string,string>,fontesOrcamentarias:array<string>>")


@mapping("api_tenders", "tenders", "api")
def api_tenders(entries: DataFrame, now: Column, municipalities: tuple[str, ...] = ()) -> DataFrame:
    c = lambda name: tx.clean_text(tx.unescape_basic(F.col(name)))
    df = entries.select(
        "*", dt.to_utc(F.col("dataEncerramentoProposta")).alias("end_at"), dt.to_utc(F.col("dataAberturaProposta")).alias("open_at"),
        dt.to_utc(F.coalesce(tx.empty_to_null(F.col("dataPublicacaoPncp")), F.col("dataInclusao"))).alias("published_at"),
        urls.control_number_url(c("numeroControlePNCP")).alias("public_url"), c("objetoCompra").alias("object"), c("informacaoComplementar").alias("info"))
    df = df.where(c("numeroControlePNCP").isNotNull() & cl.active_tender(c("situacaoCompraNome"), F.col("end_at"), now))
    df = ru.score_rules(df, F.concat_ws(" ", "object", "info"))
    df = df.select("*", urls.proposal_link(urls.with_scheme(F.col("linkProcessoEletronico")), urls.with_scheme(F.col("linkSistemaOrigem")), F.col("public_url")).alias("link"),
                   dt.closing_window_days(F.col("end_at"), now).alias("window_days"), F.try_element_at("unidadeOrgao", F.lit("ufSigla")).alias("uf"))
    raw_value = F.col("valorTotalEstimado")
    value = F.when(raw_value.contains(","), mo.parse_price_brl(raw_value)).otherwise(raw_value.try_cast("double"))
    value = F.when(value > 0, value)
    agency = tx.clean_text(F.col("orgaoEntidade.razaoSocial"))
    prefix = tx.empty_to_null(F.concat_ws(" ", c("modalidadeNome"), F.coalesce(c("numeroCompra"), c("processo"))))
    title = F.coalesce(F.concat(prefix, F.lit(" - "), F.col("object")), F.col("object"), prefix)
    published = F.date_format("published_at", "yyyy-MM-dd")
    description = tx.sentence_join(
        ("Órgão", agency), ("Processo", c("processo")), ("Situação", c("situacaoCompraNome")), ("Publicação", published), ("Abertura", dt.iso_utc(F.col("open_at"))),
        ("Encerramento das propostas", dt.iso_utc(F.col("end_at"))), ("Modo de disputa", c("modoDisputaNome")), ("Critério de julgamento", c("criterioJulgamentoNome")),
        ("Amparo legal", at.legal_basis(F.col("amparoLegal"))), ("Objeto", F.col("object")), ("Informações complementares", F.col("info")))
    links = F.filter(F.array(urls.with_scheme(F.col("linkProcessoEletronico")), urls.with_scheme(F.col("linkSistemaOrigem"))),
                     lambda x: x.isNotNull() & (x != F.col("public_url")))
    return payload(
        df, url=F.col("public_url"), title=title, description=description, price=value, currency=F.lit("BRL"), state=F.col("uf"),
        city=F.try_element_at("unidadeOrgao", F.lit("municipioNome")), links=links,
        attributes=attribute_map(
            agency_name=agency, agency_tax_id=tx.empty_to_null(mo.digits(F.col("orgaoEntidade.cnpj"))), portal_name=F.lit("PNCP"), source_record_id=c("numeroControlePNCP"),
            process_number=c("processo"), notice_number=c("numeroCompra"), complementary_info=F.col("info"), mode_dispute=c("modoDisputaNome"),
            instrument_type=c("tipoInstrumentoConvocatorioNome"), amparo_legal=at.legal_basis(F.col("amparoLegal")), modality=c("modalidadeNome"), status=c("situacaoCompraNome"),
            publication_date=published, opening_at=dt.iso_utc(F.col("open_at")), proposal_end_at=dt.iso_utc(F.col("end_at")), closing_window_days=F.col("window_days"),
            estimated_value=F.format_string("%.2f", value), estimated_value_band=mo.value_band(value), proposal_url=F.col("link.url"), proposal_link_type=F.col("link.kind"),
            actionable_now=cl.actionable_now(F.col("link.kind"), F.col("window_days")), buyer_type=cl.buyer_type(agency),
            region_priority=cl.region_priority(F.col("uf"), at.municipality_code(F.col("unidadeOrgao")), municipalities=municipalities), srp=F.col("srp"),
            budget_confidential=at.confidential_budget(F.col("orcamentoSigiloso"), F.col("orcamentoSigilosoDescricao")), budget_source_count=at.budget_sources(F.col("fontesOrcamentarias")),
            software_focus=F.col("focus"), software_fit_score=F.col("score"), software_subtype=F.col("subtype"), delivery_model_hint=F.col("delivery"),
            technology_keywords=tx.empty_to_null(F.array_join("keywords", ";")), judgment_criterion=c("criterioJulgamentoNome"), document_count=F.lit(0),
            dedupe_key=F.concat(F.lit("pncp:"), c("numeroControlePNCP"))))


# --- vehicles --------------------------------------------------------------------------------
@mapping("jsonld_vehicles", "vehicles")
def jsonld_vehicles(pages: DataFrame, wanted: str = "Vehicle") -> DataFrame:
    df = pages.select("url", "html", pg.jsonld(F.col("html"), wanted).alias("j")).where("j is not null")
    g = _v("j")
    number = F.coalesce(g("$.offers.price", "double"), mo.parse_price_brl(g("$.offers.price")))
    return payload(
        df, url=F.col("url"), title=g("$.name"), description=g("$.description"), price=number, currency=F.coalesce(g("$.offers.priceCurrency"), F.lit("BRL")),
        images=F.coalesce(g("$.image", "array<string>"), F.filter(F.array(g("$.image")), lambda x: x.isNotNull())),
        attributes=attribute_map(brand=F.coalesce(g("$.brand.name"), g("$.brand")), model=g("$.model"), year=F.coalesce(g("$.vehicleModelDate"), g("$.modelDate")),
                                 mileage=F.coalesce(g("$.mileageFromOdometer.value"), g("$.mileageFromOdometer")), color=g("$.color"), fuel_type=g("$.fuelType"), transmission=g("$.vehicleTransmission")))


@mapping("next_data_vehicles", "vehicles")
def next_data_vehicles(pages: DataFrame) -> DataFrame:
    df = pages.select("url", pg.next_data(F.col("html"), "$.props.pageProps.deal").alias("j")).where("j is not null")
    g = _v("j")
    return payload(
        df, url=F.col("url"), title=_join(g("$.make"), g("$.model"), g("$.year"), g("$.trim")), description=g("$.comments"), price=g("$.price", "double"), currency=F.lit("BRL"),
        city=g("$.city"), state=g("$.state"), attributes=attribute_map(brand=g("$.make"), model=g("$.model"), version=g("$.trim"), year=g("$.year"), mileage=g("$.km"), color=g("$.color")))


@mapping("line_vehicles", "vehicles")
def line_vehicles(pages: DataFrame) -> DataFrame:
    df = pages.select("url", "html", pg.page_lines(F.col("html")).alias("lines"))
    df = df.select("*", pg.label_values(F.col("lines"), fv.VEHICLE_LABELS).alias("m"), tx.title_suffix_strip(pg.page_title(F.col("html"))).alias("t"),
                   F.array_join("lines", "\n").alias("text")).where("size(m) > 0")
    m = lambda n: F.try_element_at("m", F.lit(n))
    fields = cl.vehicle_fields(F.col("t"), m("Marca"), m("Modelo"))
    features = F.array_union(pg.block_between(F.col("text"), "Itens de veículo", "Sobre o vendedor"), pg.block_between(F.col("text"), "Opcionais", "Histórico Veicular"))
    return payload(
        df, url=F.col("url"), title=F.col("t"), description=tx.sentence_join(("Ano", m("Ano")), ("KM", m("Quilometragem")), ("Câmbio", m("Câmbio")), ("Combustível", m("Combustível"))),
        price=mo.choose_price(mo.page_amounts(F.col("text"))), currency=F.lit("BRL"), images=pg.page_images(F.col("html")), location_raw=m("Cidade"),
        attributes=attribute_map(brand=m("Marca"), model=fields["model"], version=fields["version"], year=m("Ano"), mileage=m("Quilometragem"), fuel_type=m("Combustível"),
                                 transmission=m("Câmbio"), color=m("Cor"), doors=m("Portas"), engine=m("Potência do motor"), body_type=m("Tipo de veículo"),
                                 features=tx.empty_to_null(F.array_join(features, ";"))))


# --- properties ------------------------------------------------------------------------------
@mapping("next_data_properties", "properties")
def next_data_properties(pages: DataFrame) -> DataFrame:
    df = pages.select("url", pg.next_data(F.col("html"), "$.props.pageProps.initialState.house.houseInfo").alias("j")).where("j is not null")
    g = _v("j")
    title = tx.generated_title(F.coalesce(g("$.type"), F.lit("Casa")), g("$.bedrooms", "int"), g("$.address.neighborhood"), g("$.address.city"))
    return payload(
        df, url=F.col("url"), title=title, description=tx.join_parts(g("$.generatedDescription.longDescription"), g("$.remarks")), price=g("$.salePrice", "double"), currency=F.lit("BRL"),
        city=g("$.address.city"), state=g("$.address.stateAcronym"), street=tx.street_text(g("$.address.street"), F.lit(None).cast("string"), g("$.address.neighborhood")),
        latitude=g("$.address.lat", "double"), longitude=g("$.address.lng", "double"),
        attributes=attribute_map(listing_type=F.lit("sale"), property_type=F.lit("casa"), bedrooms=g("$.bedrooms"), bathrooms=g("$.bathrooms"), parking_spots=g("$.parkingSpots"), total_area_m2=g("$.area")))


@mapping("query_properties", "properties")
def query_properties(pages: DataFrame, literal: str) -> DataFrame:
    df = pages.select("url", pg.next_data_query(F.col("html"), literal).alias("j")).where("j is not null")
    g = _v("j")
    kind = F.when(F.lower("url").contains("condominio"), "Casa de condomínio").otherwise("Casa")
    return payload(
        df, url=F.col("url"), title=tx.generated_title(kind, g("$.bedrooms", "int"), g("$.address.neighborhood"), g("$.address.city")), description=g("$.description"),
        price=g("$.price", "double"), currency=F.lit("BRL"), city=g("$.address.city"), state=g("$.address.state"),
        street=tx.street_text(g("$.address.streetName"), F.lit(None).cast("string"), g("$.address.neighborhood")),
        attributes=attribute_map(listing_type=F.lit("sale"), property_type=F.lit("casa"), bedrooms=g("$.bedrooms"), bathrooms=g("$.restrooms"), parking_spots=g("$.parkingSpots"), total_area_m2=g("$.area")))


@mapping("json_key_properties", "properties")
def json_key_properties(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    df = _text(pages, pg.page_title(h).alias("t")).where(pg.json_number(h, "mainValue").isNotNull())
    return payload(
        df, url=F.col("url"), title=F.col("t"), description=F.col("text"), price=pg.json_number(h, "mainValue"), currency=F.lit("BRL"), city=pg.json_key(h, "city"), state=pg.json_key(h, "stateAcronym"),
        zip_code=pg.json_key(h, "zipCode"), street=tx.street_text(pg.json_key(h, "street"), pg.json_key(h, "streetNumber"), pg.json_key(h, "neighborhood")),
        latitude=pg.json_number(h, "lat"), longitude=pg.json_number(h, "lon"), images=pg.page_images(h),
        attributes=attribute_map(listing_type=F.lit("sale"), property_type=cl.property_type(_join(F.col("url"), F.col("t"))), bedrooms=pg.json_key(h, "bedrooms"),
                                 bathrooms=pg.json_key(h, "bathrooms"), parking_spots=pg.json_key(h, "parkingSpaces"), total_area_m2=pg.json_key(h, "usableAreas")))


@mapping("text_properties", "properties")
def text_properties(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    df = pages.select("url", "html", pg.page_lines(h).alias("lines"))
    df = df.select("*", F.array_join("lines", " ").alias("text"), tx.title_suffix_strip(F.coalesce(pg.page_meta(h, "og:title"), pg.page_title(h))).alias("t"))
    df = df.select("*", mo.property_metrics(F.col("text")).alias("m"), geo.city_state(F.col("t")).alias("place"))
    return payload(
        df.where("m.bedrooms is not null or m.total_area_m2 is not null"), url=F.col("url"), title=F.col("t"), description=pg.page_meta(h, "description"), price=pg.context_price(F.col("lines")),
        currency=F.lit("BRL"), city=F.col("place.city"), state=F.col("place.state"), images=pg.page_images(h),
        attributes=attribute_map(listing_type=F.lit("sale"), property_type=cl.property_type_portal(F.col("t")), bedrooms=F.col("m.bedrooms"), bathrooms=F.col("m.bathrooms"),
                                 parking_spots=F.col("m.parking_spots"), total_area_m2=F.col("m.total_area_m2"), building_area_m2=F.col("m.covered_area_m2")))


# --- auctions --------------------------------------------------------------------------------
@mapping("next_data_auctions", "auctions")
def next_data_auctions(pages: DataFrame) -> DataFrame:
    df = pages.select("url", pg.next_data(F.col("html"), "$.props.pageProps.offerDetails.offers[0]").alias("j")).where("j is not null")
    g = _v("j")
    title = F.coalesce(g("$.title"), tx.slug_title(F.regexp_replace("url", r"-\d+/*$", "")))
    df = df.where(cl.target_property(_join(title, g("$.assetType")), "auction_offers"))
    reference, bid = g("$.appraisalValue", "double"), g("$.price", "double")
    return payload(
        df, url=F.col("url"), title=title, description=g("$.description"), price=bid, currency=F.lit("BRL"), city=g("$.city"), state=g("$.state"),
        attributes=attribute_map(listing_type=F.lit("auction"), auction_id=g("$.auctionId"), lot_number=g("$.lotNumber"), auction_status=cl.auction_status(g("$.status")),
                                 appraisal_value=reference, current_bid=bid, discount_pct=mo.discount_pct(reference, bid), asset_type=cl.asset_type(title), auctioneer=g("$.auctioneer")))


@mapping("text_auctions", "auctions")
def text_auctions(pages: DataFrame, variant: str = "auction_cards") -> DataFrame:
    df = _text(pages, tx.title_suffix_strip(pg.page_title(F.col("html"))).alias("t"))
    df = df.select("*", dt.auction_rounds(F.col("text")).alias("rounds"), dt.auction_datetimes(F.col("text")).alias("times"), cl.auction_ids(F.col("text"), F.col("url")).alias("ids"),
                   mo.page_amounts(F.col("text")).alias("amounts"), geo.city_state(F.col("t")).alias("place")).where(cl.target_property(F.col("t"), variant) & (F.size("times") > 0))
    first, second = (mo.parse_price_brl(F.col(f"rounds.{r}.value")) for r in ("first", "second"))
    price = F.coalesce(second, first, F.try_element_at("amounts", F.lit(1)))
    return payload(
        df, url=F.col("url"), title=F.col("t"), description=F.col("text"), price=price, currency=F.lit("BRL"), city=F.col("place.city"), state=F.col("place.state"),
        attributes=attribute_map(listing_type=F.lit("auction"), auction_id=F.col("ids.auction"), lot_number=F.col("ids.lot"), auction_code=F.col("ids.code"),
                                 auction_date=F.try_element_at("times", F.lit(1)), auction_start_at=F.try_element_at("times", F.lit(1)), auction_end_at=F.try_element_at("times", F.lit(-1)),
                                 auction_status=F.when(F.lower("text").contains("encerrado"), "encerrado").otherwise("aberto"), asset_type=cl.asset_type(F.col("t"), variant),
                                 appraisal_value=F.format_string("%.2f", first), minimum_bid=F.format_string("%.2f", price), discount_pct=mo.discount_pct(first, second)))


@mapping("lot_auctions", "auctions")
def lot_auctions(pages: DataFrame) -> DataFrame:
    df = _text(pages).where(cl.candidate_url(F.col("url"), "catalog_lot"))
    lot = tx.extract(F.col("url"), r"/lot/(\d+)")
    return payload(
        df, url=urls.norm_link(F.col("url")), title=F.coalesce(tx.empty_to_null(pg.page_title(F.col("html"))), F.concat(F.lit("Lote "), lot)), description=F.col("text"),
        price=F.try_element_at(mo.page_amounts(F.col("text")), F.lit(1)), currency=F.lit("BRL"), location_raw=tx.extract(F.col("text"), r"(?U)([A-Za-zÀ-ÿ\s]+\s*-\s*[A-Z]{2})\b"),
        attributes=attribute_map(listing_type=F.lit("direct_sale"), lot_number=lot, auction_code=lot, asset_type=F.lit("veiculo")))


# --- farms and supplements -------------------------------------------------------------------
@mapping("json_key_farms", "agribusiness")
def json_key_farms(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    df = _text(pages, pg.page_title(h).alias("t")).where(pg.json_number(h, "price").isNotNull())
    area = F.coalesce(mo.area_hectares(pg.json_number(h, "area"), pg.json_key(h, "areaType")), pg.json_number(h, "totalArea"), mo.area_hectares_text(F.col("text")))
    candidates = F.concat(pg.json_texts(h, "description", 20), F.coalesce(pg.json_texts(pg.unescape_payload(h), "description", 20), F.array().cast("array<string>")))
    return payload(
        df, url=F.col("url"), title=F.col("t"), description=F.coalesce(pg.longest_text(candidates), F.col("text")), price=pg.json_number(h, "price"), currency=F.lit("BRL"),
        location_raw=F.col("t"), latitude=F.coalesce(pg.json_number(h, "latitude"), geo.dms_to_decimal(pg.json_key(h, "latitude"))),
        longitude=F.coalesce(pg.json_number(h, "longitude"), geo.dms_to_decimal(pg.json_key(h, "longitude"))), images=pg.page_images(h),
        contact_phone=tx.empty_to_null(mo.digits(F.coalesce(pg.json_key(h, "telNumber"), geo.find_phone(F.col("text"))))), contact_email=F.coalesce(pg.json_key(h, "email"), geo.find_email(F.col("text"))),
        attributes=attribute_map(listing_type=cl.listing_type(pg.json_key(h, "businessType"), F.col("text")), area_hectares=F.format_string("%.4f", area),
                                 riverbank=cl.riverbank(F.col("text")), irrigation=cl.irrigation(F.col("text"))))


@mapping("text_farms", "agribusiness")
def text_farms(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    df = _text(pages, F.coalesce(tx.clean_text(F.regexp_replace(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")), pg.page_meta(h, "og:title")).alias("t"))
    area = F.coalesce(mo.area_hectares_text(F.col("t")), mo.area_hectares_text(F.col("text")))
    price = F.coalesce(mo.labelled_amount(F.col("text"), r"VALOR\s+DO\s+INVESTIMENTO"), mo.choose_price_last(mo.page_amounts(F.col("text"))))
    found = F.regexp_extract_all(h, F.lit(pg.IMAGE_URL), F.lit(1))
    return payload(
        df.where(area.isNotNull()), url=F.col("url"), title=F.col("t"), description=pg.page_meta(h, "description"), price=price, currency=F.lit("BRL"), location_raw=F.col("t"),
        images=pg.best_images(found, r"url=([^\s&]+)"), attributes=attribute_map(listing_type=F.lit("sale"), area_hectares=F.format_string("%.4f", area), irrigation=cl.irrigation(F.col("text"))))


@mapping("text_supplements", "supplements")
def text_supplements(pages: DataFrame) -> DataFrame:
    h = F.col("html")
    df = pages.select("url", "html", pg.page_lines(h).alias("lines"), pg.page_title(h).alias("t"))
    sizes = pg.section_after(F.col("lines"), "(?i)^embalagens$", "(?i)^sabores$|^descrição$")
    flavours = pg.section_after(F.col("lines"), "(?i)^sabores$", "(?i)^embalagens$|^descrição$")
    df = df.select("*", sizes.alias("sizes"), flavours.alias("flavours")).where("size(sizes) > 0")
    body = tx.join_parts(pg.page_meta(h, "description"), F.when(F.size("flavours") > 0, F.concat(F.lit("Sabores: "), F.array_join("flavours", ", "))))
    return payload(
        df, url=F.col("url"), title=F.col("t"), description=body, currency=F.lit("BRL"), images=pg.page_images(h),
        attributes=attribute_map(product_type=cl.product_type(_join(F.col("t"), body)), package_size=F.array_join("sizes", ", "), white_label=cl.white_label(h)))


# --- chat messages ---------------------------------------------------------------------------
@mapping("chat_jobs", "jobs", "chat")
def chat_jobs(messages: DataFrame) -> DataFrame:
    """``messages``: chat_id, chat_title, username, message_id, text, ocr_text, posted_at, has_image.

    The steps are separate selects, so that each derived text is computed once."""
    df = messages.withColumn("all_text", ms.compose_text(F.col("text"), F.col("ocr_text")))
    df = df.where(ms.message_candidate(F.col("all_text")) & ~ms.message_aggregate(F.col("all_text")))
    df = df.select("*", ms.description_text(F.col("text"), F.col("ocr_text"), F.col("all_text")).alias("body"), urls.extract_urls(F.col("all_text")).alias("found_links"),
                   urls.public_message_url(F.col("username"), F.col("message_id")).alias("public_url"))
    df = df.select("*", ms.header_fields(F.col("body")).alias("header"))
    df = df.withColumn("raw_title", F.coalesce("header.title", ms.message_title(F.col("body"), F.col("found_links"))))
    df = df.withColumn("company", F.coalesce("header.company", ms.message_company(F.col("all_text"), F.col("found_links"), F.col("raw_title"))))
    df = df.withColumn("title", ms.refine_title(F.col("raw_title"), F.col("body"), F.col("found_links"), F.col("company")))
    df = df.select("*", ms.message_location(F.col("body")).alias("place"),
                   F.array_union("found_links", F.filter(F.array("public_url"), lambda x: x.isNotNull())).alias("links"), ms.classify_message(F.col("all_text")).alias("k"))
    has_text = F.coalesce(F.col("text"), F.lit("")) != ""
    kind = F.when(F.col("has_image") & has_text, "mixed").when(F.col("has_image"), "image").when(has_text, "text")
    url = urls.canonical_message_url(F.col("chat_id"), F.col("message_id"))
    return payload(
        df, url=url, title=F.col("title"), description=F.col("body"), currency=F.lit("BRL"), city=F.coalesce("header.place.city", "place.city"),
        state=F.coalesce("header.place.state", "place.state"), contact_email=geo.find_email(F.col("all_text")), contact_phone=geo.find_phone(F.col("all_text")), links=F.col("links"),
        attributes=attribute_map(company=F.col("company"), salary_range=mo.salary_text_find(F.col("all_text")), seniority=F.col("k.seniority"), contract_type=F.col("k.contract_type"),
                                 work_model=F.col("k.work_model"), experience_years=mo.experience_years(F.col("all_text")), telegram_chat=F.coalesce("chat_title", "username"),
                                 telegram_chat_id=F.col("chat_id"), telegram_message_id=F.col("message_id"), telegram_posted_at=dt.iso_utc(F.col("posted_at")), source_message_type=kind,
                                 ocr_used=F.coalesce(F.col("ocr_text"), F.lit("")) != "", telegram_public_url=F.col("public_url"), telegram_canonical_url=url,
                                 dedupe_key=ms.message_dedupe_key(F.col("title"), F.col("company"), F.col("all_text"), F.col("links"))))
