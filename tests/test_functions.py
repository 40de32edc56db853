"""Literal cases for the column library."""

import random
import re
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from listforge.functions import attributes as at, classify as cl, dates as dt, geo, messages as ms, money as mo, text as tx
from listforge.operators import catalog as ca
from listforge.sources import pages as pg


@pytest.mark.parametrize("text, value", [
    ("R$ 1.234,56", 1234.56), ("Sob consulta", None), ("R$ 10 - R$ 20", None), ("grátis", None), ("", None), ("2.500", 2500.0)])
def test_price(one, text, value):
    assert one(mo.parse_price_brl, text) == value


@pytest.mark.parametrize("text, value", [
    ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1.234", 1234.0), ("45,", 45.0), ("1.234.56", None), ("1,2.345,67", None), ("12.5", 12.5), ("1.234,567", 1234567.0)])
def test_amount(one, text, value):
    assert one(mo.parse_amount, text) == value


@pytest.mark.parametrize("text, value", [
    ("R$ 5.000 a R$ 7.000", 5000.0), ("USD 10k", 10000.0), ("3.000abc", 3.0), ("sem valor", None), ("0 a 100", 100.0)])
def test_salary_floor(one, text, value):
    assert one(mo.salary_floor, text) == value


@pytest.mark.parametrize("text, value", [("95,5", 95.5), ("R$ 500.000,00", 500000.0), ("1500", 1500.0), ("2.5", 2.5), ("500.000", 500000.0), ("-3,5", -3.5), ("x", None)])
def test_float(one, text, value):
    assert one(mo.parse_float_br, text) == value


@pytest.mark.parametrize("text, value", [
    ("9412.188333", 9412.188333), ("5.000", 5000.0), ("45000.0", 45000.0), ("0", None), ("a combinar", None)])
def test_stored_salary(one, text, value):
    assert one(at.salary_number, text) == value


@pytest.mark.parametrize("text, value", [
    ("2024-03-05T10:00:00Z", "2024-03-05"), ("05/03/2024", "2024-03-05"), ("5/3/24 10:00", "2024-03-05"), ("05/03/95", "1995-03-05"), ("31/02/2024", None), ("amanhã", None)])
def test_date(one, text, value):
    assert one(dt.parse_date_multi, text) == value


@pytest.mark.parametrize("text, value", [
    ("2024-03-05T10:00:00.123-03:00", "2024-03-05T10:00:00-03:00"), ("05/03/2024 7:30", "2024-03-05T07:30:00"), ("2024-03-05", "2024-03-05T00:00:00"), ("05/03/2024", None)])
def test_datetime(one, text, value):
    assert one(dt.parse_datetime_multi, text) == value


@pytest.mark.parametrize("text, city, state", [
    ("em são josé dos campos - SP", "São José Dos Campos", "SP"), ("Minas Gerais", None, "MG"), ("em algum lugar", None, None), ("x - ZZ, Natal/RN", "Natal", "RN")])
def test_city_state(one, text, city, state):
    assert one(geo.city_state, text) == {"city": city, "state": state}


def test_title_case_follows_letters(one):
    assert one(tx.title_case, "são-josé d'oeste") == "São-José D'Oeste"


def test_description(one):
    assert one(tx.clean_description, "<p>Olá&nbsp;&lt;b&gt;mundo&lt;/b&gt; — ok?</p><br>fim &eacute;") == "Olá mundo - ok fim é"
    assert one(tx.clean_description_ingest, "a — b?<li>c") == "a — b? c"


def test_string_list(one):
    assert one(at.string_list, "Ar; ar ,SOM|  ;som") == ["Ar", "SOM"]
    assert one(at.string_list, " ; ") is None


def test_enum(one):
    allowed = ["gasolina", "etanol", "flex"]
    assert one(lambda c: cl.enum_value("fuel_type", c, allowed), "Álcool") == "etanol"
    assert one(lambda c: cl.enum_value("fuel_type", c, allowed), "lenha") is None


def test_seniority_and_contract(one):
    assert one(cl.seniority_word, "Staff engineer") == "senior"
    assert one(cl.seniority_word, "stafford") is None
    assert one(cl.seniority_substr, "vaga para Jr") == "junior"
    assert one(cl.contract_type_infer, "Pessoa Jurídica") == "pj"


def test_chat_rules(one):
    text = "💻 *VAGA:* Consultor SAP ABAP - Acme - São Paulo / SP\nSalário: R$ 12.000"
    header = one(ms.header_fields, text)
    assert header["title"] == "Consultor SAP ABAP" and header["company"] == "Acme" and header["place"]["city"] == "São Paulo"
    assert one(ms.message_location, "Presencial em Belo Horizonte - MG") == {"city": "Belo Horizonte", "state": "MG"}
    assert one(ms.message_location, "suporte ao usuário / SP") is None
    assert one(ms.caption_sanitize, "Envie seu CV: a@b.com\nlinha\nlinha") == "Contato: a@b.com\nlinha"


def test_ocr_card(one):
    card = one(ms.ocr_card_text, "Dev Java\nCidade: Natal Nível: Pleno\nRequisitos:\n• Java\n- Spring;\nOBS: remoto")
    assert card == "Dev Java\nCidade: Natal\nNível: Pleno\n\nRequisitos:\n- Java\n- Spring\n\nObservações:\nremoto"
    assert one(ms.ocr_card_text, "Dev\nCidade: Natal") is None


def test_label_lines(one):
    html = "<p>Marca</p><p>Fiat</p><p>Ano</p><p>Cor</p><p>Azul</p>"
    assert one(lambda c: pg.label_values(pg.page_lines(c), ["Marca", "Ano", "Cor"]), html) == {"Marca": "Fiat", "Cor": "Azul"}


def test_page_meta_and_links(one):
    html = """<meta content='a &amp; b' property="og:title"><a href="/x?y=1">1</a><a class=k href="http://o.example/z#q">2</a><a href="/x">3</a>"""
    assert one(lambda c: pg.page_meta(c, "og:title"), html) == "a & b"
    assert one(lambda c: pg.page_links(c, F.lit("https://h.example/p/q")), html) == ["https://h.example/x", "http://o.example/z"]


@pytest.mark.parametrize("cron, expected", [
    ("0 */6 * * *", "2024-01-31 21:00"), ("0 9 * * 0", "2024-02-05 12:00"), ("0 0 29 2 *", "2024-02-29 03:00"), ("30 2 1 1 mon", "2029-01-01 05:30"),
    ("43 15 * * *", "2024-01-31 18:43"), ("61 * * * *", None), ("* * * *", None), ("a b c d e", None), ("15-45/15 16 * * *", "2024-01-31 19:15")])
def test_next_fire(spark, cron, expected):
    """The reference time is 15:43 local time, 18:43 UTC; weekday 0 is Monday."""
    df = spark.createDataFrame([(cron,)], "c string")
    now = F.lit(datetime(2024, 1, 31, 18, 43))
    assert df.select(F.date_format(ca.next_fire(F.col("c"), now), "yyyy-MM-dd HH:mm")).first()[0] == expected


@pytest.mark.parametrize("link, company", [
    ("https://vagasdeempregoce.com/v/grupo-alfa-beta-oferta-vaga-de-dev/", "Alfa Beta"), ("https://vagasdeempregoce.com/v/vaga-desenvolvedor-java-casa-forte-2025", "Casa Forte"),
    ("https://jobs.quickin.io/acme-labs/jobs/1", "Acme Labs"), ("https://work.vetto.ai/x", "Vetto"), ("https://other.example/acme", None)])
def test_company_from_link(one, link, company):
    assert one(lambda c: ms.message_company(F.lit("dev java"), F.array(c), F.lit("Dev")), link) == company


def test_last_spelling_that_parses_counts(spark):
    maps = ["map('salary_range', 'R$ 5.000', 'salary_text', 'a combinar')", "map('salary_range', 'R$ 5.000 por mês', 'salary_text', 'R$ 7.000')", "map('salary_text', 'x')"]
    df = spark.range(1).select(F.explode(F.array(*[F.expr(m) for m in maps])).alias("a")).select(at.typed_attributes(F.col("a"), "jobs").alias("t"))
    assert [r.t.salary_range for r in df.collect()] == [5000.0, 7000.0, None]


@pytest.mark.parametrize("text, value", [
    ("manuten&ccedil;&atilde;o", "manutenção"), ("&#231;&#xE7;&#x1F600;", "çç😀"), ("&amp;lt; & &x; &lt", "&lt; & &x; &lt"), ("a & b", "a & b"), ("&#0;&#55296;", "&#0;&#55296;")])
def test_entities(one, text, value):
    assert one(tx.unescape_basic, text) == value


def test_entities_in_full(one):
    import html

    for text in ["&lt", "&#150;", "&notit; &hearts;", "&#xD800;", "&Aacute;&aacute &middot;"]:
        assert one(tx.unescape_html, text) == html.unescape(text)


@pytest.mark.parametrize("text, value", [("Dev - VanHack", "Dev"), ("Dev - LifeHack", "Dev - LifeHack"), ("Dev - vanhack", "Dev - vanhack")])
def test_site_suffix(one, text, value):
    assert one(tx.title_suffix_strip, text) == value


def test_long_payload_texts(one):
    body = 'a\\"b\\\\c\\u00e7\\n' * 60_000
    got = one(lambda h: pg.json_texts(h, "description", 20)[0], '{"description":"' + body + '"}')
    assert got == 'a"b\\cç\n' * 60_000
    inner = '{\\"description\\":\\"' + "word " * 10 + 'x\\\\\\"y\\"}'
    assert one(lambda h: pg.json_texts(pg.unescape_payload(h), "description", 20)[0], inner) == "word " * 10 + 'x"y'


def test_rounds_run_to_the_next_label(one):
    text = "1ª Praça: 01/02/2024 às 10:00 " + "lote " * 500 + "R$ 1.234,56 2ª Praça: 08/02/2024 às 10:00 R$ 600,00"
    got = one(dt.auction_rounds, text)
    assert (got["first"]["value"], got["second"]["day"], got["second"]["value"]) == ("1.234,56", "08/02/2024", "600,00")


# --- dates, map links, long rows ---------------------------------------------------------------
ISO_TEXTS = [
    "2024-01-02", "20240102", "2024-01-02T10", "2024-01-02T10:00+03", "2024-W01-2", "2024W012", "2024-W01", "2024W53", "2020-W53-7", "2024-01-02T10:11:12.123456789Z",
    "2024-01-02 101112-0330", "2024-01-02T10:11:12,5", "2024-01-02T25:00", "2024-13-01", "2024-02-30", "2024-01-02Z", "2024-01-02T10:1112", "2024-01-02T10:11:60",
    "2024-01-02T10:11:12+25:00", "2024-01-02T10:11:12+03:00:30", "12345678", "2024-01-02T", "2024-01-02T10:11:12.", "2024-W01-8", "2024-01-02+03", "0001-01-01"]


def test_iso_forms_equal_the_standard_library(spark):
    def expected(text):
        try:
            want = datetime.fromisoformat(text.replace("Z", "+00:00")).replace(microsecond=0)
        except ValueError:
            return (text, None, None, None)
        return (text, want.date().isoformat(), want.isoformat(), (want if want.tzinfo else want.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat())

    c = F.col("c")
    got = spark.createDataFrame([(t,) for t in ISO_TEXTS], "c string").select("c", dt.parse_date_multi(c), dt.parse_datetime_multi(c), dt.iso_utc(dt.to_utc(c)))
    assert [tuple(r) for r in got.collect()] == [expected(t) for t in ISO_TEXTS]


def test_map_link_inside_a_script(one):
    assert one(geo.maps_coords, r"https://maps/embed?x=1&q=-10.5,-20.5") == {"latitude": -10.5, "longitude": -20.5}
    assert one(geo.maps_coords, "https://maps/embed?x=1&amp;q=-10.5,-20.5") == {"latitude": -10.5, "longitude": -20.5}


def test_a_leap_day_on_a_monday(one):
    """A 29 February on a Monday is up to 40 years away; a 30 February never comes."""
    at = lambda y: lambda c: F.date_format(ca.next_fire(c, F.lit(datetime(y, 3, 1))), "yyyy-MM-dd HH:mm")
    assert one(at(2024), "0 0 29 2 mon") == "2044-02-29 03:00"
    assert one(at(2044), "0 0 29 2 mon") == "2072-02-29 03:00"
    assert one(at(2024), "0 0 30 2 *") is None


def test_all_images_of_a_page_are_found(one):
    page = "".join(f'<img src="https://img.example/{i}.jpg">' for i in range(1, 41))
    assert one(pg.page_images, page) == [f"https://img.example/{i}.jpg" for i in range(1, 41)]


def test_kept_images_equal_a_loop(one):
    rng = random.Random(2)
    urls = [f"https://i/?url={rng.choice('abc')}" + rng.choice(["", "&width=100", "&width=200", "&width=900", "&v=1&width=900"]) for _ in range(60)]
    urls += ["https://j/plain.png", urls[0]]
    found = {}
    for i, u in enumerate(urls):
        asset, width = re.search(r"url=([^\s&]+)", u), re.search(r"width=(\d+)", u)
        asset, width = asset[1] if asset else u, int(width[1]) if width else 0
        if width == 0 or width >= 200:
            first, best = found.get(asset, (i, (-1, -1, "")))
            found[asset] = (first, max(best, (width, i, u)))
    want = list(dict.fromkeys(best[2] for _, best in sorted(found.values())))
    assert one(lambda c: pg.best_images(F.split(c, " "), r"url=([^\s&]+)"), " ".join(urls)) == want


def test_repeated_lines_go(one):
    lines = ["Água boa", "x", "", "agua  BOA", "!!!", "x ", "y", "???", "Z z"]
    assert one(lambda c: tx.distinct_by_token(F.split(c, "\n")), "\n".join(lines)) == ["Água boa", "x", "y", "Z z"]


@pytest.mark.parametrize("kernel", [tx.drop_noise_lines, lambda c: F.array_join(pg.best_images(F.split(c, "\n"), r"line (\d+)"), " ")])
def test_long_rows_take_time_in_proportion(spark, kernel):
    def seconds(n):
        df = spark.createDataFrame([("\n".join(f"line {i}" for i in range(n)),)], "c string")
        start = time.time()
        assert df.select(F.length(kernel(F.col("c"))).alias("n")).first()[0] > n
        return time.time() - start

    seconds(2000)
    small = min(seconds(40_000) for _ in range(2))
    assert min(seconds(80_000) for _ in range(2)) <= 2.5 * small + 0.5


def test_place_of_a_page_is_found_as_before_in_linear_time(one):
    from listforge.sources.mappings import PLACE

    rng, old = random.Random(5), r"([A-Za-zÀ-ÿ ]+,\s*[A-Z]{2})\b"
    for _ in range(20_000):
        text = "".join(rng.choices(["a", "B", "é", "÷", " ", ",", ", ", "SP", "RJ", "1", "\n", "-"], k=rng.randint(0, 14)))
        a, b = (re.search(p, text, re.ASCII) for p in (old, PLACE))
        assert (a and a.group(1)) == (b and b.group(1)), text
    start = time.time()
    assert one(lambda c: F.regexp_extract(c, PLACE, 1), "palavra " * 40_000 + ". Belo Vale, MG") == " Belo Vale, MG"
    assert time.time() - start < 20


def test_pages_are_split_once_for_all_families(spark, tmp_path):
    """A file of one row group was one task for each family."""
    from listforge.plans import job_queries, load_all

    load_all()
    rows = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>x</p>"), "id").alias("html"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    from listforge.plans.registry import Tables

    pages = job_queries.SplitPages(Tables(spark, str(tmp_path))).pages
    assert pages.dtypes == rows.dtypes and pages.rdd.getNumPartitions() == 3
    assert pages.exceptAll(rows).isEmpty() and pages.count() == 5000


def test_classes_of_spaces_turn_letters_away_first(spark):
    """The classes hold what they held before, of all characters; one long text is searched in less time than by them."""
    old = {tx.SPACE_RUN: r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+",
           tx.EXOTIC_SPACES: r"[\x{00a0}\x{1680}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"}
    chars = spark.createDataFrame([(chr(c), f"a{chr(c)}{chr(c)} b") for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF], "c string, t string")
    for new, before in old.items():
        same = [F.regexp_replace(c, new, "_") == F.regexp_replace(c, before, "_") for c in ("c", "t")]
        assert chars.where(~(same[0] & same[1])).isEmpty()
    java = spark._jvm.java.util.regex.Pattern
    text, spent = "palavra" * 300_000, {}
    for _ in range(5):
        for pattern in [tx.SPACE_RUN, old[tx.SPACE_RUN]]:
            start = time.time()
            java.compile(pattern).matcher(text).find()
            spent[pattern] = min(spent.get(pattern, 99), time.time() - start)
    assert spent[tx.SPACE_RUN] < spent[old[tx.SPACE_RUN]]


def test_empty_to_null_names_its_column_once(spark, one):
    for text, expected in (("", None), (None, None), (" ", " "), ("x", "x")):
        assert one(tx.empty_to_null, text) == expected
    plan = spark.range(1).select(tx.empty_to_null(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("cast(id") == 1
