"""Amounts, salaries, numbers and dates.

The texts are written from numbers (amounts_v) and dates (places_v), so the oracle states the
number itself instead of repeating the parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from listforge.functions import attributes as at, dates as dt, money as mo
from listforge.plans.registry import query
from listforge.sources import pages as pg

A = ("amounts_v",)
P = ("places_v",)


def _amount(name, fn, text, sql):
    @query(name, f"SELECT id, {sql} AS v FROM amounts_v", A)
    def run(t):
        return t.amounts_v.select("id", fn(F.expr(text)).alias("v"))


_amount("parse_price_brl", mo.parse_price_brl,
        "CASE n % 4 WHEN 0 THEN concat('R$ ', r_text, ',', c_text) WHEN 1 THEN ' Sob Consulta ' WHEN 2 THEN concat('R$ ', r_text, ' - R$ ', r_text) ELSE r_text END",
        "CASE n % 4 WHEN 0 THEN (r * 100 + c) / 100.0 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE CAST(r AS DOUBLE) END")
_amount("parse_amount", mo.parse_amount,
        "CASE n % 5 WHEN 0 THEN concat(r_text, ',', c_text) WHEN 1 THEN concat(replace(r_text, '.', ','), '.', c_text) WHEN 2 THEN r_text WHEN 3 THEN concat(r, '.', c_text) ELSE replace(r_text, '.', ',') END",
        "CASE WHEN n % 5 IN (0, 1, 3) THEN (r * 100 + c) / 100.0 WHEN n % 5 IN (2, 4) THEN CAST(r AS DOUBLE) END")
_amount("salary_floor", mo.salary_floor,
        "CASE n % 4 WHEN 0 THEN concat('de R$ ', r_text, ',', c_text, ' a R$ 99.999,00') WHEN 1 THEN concat('US$', cast(qty as int), 'k/yr') WHEN 2 THEN 'a combinar' ELSE concat('0 ou BRL ', r_text) END",
        "CASE n % 4 WHEN 0 THEN (r * 100 + c) / 100.0 WHEN 1 THEN floor(qty) * 1000.0 WHEN 2 THEN NULL ELSE CAST(r AS DOUBLE) END")
_amount("salary_amounts", lambda c: F.array_join(F.transform(mo.salary_amounts(c), lambda x: F.round(x * 100).cast("long").cast("string")), "|"),
        "concat('R$ ', r_text, ',', c_text, ' a ', cast(qty as int), 'K, id3x9 e EUR ', r, '.')",
        "(r * 100 + c) || '|' || CAST(floor(qty) * 100000 AS BIGINT) || '|' || (r * 100)")
_amount("salary_period", mo.salary_period,
        "CASE n % 6 WHEN 0 THEN concat(r_text, ' por mês') WHEN 1 THEN concat('$', r, '/yr') WHEN 2 THEN 'Semanal' WHEN 3 THEN concat(r, ' ao dia') WHEN 4 THEN concat(r, ' per hour') ELSE r_text END",
        "CASE n % 6 WHEN 0 THEN 'mensal' WHEN 1 THEN 'anual' WHEN 2 THEN 'semanal' WHEN 3 THEN 'diario' WHEN 4 THEN 'horario' END")
_amount("salary_text_find", mo.salary_text_find,
        "CASE n % 4 WHEN 0 THEN concat('Vaga\\n Faixa: até ', r_text, ' \\nfim') WHEN 1 THEN concat('paga R$ ', r_text, ' a R$ 9k ok') WHEN 2 THEN concat('USD ', r, ' to USD ', r) ELSE 'nada' END",
        "CASE n % 4 WHEN 0 THEN 'até ' || r_text WHEN 1 THEN 'R$ ' || r_text || ' a R$ 9k' WHEN 2 THEN 'USD ' || r || ' to USD ' || r END")
_amount("salary_text_dollar", mo.salary_text_dollar, "concat('pay $', r, 'k – $ ', r, 'k yearly')", "'$' || r || 'k – $ ' || r || 'k'")
_amount("parse_int_digits", mo.parse_int_digits, "CASE n % 3 WHEN 0 THEN 'sem' ELSE concat(r_text, ' km') END", "CASE WHEN n % 3 > 0 THEN r END")
_amount("parse_float_br", mo.parse_float_br,
        "CASE n % 5 WHEN 0 THEN concat(r_text, ',', c_text, ' m²') WHEN 1 THEN cast(r as string) WHEN 2 THEN concat('x ', r, ',', c_text) WHEN 3 THEN concat(r, '.5') ELSE 'n/d' END",
        "CASE n % 5 WHEN 0 THEN (r * 100 + c) / 100.0 WHEN 1 THEN CAST(r AS DOUBLE) WHEN 2 THEN (r * 100 + c) / 100.0 WHEN 3 THEN r + 0.5 END")
_amount("parse_year", mo.parse_year,
        "CASE n % 4 WHEN 0 THEN concat('ano ', 1950 + cast(qty as int)) WHEN 1 THEN concat('x', 1950 + cast(qty as int)) WHEN 2 THEN '12345' ELSE concat('1', cast(qty as int) + 10, '/9') END",
        "CASE n % 4 WHEN 0 THEN 1950 + CAST(qty AS INTEGER) WHEN 1 THEN 1950 + CAST(qty AS INTEGER) WHEN 2 THEN NULL ELSE CAST('1' || (CAST(qty AS INTEGER) + 10) || '9' AS INTEGER) END")
_amount("parse_bool_pt", mo.parse_bool_pt, "CASE n % 5 WHEN 0 THEN ' Não ' WHEN 1 THEN 'SIM' WHEN 2 THEN 'Ativo' WHEN 3 THEN '0' ELSE 'talvez' END",
        "CASE n % 5 WHEN 0 THEN FALSE WHEN 1 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN FALSE END")
_amount("value_band", lambda c: mo.value_band(c.cast("double")), "(r - 900) * 12",
        "CASE WHEN (r - 900) * 12 <= 0 THEN NULL WHEN (r - 900) * 12 <= 100000 THEN 'ate_100k' WHEN (r - 900) * 12 <= 500000 THEN '100k_500k' WHEN (r - 900) * 12 <= 1000000 THEN '500k_1m' ELSE 'acima_1m' END")
_amount("experience_years", mo.experience_years,
        "CASE n % 5 WHEN 0 THEN concat(cast(qty * 150 as int), '+ anos de uso') WHEN 1 THEN concat('Entre ', cast(qty * 150 as int), ' e 9999 anos') WHEN 2 THEN concat(cast(qty * 150 as int), ' – 9999 yrs') WHEN 3 THEN concat(cast(qty * 150 as int), ' years') ELSE 'sem' END",
        "CASE WHEN n % 5 < 4 THEN CAST(qty * 150 AS INTEGER) END")
_amount("labelled_amount", lambda c: mo.labelled_amount(c, "condomínio"), "concat('IPTU R$ 1,00 Condomínio: R$ ', r_text, ',', c_text, ' fim')", "(r * 100 + c) / 100.0")
_amount("format_price_br", lambda c: mo.format_price_br(c.cast("double")), "r + c / 100.0D", "r_text || ',' || c_text")
_amount("area_hectares", lambda c: mo.area_hectares(mo.area_hectares_text(c), F.expr("CASE WHEN n % 2 = 0 THEN 'M²' ELSE 'ha' END")),
        "concat('Fazenda de ', r_text, ',', c_text, CASE WHEN n % 3 = 0 THEN ' Hectares' ELSE ' ha' END, ' no sul')",
        "CASE WHEN n % 2 = 0 THEN ((r * 100 + c) / 100.0) / 10000 ELSE (r * 100 + c) / 100.0 END")


@query("discount_pct", """SELECT id, CASE WHEN CAST(r AS DOUBLE) > 0 AND r * (1 - disc) >= 0 THEN round((r - r * (1 - disc)) / r * 100.0, 2) END AS v,
CASE WHEN r <= 30000 THEN round((30000 - r) / 30000.0 * 100.0, 2) END AS w FROM amounts_v""", A)
def discount_pct(t):
    r = F.col("r").cast("double")
    return t.amounts_v.select("id", mo.discount_pct(r, r * (1 - F.col("disc"))).alias("v"), mo.discount_pct(F.lit(30000.0), r).alias("w"))


@query("salary_backfill_price", """SELECT id, CASE WHEN price IS NOT NULL THEN price WHEN salary_range > 0 THEN salary_range END AS price FROM listings_v""", "listings_v")
def salary_backfill_price(t):
    return t.listings_v.select("id", mo.salary_backfill_price(F.col("price"), F.col("salary_range")).alias("price"))


@query("salary_sanitize", """SELECT id, CASE WHEN n % 4 IN (0, 2) THEN CAST(r AS DOUBLE) END AS salary,
CASE n % 4 WHEN 0 THEN 'mensal' END AS kind, 'x' AS other FROM amounts_v""", A)
def salary_sanitize(t):
    attrs = F.expr("""map('salary_range', CASE n % 4 WHEN 0 THEN concat('R$ ', r_text) WHEN 1 THEN 'a combinar' WHEN 2 THEN cast(cast(r as double) as string) ELSE '0' END,
        'salary_type', CASE n % 4 WHEN 0 THEN ' Mensal' WHEN 2 THEN 'anualmente' ELSE 'mensal' END, 'company', 'x')""")
    clean = t.amounts_v.select("id", at.salary_sanitize(attrs).alias("m"))
    return clean.select("id", F.try_element_at("m", F.lit("salary_range")).cast("double").alias("salary"),
                        F.try_element_at("m", F.lit("salary_type")).alias("kind"), F.try_element_at("m", F.lit("company")).alias("other"))


@query("structured_salary_text", """SELECT id, CASE n % 3 WHEN 0 THEN 'USD ' || r || ' - USD ' || (r + 1) WHEN 1 THEN 'BRL ' || r END AS v FROM amounts_v""", A)
def structured_salary_text(t):
    return t.amounts_v.select("id", mo.structured_salary_text(
        F.expr("CASE WHEN n % 3 = 0 THEN 'USD' END"), F.expr("CASE WHEN n % 3 < 2 THEN cast(r as string) END"),
        F.expr("CASE WHEN n % 3 = 0 THEN cast(r + 1 as string) END")).alias("v"))


@query("property_metrics", """SELECT id, CAST(r AS DOUBLE) AS total_area_m2, r / 1.0 + 0.5 AS covered_area_m2, CAST(qty AS INTEGER) AS bedrooms,
n AS bathrooms, CAST(NULL AS INTEGER) AS parking_spots, 2 AS suites, n + 3 AS age_years FROM amounts_v""", A)
def property_metrics(t):
    text = F.expr("concat(r_text, ' m² tot. ', r, ',5 m² útil ', cast(qty as int), ' quartos ', n, ' banheiros 2 suítes ', n + 3, ' anos')")
    return t.amounts_v.select("id", mo.property_metrics(F.regexp_replace(text, r"^(\d+)\.(\d{3}) m² tot", "$1$2 m² tot")).alias("s")).select("id", "s.*")


AMOUNTS_TEXT = "concat('de R$ ', r_text, ',', c_text, ' por R$ ', cast(qty as int), '.000 e R$ 9,50 ou R$', r_text)"
FIRST, SECOND = "((r * 100 + c) / 100.0)", "floor(qty) * 1000.0"


@query("choose_price", f"""SELECT id, CASE WHEN {FIRST} >= 10000 AND {SECOND} >= 10000 THEN least({FIRST}, {SECOND})
WHEN {FIRST} >= 10000 THEN {FIRST} WHEN {SECOND} >= 10000 THEN {SECOND} WHEN r >= 10000 THEN CAST(r AS DOUBLE) ELSE 9.5 END AS main,
9.5 AS least4, CAST(r AS DOUBLE) AS last FROM amounts_v""", A)
def choose_price(t):
    df = t.amounts_v.select("id", mo.page_amounts(F.expr(AMOUNTS_TEXT)).alias("a"))
    return df.select("id", mo.choose_price(F.col("a")).alias("main"), mo.choose_price_first_four(F.col("a")).alias("least4"),
                     mo.choose_price_last(F.col("a")).alias("last"))


@query("choose_price_labelled", "SELECT id, CASE WHEN n % 2 = 0 THEN CAST(r AS DOUBLE) ELSE (r * 100 + c) / 100.0 END AS v FROM amounts_v", A)
def choose_price_labelled(t):
    cards = F.expr("""array(struct('2º leilão' as label, 'R$ 1,00' as value), struct('1º Leilão' as label, concat('R$ ', r_text, ',', c_text) as value),
        struct(CASE WHEN n % 2 = 0 THEN 'Valor de venda' ELSE 'outro' END as label, concat('R$ ', r_text) as value))""")
    return t.amounts_v.select("id", mo.choose_price_labelled(cards).alias("v"))


@query("context_window", """SELECT id, CASE n % 4 WHEN 0 THEN r + 10000.0 WHEN 1 THEN r + 20000.0 WHEN 2 THEN r + 10000.0 ELSE NULL END AS v FROM amounts_v""", A)
def context_window(t):
    big = "concat('R$ ', cast(floor((r + 10000) / 1000) as bigint), '.', lpad(cast((r + 10000) % 1000 as string), 3, '0'))"
    bigger = big.replace("10000", "20000")
    text = F.expr(f"""CASE n % 4
        WHEN 0 THEN concat('Condomínio\\n{{}}\\nx\\ny\\nR$ 5\\nz\\n', {big}, '\\na\\nVenda')
        WHEN 1 THEN concat('Casa\\n', {big}, '\\nq\\nw\\ne\\nr\\n', {bigger}, '\\nb\\nc\\nAluguel')
        WHEN 2 THEN concat('IPTU\\nx\\n', {bigger}, '\\nu\\nv\\nw\\nx\\n', {big}, '\\nfim') ELSE 'R$ 1.000\\nvenda' END""")
    return t.amounts_v.select("id", F.split(text, "\n").alias("ls"), "n").select("id", pg.context_price(F.col("ls")).alias("v"))


# --- dates -----------------------------------------------------------------------------------
SHAPES = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "dd/MM/yyyy", "dd-MM-yyyy", "dd/MM/yy", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS'-03:00'", "yyyy/MM",
          "yyyyMMdd", "yyyy-MM-dd'T'HH", "yyyyMMdd'T'HHmmss'+0300'", "WEEK"]


WEEK = "concat(extract(yearofweek from d), '-W', lpad(weekofyear(d), 2, '0'), '-', weekday(d) + 1)"


def _date_text(shapes=SHAPES, hours="deg % 24"):
    """One shape for each id; WEEK stands for the ISO week date."""
    ts = F.expr(f"d + make_dt_interval(0, {hours}, mnt, deg % 60)")
    text = F
    for i, shape in enumerate(shapes):
        text = text.when(F.expr(f"id % {len(shapes)} = {i}"), F.expr(WEEK) if shape == "WEEK" else F.date_format(ts, shape))
    return text


@query("parse_date_multi", "SELECT id, CASE WHEN id % 12 <> 7 THEN strftime(d, '%Y-%m-%d') END AS v FROM places_v", P)
def parse_date_multi(t):
    return t.places_v.select("id", dt.parse_date_multi(F.concat(F.lit(" "), _date_text())).alias("v"))


STAMP = "(d + to_hours(deg % 24) + to_minutes(mnt) + to_seconds({}))"


@query("parse_datetime_multi", f"""SELECT id, CASE id % 8 WHEN 0 THEN strftime({STAMP.format('deg % 60')}, '%Y-%m-%dT%H:%M:%S') || '+00:00'
WHEN 4 THEN strftime(d + to_hours(deg % 24), '%Y-%m-%dT%H:%M:%S') WHEN 5 THEN strftime({STAMP.format(0)}, '%Y-%m-%dT%H:%M:%S') || '+03:00'
WHEN 6 THEN strftime({STAMP.format('deg % 60')}, '%Y-%m-%dT%H:%M:%S') || '-02:30' WHEN 7 THEN strftime(d, '%Y-%m-%dT%H:%M:%S')
WHEN 1 THEN strftime({STAMP.format(0)}, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime({STAMP.format('deg % 60')}, '%Y-%m-%dT%H:%M:%S') || '-03:00' END AS v FROM places_v""", P)
def parse_datetime_multi(t):
    shapes = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "dd/MM/yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss.SSS'-03:00'", "dd.MM.yyyy",
              "yyyy-MM-dd'T'HH", "yyyyMMdd HH:mm'+03'", "yyyy-MM-dd'T'HHmmss'-0230'", "WEEK"]
    return t.places_v.select("id", dt.parse_datetime_multi(_date_text(shapes)).alias("v"))


@query("to_utc", f"""SELECT id, strftime(CASE id % 8 WHEN 4 THEN {STAMP.format(0)} - INTERVAL 3 HOUR WHEN 5 THEN d + to_hours(deg % 24) WHEN 6 THEN d WHEN 7 THEN {STAMP.format('deg % 60')} + INTERVAL 150 MINUTE WHEN 1 THEN date_trunc('day', d) WHEN 2 THEN {STAMP.format('deg % 60')} + INTERVAL 3 HOUR ELSE {STAMP.format('deg % 60')} END,
'%Y-%m-%dT%H:%M:%S+00:00') AS v FROM places_v""", P)
def to_utc(t):
    shapes = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'-03:00'", "yyyy-MM-dd'T'HH:mm:ss",
              "yyyy-MM-dd'T'HH:mm'+03'", "yyyyMMdd'T'HH", "WEEK", "yyyyMMdd'T'HHmmss'-0230'"]
    return t.places_v.select("id", dt.iso_utc(dt.to_utc(_date_text(shapes))).alias("v"))


@query("auction_datetimes", """SELECT id, strftime(d, '%d/%m/%Y') || ' 14:' || lpad(CAST(mnt AS VARCHAR), 2, '0') AS first, strftime(d + INTERVAL 7 DAY, '%d/%m/%Y') || ' 09:30' AS second,
strftime(d, '%d/%m/%Y') AS day1, '1.234,56' AS value1, strftime(d + INTERVAL 7 DAY, '%d/%m/%Y') AS day2 FROM places_v""", P)
def auction_datetimes(t):
    text = F.expr("""concat('1ª praça: ', date_format(d, 'dd/MM/yyyy'), ' às 14:', lpad(mnt, 2, '0'), repeat(' lote', 60), ' lance R$ 1.234,56. 2ª praça: ',
        date_format(d + interval 7 days, 'dd/MM/yyyy'), ' às 09h30 lance')""")
    return t.places_v.select("id", dt.auction_datetimes(text).alias("a"), dt.auction_rounds(text).alias("r")).select(
        "id", F.try_element_at("a", F.lit(1)).alias("first"), F.try_element_at("a", F.lit(2)).alias("second"),
        F.col("r.first.day").alias("day1"), F.col("r.first.value").alias("value1"), F.col("r.second.day").alias("day2"))


@query("closing_window_days", """SELECT id, CAST(greatest(0, ceil((epoch(executed_at) - epoch(TIMESTAMP '2024-01-15 12:00:00')) / 86400)) AS INTEGER) AS days FROM runs_v""", "runs_v")
def closing_window_days(t):
    return t.runs_v.select("id", dt.closing_window_days(F.col("executed_at"), F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("days"))


