"""Numbers, amounts and salaries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listforge import fixed_values as fv
from listforge.functions import text as tx


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


@tx.bound
def parse_price_brl(c: Column) -> Column:
    """'R$ 1.234,56' -> 1234.56.  Words for 'on request' and ranges give null."""
    body = tx.strip_spaces(F.translate(F.translate(F.replace(c, F.lit("R$"), F.lit("")), ".", ""), ",", "."))
    number = tx.let(body, lambda b: F.when(b.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), b.try_cast("double")))
    return F.when(~F.lower(tx.strip_spaces(c)).isin(fv.PRICE_ON_REQUEST), number)


def parse_amount(token: Column, suffix: Column | None = None) -> Column:
    """Separator-aware amount: the last ',' or '.' is a decimal mark only when one or two
    digits follow it; the other separators are thousands.  k and m multiply."""
    amount = tx.let(F.regexp_replace(token, r"[^\d,.\-]", ""), _amount_of_raw)
    if suffix is None:
        return amount
    kind = F.lower(F.trim(F.coalesce(suffix, F.lit(""))))
    return amount * F.when(kind == "k", 1_000).when(kind == "m", 1_000_000).otherwise(1)


def _amount_of_raw(raw: Column) -> Column:
    tail = tx.extract(raw, r"^.*[,.](\d{1,2})$")
    head = F.regexp_extract(raw, r"^(.*)[,.]\d{1,2}$", 1)
    # with a single kind of separator more than one decimal mark is not a number
    mixed = raw.contains(",") & raw.contains(".")
    mark = F.regexp_extract(raw, r"([,.])\d{1,2}$", 1)
    repeated = ~mixed & F.replace(head, F.lit("."), F.lit(",")).contains(",")
    with_decimals = F.concat(F.translate(head, ",.", ""), F.lit("."), tail)
    other_left = mixed & (F.instr(head, mark) > 0)
    normal = (F.when(tail.isNull(), F.translate(raw, ",.", ""))
              .when(repeated | other_left, F.lit(None).cast("string"))
              .otherwise(with_decimals))
    return normal.try_cast("double")


def salary_amounts(c: Column) -> Column:
    """All positive amounts of a text in order."""
    hits = F.regexp_extract_all(c, F.lit(fv.SALARY_AMOUNT_PATTERN), F.lit(0))

    def amount(hit: Column) -> Column:
        number = F.regexp_extract(hit, r"(\d[\d.,]*)", 1)
        return parse_amount(number, F.regexp_extract(hit, r"[\d.,]\s*([kKmM])$", 1))

    return F.filter(F.transform(hits, amount), lambda x: x > 0)


def salary_floor(c: Column) -> Column:
    """First positive amount of the text."""
    return F.try_element_at(salary_amounts(c), F.lit(1))


def salary_period(c: Column) -> Column:
    return tx.first_pattern(F.lower(tx.ascii_fold(c)), fv.SALARY_PERIOD_PATTERNS)


@tx.bound
def salary_text_find(c: Column) -> Column:
    """Salary text of a message: a labelled line, else the first R$ range, else a USD/EUR range."""
    label_line = tx.extract(c, r"(?imU)^[^\S\n]*((?:salário|salario|salary|faixa)[^\n]*)$")
    after_colon = tx.strip_spaces(F.substring(label_line, F.instr(label_line, ":") + 1, F.length(label_line)))
    labelled = F.when(label_line.contains(":"), after_colon).otherwise(tx.strip_spaces(label_line))
    reais = tx.extract(c, r"(?iU)(R\$\s*[0-9\.,k]+(?:\s*(?:a|até|to|-)\s*R?\$?\s*[0-9\.,k]+)?)")
    foreign = tx.extract(c, r"(?iU)((?:USD|US\$|EUR|€)\s*[0-9\.,k]+(?:\s*(?:a|até|to|-)\s*(?:USD|US\$|EUR|€)?\s*[0-9\.,k]+)?)")
    return F.coalesce(labelled, F.trim(reais), F.trim(foreign))


def salary_text_dollar(c: Column) -> Column:
    return tx.extract(c, r"(\$\s?[\d,]+[kK]?(?:\s*[–-]\s*\$\s?[\d,]+[kK]?)?)")


def salary_backfill_price(price: Column, salary_range: Column) -> Column:
    return F.coalesce(price, F.when(salary_range > 0, salary_range))


@tx.bound
def salary_type_or_none(c: Column) -> Column:
    token = F.lower(tx.strip_spaces(c))
    return F.when(token.isin(fv.CATEGORY_ATTRIBUTES["jobs"]["salary_type"]), token)


def structured_salary_text(currency: Column, low: Column, high: Column) -> Column:
    """'BRL 10 - BRL 20' from a min / max / currency struct."""
    unit = F.coalesce(currency, F.lit("BRL"))
    low_text, high_text = F.concat(unit, F.lit(" "), low), F.concat(unit, F.lit(" "), high)
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(low_text, F.lit(" - "), high_text)).otherwise(low_text)


def parse_int_digits(c: Column) -> Column:
    return digits(c).try_cast("long")


def parse_float_br(c: Column) -> Column:
    """First number of a text with Brazilian separators: the longest token counts, and groups
    of three digits after dots are thousands unless a comma follows."""
    token = tx.extract(c, r"(-?\d{1,3}(?:\.\d{3})+(?:,\d+)?(?![\d])|-?\d+,\d+|-?\d+\.\d+|-?\d+)")
    return tx.let(token, lambda t: (
        F.when(t.contains(","), F.translate(F.translate(t, ".", ""), ",", "."))
        .when(t.rlike(r"^-?\d{1,3}(?:\.\d{3})+$"), F.translate(t, ".", "")).otherwise(t)).try_cast("double"))


@tx.bound
def parse_year(c: Column) -> Column:
    number = digits(c)
    return F.coalesce(tx.extract(c, r"(?U)\b((?:19|20)\d{2})\b"), F.when(F.length(number) == 4, number)).try_cast("int")


@tx.bound
def parse_bool_pt(c: Column) -> Column:
    token = tx.norm_token(c)
    return F.when(token.isin(fv.TRUE_WORDS), True).when(token.isin(fv.FALSE_WORDS), False)


def discount_pct(reference: Column, value: Column) -> Column:
    valid = (reference > 0) & (value >= 0) & (value <= reference)
    return F.when(valid, F.round((reference - value) / reference * 100.0, 2))


def value_band(c: Column) -> Column:
    return (F.when(c <= 0, None).when(c <= 100_000, "ate_100k").when(c <= 500_000, "100k_500k")
            .when(c <= 1_000_000, "500k_1m").when(c.isNotNull(), "acima_1m"))


@tx.bound
def area_hectares_text(c: Column) -> Column:
    """'N Hectares' first, then 'N ha'."""
    token = F.coalesce(tx.extract(c, r"(?i)([\d.,]+)\s*hectares?\b"), tx.extract(c, r"(?i)([\d.,]+)\s*ha\b"))
    return parse_float_br(token)


def area_hectares(value: Column, unit: Column) -> Column:
    square_metre = tx.norm_token(unit).isin("m2", "metro", "metros", "metro quadrado", "metros quadrados")
    return F.when(F.coalesce(square_metre, F.lit(False)), value / 10000.0).otherwise(value)


@tx.bound
def experience_years(c: Column) -> Column:
    """Years asked for; a range takes its lower bound."""
    between = tx.extract(c, r"(?iU)entre\s+(\d+)\s+e\s+\d+\s+anos")
    span = tx.extract(c, r"(?iU)(\d+)\s*[-–]\s*\d+\s+(?:years|yrs|anos)")
    single = tx.extract(c, r"(?iU)(\d+)\s*\+?\s*(?:anos|years|yrs)")
    return F.coalesce(between, span, single).try_cast("int")


def labelled_amount(c: Column, label: str) -> Column:
    """Amount in R$ that directly follows a label (the label is a regex)."""
    return parse_price_brl(tx.extract(c, rf"(?iU){label}[:\s]*R\$\s*([\d\.]+(?:,\d{{2}})?)"))


def metric(c: Column, pattern: str) -> Column:
    token = tx.extract(c, pattern)
    return F.translate(F.translate(token, ".", ""), ",", ".").try_cast("double")


@tx.bound
def property_metrics(c: Column) -> Column:
    return F.struct(
        metric(c, r"(?iU)(\d+(?:[\.,]\d+)?)\s*m²\s*tot").alias("total_area_m2"),
        metric(c, r"(?iU)(\d+(?:[\.,]\d+)?)\s*m²\s*(?:útil|util)").alias("covered_area_m2"),
        tx.extract(c, r"(?iU)(\d+)\s+quartos?").try_cast("int").alias("bedrooms"),
        tx.extract(c, r"(?iU)(\d+)\s+ban(?:heiros?|s?)").try_cast("int").alias("bathrooms"),
        tx.extract(c, r"(?iU)(\d+)\s+vagas?").try_cast("int").alias("parking_spots"),
        tx.extract(c, r"(?iU)(\d+)\s+su[ií]tes?").try_cast("int").alias("suites"),
        tx.extract(c, r"(?iU)(\d+)\s+anos?").try_cast("int").alias("age_years"),
    )


def format_price_br(c: Column) -> Column:
    return F.translate(F.format_number(c, 2), ",.", ".,")


AMOUNT_IN_REAIS = r"R\$\s*([\d\.]+(?:,\d{2})?)"


def page_amounts(c: Column) -> Column:
    """Every R$ amount of a text in order."""
    hits = F.regexp_extract_all(c, F.lit(AMOUNT_IN_REAIS), F.lit(1))
    return F.filter(F.transform(hits, parse_price_brl), lambda x: x.isNotNull())


@tx.bound
def choose_price(amounts: Column, floor: float = 10_000.0) -> Column:
    """Smaller of the first two when both reach the floor, else the first that does, else the least."""
    first, second = F.try_element_at(amounts, F.lit(1)), F.try_element_at(amounts, F.lit(2))
    large = F.try_element_at(F.filter(amounts, lambda x: x >= floor), F.lit(1))
    return F.when((first >= floor) & (second >= floor), F.least(first, second)).otherwise(
        F.coalesce(large, F.array_min(amounts)))


def choose_price_first_four(amounts: Column) -> Column:
    return F.array_min(F.slice(amounts, 1, 4))


def choose_price_last(amounts: Column) -> Column:
    return F.try_element_at(amounts, F.lit(-1))


def choose_price_labelled(cards: Column) -> Column:
    """Price of the first card by label rank: 'valor', first auction, second auction, any other."""
    def rank(card: Column) -> Column:
        label = F.lower(card["label"])
        return (F.when(label.contains("valor"), 0)
                .when(label.contains("1º leilão") | label.contains("1o leilao"), 1)
                .when(label.contains("2º leilão") | label.contains("2o leilao"), 2).otherwise(99))

    ranked = F.filter(F.transform(cards, lambda card, i: F.struct(
        rank(card).alias("rank"), i.alias("pos"), parse_price_brl(card["value"]).alias("price"))),
        lambda s: s["price"].isNotNull())
    return F.array_min(ranked)["price"]
