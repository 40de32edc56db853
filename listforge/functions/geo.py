"""Places, coordinates and contacts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listforge import fixed_values as fv
from listforge.functions import money as mo, text as tx


@tx.bound
def state_uf(c: Column) -> Column:
    """First two-letter word that is a state code, else the first state name in list order."""
    words = F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\b([A-Za-z]{2})\b"), F.lit(1)), lambda w: F.upper(w))
    code = F.try_element_at(F.filter(words, lambda w: tx.one_of(w, fv.UFS)), F.lit(1))
    # a token holds only letters, digits and blanks, so a whole name is one between two blanks
    padded = F.concat(F.lit(" "), F.regexp_replace(tx.norm_token(c), r"\s", " "), F.lit(" "))
    names = {f" {name} ": uf for name, uf in fv.STATE_NAMES.items()}
    found = tx.let(padded, lambda p: F.try_element_at(F.filter(tx.word_table(names), lambda n: F.contains(p, n)), F.lit(1)))
    return F.coalesce(code, F.try_element_at(tx.lookup_table(names), found))


PLACE = r"(?iU)(?:\bem\s+)?([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'`\-\s]{1,60})\s*[-/,]\s*([A-Za-z]{2})\b"


def city_state(c: Column) -> Column:
    """struct<city, state>: first 'City - UF' with a valid UF; else only a state."""
    return _city_state(tx.clean_text(c))


@tx.bound
def _city_state(text: Column) -> Column:
    hits = F.regexp_extract_all(text, F.lit(PLACE), F.lit(0))
    parsed = F.transform(hits, lambda h: F.struct(
        F.regexp_replace(F.regexp_replace(F.regexp_extract(h, PLACE, 1), r"(?U)\s{2,}", " "),
                         r"^[ \-/,]+|[ \-/,]+$", "").alias("city"),
        F.upper(F.regexp_extract(h, PLACE, 2)).alias("state")))
    first = F.try_element_at(F.filter(parsed, lambda s: tx.one_of(s["state"], fv.UFS) & (s["city"] != "")), F.lit(1))
    return tx.let(first, lambda f: F.struct(tx.title_case(f["city"]).alias("city"), F.coalesce(f["state"], state_uf(text)).alias("state")))


def fill_location(city: Column, state: Column, hint: Column) -> Column:
    """struct<city, state>: the raw hint fills only what is missing."""
    own_city, own_state = tx.clean_text(city), state_uf(tx.clean_text(state))
    return tx.let(city_state(hint), lambda guess: F.struct(
        F.coalesce(own_city, guess["city"]).alias("city"), F.coalesce(own_state, guess["state"]).alias("state")))


@tx.bound
def maps_coords(c: Column) -> Column:
    """struct<latitude, longitude> from a map link, ranges checked, first pattern that fits."""
    text = F.replace(F.replace(F.replace(c, F.lit(r"\u0026"), F.lit("&")), F.lit("&amp;"), F.lit("&")),
                     F.lit(r"\/"), F.lit("/"))

    def by(pattern: str) -> Column:
        lat, lon = (F.regexp_extract(text, pattern, g).try_cast("double") for g in (1, 2))
        return F.when(lat.between(-90, 90) & lon.between(-180, 180),
                      F.struct(lat.alias("latitude"), lon.alias("longitude")))

    return F.coalesce(*[by(p) for p in fv.MAP_COORD_PATTERNS])


DMS = r"(?i)(\d{1,3})\D+(\d{1,2})\D+(\d{1,2}(?:[.,]\d+)?)\D*([NSEWO])"


@tx.bound
def dms_to_decimal(c: Column) -> Column:
    deg, minute, sec = (F.replace(F.regexp_extract(c, DMS, g), F.lit(","), F.lit(".")).try_cast("double")
                        for g in (1, 2, 3))
    sign = F.when(F.upper(F.regexp_extract(c, DMS, 4)).isin("S", "W", "O"), -1.0).otherwise(1.0)
    return (deg + minute / 60.0 + sec / 3600.0) * sign


def maps_link(lat: Column, lon: Column, *address: Column) -> Column:
    parts = F.array_join(F.filter(F.array(*address), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    search = F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="),
                      F.replace(F.url_encode(parts), F.lit("+"), F.lit("%20")))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(
        F.lit("https://www.google.com/maps?q="), lat.cast("string"), F.lit(","), lon.cast("string"))
    ).when(parts != "", search)


def find_email(c: Column) -> Column:
    return tx.extract(c, r"(?i)([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})")


def find_phone(c: Column) -> Column:
    return F.trim(tx.extract(c, r"((?:\+?\d{1,3}\s*)?(?:\(?\d{2}\)?\s*)?\d{4,5}[-\s]?\d{4})"))


@tx.bound
def format_phone_br(c: Column) -> Column:
    """(DD) NNNNN-NNNN or (DD) NNNN-NNNN; anything shorter stays as it is."""
    d = mo.digits(c)

    def mask(first: int) -> Column:
        return F.concat(F.lit("("), F.substring(d, 1, 2), F.lit(") "), F.substring(d, 3, first), F.lit("-"),
                        F.substring(d, 3 + first, 4))

    return F.when(c.isNull() | (c == ""), "—").when(F.length(d) >= 11, mask(5)).when(F.length(d) == 10, mask(4)).otherwise(c)


@tx.bound
def format_zip(c: Column) -> Column:
    d = mo.digits(c)
    return F.when(c.isNull() | (c == ""), "—").when(
        F.length(d) >= 8, F.concat(F.substring(d, 1, 5), F.lit("-"), F.substring(d, 6, 3))).otherwise(c)


def has_contact(phone: Column, email: Column) -> Column:
    """At least eight digits, or something shaped like an e-mail address."""
    phone_ok = F.length(mo.digits(F.coalesce(phone, F.lit("")))) >= 8
    mail_ok = tx.strip_spaces(F.coalesce(email, F.lit(""))).rlike(r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$")
    return phone_ok | mail_ok


def location_label(city: Column, state: Column, raw: Column) -> Column:
    place = F.concat_ws(" / ", tx.empty_to_null(tx.strip_spaces(city)), tx.empty_to_null(tx.strip_spaces(state)))
    return F.coalesce(tx.empty_to_null(place), tx.empty_to_null(tx.strip_spaces(raw)), F.lit("Local não informado"))
