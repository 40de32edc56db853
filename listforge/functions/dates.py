"""Dates and times.  'Now' is always an argument, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listforge import fixed_values as fv
from listforge.functions import text as tx

# An ISO 8601 text: calendar or week date, plain or compact; after any one character a time; an offset.
ISO_DATE = r"\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?"
ISO_TIME = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?|\d{2}(?:\d{2}(?:[.,]\d+)?)?)?"
ISO_OFFSET = r"[+-]\d{2}(?::\d{2}(?::\d{2})?|\d{2}(?:\d{2})?)?"
ISO = rf"^({ISO_DATE})(?:.({ISO_TIME})({ISO_OFFSET})?)?$"


def _pattern_of(fmt: str) -> str:
    """Exact shape of a format, so that the parser is only asked for texts it can read."""
    shape = fmt
    for letters, digit in (("yyyy", r"\d{4}"), ("yy", r"\d{2}"), ("MM", r"\d{1,2}"), ("dd", r"\d{1,2}"),
                           ("HH", r"\d{1,2}"), ("mm", r"\d{1,2}"), ("ss", r"\d{1,2}")):
        shape = shape.replace(letters, digit)
    return f"^{shape}$"


def _by_formats(raw: Column, formats: list[str]) -> Column:
    def lenient(fmt: str) -> str:
        return fmt.replace("MM", "M").replace("dd", "d").replace("HH", "H").replace("mm", "m").replace("ss", "s")

    def read(fmt: str) -> Column:
        stamp = F.try_to_timestamp(raw, F.lit(lenient(fmt)))
        if "yyyy" not in fmt:  # two-digit years from 69 on belong to the last century
            stamp = F.when(F.year(stamp) >= 2069, F.add_months(stamp, -1200).cast("timestamp")
                           + (stamp - F.date_trunc("day", stamp))).otherwise(stamp)
        return F.when(raw.rlike(_pattern_of(fmt)), stamp)

    return F.coalesce(*[read(f) for f in formats])


def _iso_day(text: Column) -> Column:
    """Date of a calendar or week date; a week without a day means its Monday."""
    bare = F.replace(text, F.lit("-"), F.lit(""))
    week = F.substring(bare, 6, 2).cast("int")
    monday = F.trunc(F.try_to_date(F.concat(F.substring(bare, 1, 4), F.lit("0104")), "yyyyMMdd"), "week")
    place = F.coalesce(F.nullif(F.substring(bare, 8, 1), F.lit("")).cast("int"), F.lit(1))
    found = F.date_add(monday, (week - 1) * 7 + place - 1)
    fits = (F.weekofyear(found) == week) & place.between(1, 7)
    return F.when(F.contains(bare, F.lit("W")), F.when(fits, found)).otherwise(F.try_to_date(bare, "yyyyMMdd"))


def _iso(raw: Column) -> Column:
    """struct<stamp, offset, shift> of an ISO text: wall clock, offset as text ('' without one) and in seconds; else null."""
    plain = F.replace(raw, F.lit("Z"), F.lit("+00:00"))

    def read(text: Column) -> Column:
        pieces = F.split(F.regexp_replace(text, ISO, "$1\u0001$2\u0001$3"), "\u0001")
        bare = lambda c: F.replace(c, F.lit(":"), F.lit(""))
        parts = tx.let(pieces, lambda p: F.struct(p[0].alias("day"), bare(p[1]).alias("time"), bare(p[2]).alias("offset")))
        return F.when(text.rlike(ISO), tx.let(parts, build))

    def build(p: Column) -> Column:
        number = lambda c, at: F.coalesce(F.nullif(F.substring(c, at, 2), F.lit("")).cast("int"), F.lit(0))
        seconds = F.concat(F.coalesce(F.nullif(F.substring(p["time"], 5, 2), F.lit("")), F.lit("0")), F.lit("."), F.substring(p["time"], 8, 6), F.lit("0")).cast("decimal(8,6)")
        hours, minutes, rest = (number(p["offset"], at) for at in (2, 4, 6))
        sign = F.when(F.startswith(p["offset"], F.lit("-")), -1).otherwise(1)
        text = F.when(p["offset"] == "", "").otherwise(F.concat(
            F.substring(p["offset"], 1, 3), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"), F.when(rest > 0, F.concat(F.lit(":"), F.lpad(rest.cast("string"), 2, "0"))).otherwise("")))
        valid = (hours < 24) & (minutes < 60) & (rest < 60) & (number(p["time"], 5) < 60)
        stamp = tx.let(_iso_day(p["day"]), lambda d: F.try_make_timestamp(F.year(d), F.month(d), F.day(d), number(p["time"], 1), number(p["time"], 3), seconds))
        return F.struct(F.when(valid, stamp).alias("stamp"), text.alias("offset"), (sign * (hours * 3600 + minutes * 60 + rest)).alias("shift"))

    return tx.let(plain, read)


def parse_date_multi(c: Column) -> Column:
    """ISO date text from ISO or one of the known formats, else null.  A date does not move with an offset."""
    return tx.let(tx.strip_spaces(c), lambda raw: F.date_format(
        F.coalesce(_iso(raw)["stamp"], _by_formats(raw, fv.DATE_FORMATS)), "yyyy-MM-dd"))


def parse_datetime_multi(c: Column) -> Column:
    """ISO date-time text without fractions; an offset in the input is kept as text."""
    def write(raw: Column) -> Column:
        return tx.let(_iso(raw), lambda i: F.concat(
            F.date_format(F.coalesce(i["stamp"], _by_formats(raw, fv.DATETIME_FORMATS)), "yyyy-MM-dd'T'HH:mm:ss"),
            F.when(i["stamp"].isNotNull(), i["offset"]).otherwise("")))

    return tx.let(tx.strip_spaces(c), write)


def to_utc(c: Column) -> Column:
    """Timestamp of an ISO text: offsets are applied, a naive time counts as UTC."""
    shifted = lambda i: F.timestamp_micros(F.unix_micros(i["stamp"]) - i["shift"].cast("long") * 1_000_000)
    return tx.let(tx.strip_spaces(tx.unescape_basic(c)), lambda raw: tx.let(_iso(raw), shifted))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def auction_datetimes(c: Column) -> Column:
    """All 'dd/mm/yyyy às hh:mm' of a text as 'dd/MM/yyyy HH:mm', in order."""
    hits = F.regexp_extract_all(c, F.lit(r"(?iU)(\d{2}/\d{2}/\d{2,4}\s*(?:às|as|-)?\s*\d{2}[:h]\d{2})"), F.lit(1))
    return F.transform(hits, lambda x: F.concat(
        F.regexp_extract(x, r"^(\d{2}/\d{2}/\d{2,4})", 1), F.lit(" "),
        F.replace(F.regexp_extract(x, r"(\d{2}[:h]\d{2})$", 1), F.lit("h"), F.lit(":"))))


def auction_rounds(c: Column) -> Column:
    """First and second round: date and value, each read up to the next round's label."""
    label = r"[ªºa]\s*(?:praça|praca|leilão|leilao)"
    parts = F.split(c, rf"(?isU)(?=[12]{label})")

    def round_of(n: int) -> Column:
        body = F.try_element_at(F.filter(parts, lambda x: x.rlike(rf"(?isU)^{n}{label}")), F.lit(1))
        return F.struct(tx.extract(body, r"(\d{2}/\d{2}/\d{4})").alias("day"),
                        tx.extract(body, r"R\$\s*([\d.]+,\d{2})").alias("value"))

    return F.struct(round_of(1).alias("first"), round_of(2).alias("second"))


def closing_window_days(end: Column, now: Column) -> Column:
    seconds = F.unix_micros(end) / 1e6 - F.unix_micros(now) / 1e6
    return F.when(end.isNotNull(), F.greatest(F.lit(0), F.ceil(seconds / 86400)).cast("int"))


def local_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, fv.TIME_ZONE))


def local_day_label(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, fv.TIME_ZONE), "dd/MM")


def local_datetime_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, fv.TIME_ZONE), "dd/MM/yyyy HH:mm"), F.lit("—"))
