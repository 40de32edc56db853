"""The listing query: optional filters, sort orders and paging.

Every filter is a Column, so Catalyst pushes what it can into the parquet scan and prunes the
rest of the columns.  The source table is joined only when a filter or the output needs a
source name; it carries no broadcast hint, so Spark's own size check decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from listforge.functions import geo, text as tx

CONTRACT_VARIANTS = {"pj": ["pj", "pessoa juridica", "pessoa jurídica"], "clt": ["clt"]}
SENIORITY_VARIANTS = {"junior": ["junior", "júnior", "jr"], "pleno": ["pleno"], "senior": ["senior", "sênior", "sr"]}
FLAG_WORDS = ["true", "1", "sim"]


@dataclass(frozen=True)
class ListingFilter:
    text: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    currency: str | None = None
    state: str | None = None
    city: str | None = None
    source: str | None = None
    created_since: datetime | None = None
    contract_type: str | None = None
    seniority: str | None = None
    has_contact: bool | None = None
    has_salary: bool | None = None
    software_focus: bool | None = None
    actionable_now: bool | None = None

    def needs_source(self) -> bool:
        return bool(_arg(self.text) or _arg(self.source))


def _arg(value: str | None) -> str:
    return " ".join((value or "").lower().split())


def attribute(df: DataFrame, name: str) -> Column:
    """An attribute is a flat column in a typed projection, else an entry of the attribute map."""
    if name in df.columns:
        return F.col(name)
    if "attributes" in df.columns:
        return F.try_element_at(F.col("attributes"), F.lit(name))
    return F.lit(None).cast("string")


def join_source_name(listings: DataFrame, sources: DataFrame) -> DataFrame:
    names = sources.select(F.col("id").alias("__source"), F.col("name").alias("source_name"))
    return listings.join(names, F.col("source_id") == F.col("__source"), "left").drop("__source")


def source_label(source_id: Column, name: Column, attribute_name: Column) -> Column:
    """Name, else 'Fonte #id', else the attribute, else 'Fonte local'."""
    return F.when(source_id.isNotNull(), F.coalesce(name, F.concat(F.lit("Fonte #"), source_id.cast("string")))).otherwise(
        F.coalesce(tx.empty_to_null(F.trim(attribute_name)), F.lit("Fonte local")))


def haystack(df: DataFrame) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (F.col("title"), F.col("description"),
                                               F.lower(F.trim(F.col("source_name"))), attribute(df, "company"))]
    return F.lower(F.concat_ws(" ", *parts))


def max_price(limit: float) -> Column:
    """A limit of 0 asks for listings without a price."""
    return F.col("price").isNull() if limit == 0 else F.col("price") <= limit


def currency_is(value: str) -> Column:
    token = tx.normalize_arg(F.col("currency"))
    return ~token.isin("", "brl", "usd") if value == "other" else token == value


def flag_is(df: DataFrame, name: str, wanted: bool) -> Column:
    return tx.normalize_arg(attribute(df, name)).isin(FLAG_WORDS) == F.lit(wanted)


def salary_present(df: DataFrame) -> Column:
    """Only a number counts; text in that attribute never does."""
    return F.coalesce(attribute(df, "salary_range").try_cast("double") > 0, F.lit(False))


def predicates(df: DataFrame, f: ListingFilter) -> list[Column]:
    """One Column per filter that is set, in no particular order: they are all ANDed."""
    found: list[Column] = []
    if _arg(f.source):
        found.append(F.lower(F.trim(F.col("source_name"))) == _arg(f.source))
    if _arg(f.text):
        found.append(haystack(df).contains(_arg(f.text)))
    if f.min_price is not None:
        found.append(F.col("price") >= float(f.min_price))
    if f.max_price is not None:
        found.append(max_price(float(f.max_price)))
    if _arg(f.currency):
        found.append(currency_is(_arg(f.currency)))
    if _arg(f.state):
        found.append(F.upper(tx.normalize_arg(F.col("state"))) == _arg(f.state).upper())
    if _arg(f.city):
        found.append(tx.normalize_arg(F.col("city")).contains(_arg(f.city)))
    if f.created_since is not None:
        found.append(F.col("created_at").isNull() | (F.col("created_at") >= F.lit(f.created_since)))
    if _arg(f.contract_type) in CONTRACT_VARIANTS:
        found.append(tx.normalize_arg(attribute(df, "contract_type")).isin(CONTRACT_VARIANTS[_arg(f.contract_type)]))
    if _arg(f.seniority):
        wanted = SENIORITY_VARIANTS.get(_arg(f.seniority), [_arg(f.seniority)])
        found.append(tx.normalize_arg(attribute(df, "seniority")).isin(wanted))
    if f.has_contact is not None:
        found.append(geo.has_contact(F.col("contact_phone"), F.col("contact_email")) == F.lit(f.has_contact))
    if f.has_salary is not None:
        found.append(salary_present(df) == F.lit(f.has_salary))
    for name in ("software_focus", "actionable_now"):
        if getattr(f, name) is not None:
            found.append(flag_is(df, name, getattr(f, name)))
    return found


def filter_listings(listings: DataFrame, f: ListingFilter, sources: DataFrame | None = None) -> DataFrame:
    if f.needs_source() and "source_name" not in listings.columns:
        listings = join_source_name(listings, sources)
    for condition in predicates(listings, f):
        listings = listings.where(condition)
    return listings


def sort_columns(order_by: str = "created_at", direction: str = "desc") -> list[Column]:
    """Sort keys.  Null prices come last going up and first going down; null times count as the
    earliest; titles compare without case; equal keys keep id order."""
    down = (direction or "").lower() != "asc"
    if order_by == "price":
        key = F.col("price").desc_nulls_first() if down else F.col("price").asc_nulls_last()
    elif order_by == "title":
        title = F.lower(F.coalesce(F.col("title"), F.lit("")))
        key = title.desc() if down else title.asc()
    else:
        name = "updated_at" if order_by == "updated_at" else "created_at"
        key = F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first()
    return [key, F.col("id").asc()]


def page_slice(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """With a limit a top-k per partition after a sort; without one (None) all rows."""
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def query_listings(listings: DataFrame, sources: DataFrame, f: ListingFilter = ListingFilter(),
                   order_by: str = "created_at", direction: str = "desc", limit: int | None = None, offset: int = 0) -> DataFrame:
    kept = filter_listings(listings, f, sources)
    return page_slice(kept.orderBy(*sort_columns(order_by, direction)), limit, offset)


def count_listings(listings: DataFrame, sources: DataFrame, f: ListingFilter = ListingFilter()) -> DataFrame:
    return filter_listings(listings, f, sources).agg(F.count(F.lit(1)).alias("total"))


def search_listings(listings: DataFrame, sources: DataFrame, text: str, size: int | None = None) -> DataFrame:
    return query_listings(listings, sources, ListingFilter(text=text), limit=size)


def lookup_by_ids(listings: DataFrame, requested: DataFrame, id_column: str = "id") -> DataFrame:
    """Listings in request order; repeats stay, ids <= 0 and unknown ids go."""
    wanted = requested.where(F.col(id_column) > 0)
    return wanted.join(listings, id_column, "inner").orderBy("pos")


def page_clamp(df: DataFrame, size: int, page: int) -> DataFrame:
    """Total pages (at least one) and the page number kept inside them."""
    total = F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        "n", total.alias("total_pages"), F.least(F.lit(page), total).cast("long").alias("current_page"))

