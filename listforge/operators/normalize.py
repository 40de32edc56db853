"""Raw payload rows -> contract rows, one projection per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listforge.functions import attributes as at, geo, money as mo, text as tx

PAYLOAD_TYPES = {
    "url": "string", "title": "string", "description": "string", "price": "double", "currency": "string", "city": "string",
    "state": "string", "zip_code": "string", "street": "string", "location_raw": "string", "latitude": "double",
    "longitude": "double", "contact_name": "string", "contact_phone": "string", "contact_email": "string",
    "images": "array<string>", "videos": "array<string>", "documents": "array<string>", "links": "array<string>",
    "attributes": "map<string,string>"}


class RawAttributes(dict):
    """Raw attributes by name, as columns."""

    def as_map(self) -> Column:
        return F.create_map(*[x for k, v in self.items() for x in (F.lit(k), v.cast("string"))])

    def as_struct(self) -> Column:
        return F.struct(*[v.cast("string").alias(k) for k, v in self.items()])


def payload(df: DataFrame, keep: tuple[str, ...] = (), **values: Column | RawAttributes) -> DataFrame:
    """Payload row from the given fields; all other fields are absent.  Raw attributes are a map and,
    under ``__raw``, a struct that says which names there are."""
    raw = values.get("attributes")
    extra = []
    if isinstance(raw, RawAttributes):
        extra, values = [raw.as_struct().alias("__raw")], values | {"attributes": raw.as_map()}
    out = [values[n].cast(k).alias(n) if n in values else F.lit(None).cast(k).alias(n) for n, k in PAYLOAD_TYPES.items()]
    return df.select(*keep, *out, *extra)


def attribute_map(**values: Column) -> RawAttributes:
    """Raw attributes of a payload; those without a value are dropped."""
    return RawAttributes(values)


def normalize_listings(raw: DataFrame, category: str) -> DataFrame:
    """Contract row: cleaned title and description, city and state completed from the location hint,
    whitelisted and typed attributes (`typed` as a struct, `attributes` as the storage map)."""
    other = [c for c in raw.columns if c not in PAYLOAD_TYPES and c != "__raw"]
    if "__raw" in raw.columns:
        named = {f.name: F.col(f"__raw.{f.name}") for f in raw.schema["__raw"].dataType.fields}
        typed, place = at.typed_columns(named, category), at.raw_location_of(named)
    else:
        typed, place = at.typed_attributes(F.col("attributes"), category), at.raw_location(F.col("attributes"))
    hint = F.coalesce(tx.clean_text(F.col("location_raw")), place)
    staged = raw.select(
        "*", typed.alias("typed"),
        geo.fill_location(F.col("city"), F.col("state"), hint).alias("__place"))
    price = F.col("price")
    if category == "jobs":
        price = mo.salary_backfill_price(price, F.col("typed.salary_range"))
    has_point = F.col("latitude").isNotNull() | F.col("longitude").isNotNull()
    passed = ["zip_code", "street", "contact_name", "contact_phone", "contact_email", "images", "videos", "documents", "links"]
    return staged.select(
        *other, "url", tx.clean_title(F.col("title"), capitalize=category == "jobs").alias("title"),
        tx.clean_description(F.col("description")).alias("description"), price.alias("price"), "currency",
        F.when(has_point, F.struct("latitude", "longitude")).alias("location"),
        F.col("__place.state").alias("state"), F.col("__place.city").alias("city"), *passed,
        at.storage_map(F.col("typed"), category).alias("attributes"), "typed")
