"""List rows completed from their detail pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def enrich_listing_detail(listed: DataFrame, detail: DataFrame, detail_first: list[str], list_first: list[str]) -> DataFrame:
    """Left join by url with one precedence per field; an empty text counts as missing."""
    d = detail.select("url", *[F.col(c).alias(f"d_{c}") for c in detail.columns if c != "url"])
    joined = listed.join(d, "url", "left")
    out = []
    for name in listed.columns:
        if f"d_{name}" not in joined.columns:
            out.append(F.col(name))
            continue
        own, other = F.nullif(F.col(name), F.lit("")), F.nullif(F.col(f"d_{name}"), F.lit(""))
        out.append((F.coalesce(other, own) if name in detail_first else F.coalesce(own, other)).alias(name))
    return joined.select(*out)
