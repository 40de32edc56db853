"""Registered queries: every entry runs a library operator over whole tables, next to the SQL
that has to give the same rows."""

from importlib import import_module

FAMILIES = ("listing_queries", "rollup_queries", "text_queries", "money_queries", "place_queries",
            "classify_queries", "page_queries", "rule_queries", "merge_queries", "catalog_queries", "job_queries",
            "stream_queries")


def load_all():
    """Import every family once and return the registry."""
    for family in FAMILIES:
        import_module(f"listforge.plans.{family}")
    return import_module("listforge.plans.registry")
