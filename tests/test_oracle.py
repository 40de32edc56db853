"""A cross-section of the registered queries against their SQL (tools/check.py runs all of them)."""

import pytest
from check import compare, duck_connection

FOLDER = "/root/testdata/sf0.001"
NAMES = """query_listings count_listings filter_text filter_currency_other filter_has_contact sort_price_desc lookup_by_ids runs_by_day
scraper_totals recent_runs scraper_run_labels_rollup enqueue_report process_queue chat_messages_since interleaved_cap clean_description html_to_text
norm_token format_description parse_amount salary_floor parse_float_br choose_price context_window parse_date_multi city_state maps_coords
norm_url control_number typed_attributes message_title message_company message_dedupe_key page_links page_blocks extract_jsonld
page_label_values rule_score rule_argmax matched_keywords resolve_listing merge_listing ingest_batch batch_groups fold_links patch_listing
sync_catalog schedule_expand normalize_listings extract_job_feed extract_messages extract_vehicles stream_dedup stream_first_seen stream_run_rollup stream_queue
ingest_indexed stream_messages envelope_json find_or_create_source append_run_history create_rejects replace_listing""".split()


@pytest.fixture(scope="module")
def duck():
    return duck_connection(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as entry

    message, _, good = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert good, message


def test_every_query_has_sql_and_entry_runs(spark):
    import __spark_entry__ as entry
    from listforge.plans import load_all

    registry = load_all()
    assert set(registry.QUERIES) == set(registry.ORACLES) and set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
