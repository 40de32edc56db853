"""Ingest and single writes on small batches with repeated keys."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from listforge.operators import catalog as ca, merge as mg, queue as qu
from listforge.sources import tables as tb

NOW = datetime(2024, 1, 31)
SHAPE = """id long, url string, source_id int, title string, description string, price double, currency string, state string, city string, zip_code string,
street string, contact_name string, contact_phone string, contact_email string, location struct<latitude:double,longitude:double>, images array<string>,
videos array<string>, documents array<string>, links array<string>, attributes map<string,string>, version int, created_at timestamp, updated_at timestamp"""


def listings(spark, rows, first="id"):
    names = [c.split()[0] for c in SHAPE.replace("latitude:double,longitude:double", "").replace("string,string", "").split(",")]
    full = [tuple({"version": 1, "currency": "BRL", "source_id": 1, "updated_at": datetime(2024, 1, 1), "attributes": {}, "links": [], **r}.get(n) for n in names) for r in rows]
    df = spark.createDataFrame(full, SHAPE)
    return df if first == "id" else df.withColumnRenamed("id", first).drop("version", "created_at", "updated_at")


def ingest(spark, stored, batches):
    state = listings(spark, stored)
    for b in batches:
        state = mg.ingest_batch(listings(spark, b, "row_id"), state, F.lit(NOW)).checkpoint()
    return {r.url: r for r in state.collect()}


LINK, OTHER = "https://site.example/job", "https://site.example/other"
CHAIN = [{"id": 1, "url": "u1", "links": [LINK], "title": "a"}, {"id": 2, "url": "u2", "links": [LINK, OTHER], "title": "b"},
         {"id": 3, "url": "u3", "links": [OTHER], "title": "c"}]


@pytest.mark.parametrize("cuts", [[3], [1, 1, 1], [2, 1], [1, 2]])
def test_stored_rows_reach_the_batch_through_the_batch(spark, cuts):
    rows, batches = list(CHAIN), []
    for n in cuts:
        batches.append(rows[:n])
        rows = rows[n:]
    got = ingest(spark, [{"id": 7, "url": "u1", "title": "old"}], batches)
    assert set(got) == {"u1"} and got["u1"].id == 7 and got["u1"].title == "c" and got["u1"].version == 4


def test_rows_of_different_listings_stay_apart(spark):
    stored = [{"id": 7, "url": "u1"}, {"id": 8, "url": "u2"}]
    rows = [{"id": 1, "url": "n0", "links": [LINK]}, {"id": 2, "url": "u1", "links": [LINK]}, {"id": 3, "url": "u2", "links": [LINK]}, {"id": 4, "url": "n1", "links": [LINK], "title": "t"}]
    one = ingest(spark, stored, [rows])
    assert one["u2"].title == "t" and one["u1"].version == 2 and one["u2"].version == 3 and set(one) == {"n0", "u1", "u2"}


def test_clean_up_at_ingest(spark):
    rows = [{"id": 1, "url": "u", "description": "<p>Senior&nbsp;x</p>", "currency": None, "attributes": {"salary_range": "n/d", "salary_type": "mensal"}}]
    row = ingest(spark, [], [rows])["u"]
    assert (row.description, row.currency, row.attributes, row.id) == ("Senior x", "BRL", {}, 1)


def test_sources_of_a_batch_get_ids(spark):
    sources = spark.createDataFrame([(4, "Known")], "id int, name string")
    rows = listings(spark, [{"id": i, "url": f"u{i}"} for i in range(4)], "row_id").withColumn(
        "source_name", F.expr("CASE row_id WHEN 0 THEN ' KNOWN ' WHEN 1 THEN 'Fresh' WHEN 2 THEN ' ' ELSE 'fresh' END"))
    got = {r.row_id: r.source_id for r in mg.prepare_ingest(rows, sources).collect()}
    assert got == {0: 4, 1: 5, 2: 6, 3: 5}
    assert sorted(map(tuple, ca.find_or_create_source(rows.select(F.col("source_name").alias("name")), sources).collect())) == [(5, "fresh"), (6, "unknown")]


def test_one_row_a_url_is_created(spark):
    stored = listings(spark, [{"id": 1, "url": "held"}])
    rows = spark.createDataFrame([(1, "new", "<b>x</b>"), (2, "new", "y"), (3, "held", "z"), (4, "", "p"), (5, None, "q")], "row_id long, url string, description string")
    assert {(r.row_id, r.description) for r in mg.create_listing(rows, stored).collect()} == {(1, "x"), (4, "p"), (5, "q")}
    assert {r.row_id for r in mg.create_rejects(rows, stored).collect()} == {2, 3}


def test_replacements_of_one_id_are_applied_in_order(spark):
    stored = listings(spark, [{"id": 1, "url": "u", "version": 4}])
    rows = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 12, "c")], "id long, row_id long, title string")
    got = sorted((r.row_id, r.version, r.status) for r in mg.replace_listing(rows, stored).collect())
    assert got == [(10, 5, "superseded"), (11, 6, "replaced"), (12, None, "missing")]


def test_second_patch_of_a_version_is_a_conflict(spark):
    stored = listings(spark, [{"id": 1, "url": "u", "title": "t", "version": 1}])
    at = lambda h: datetime(2024, 1, 30, h)
    rows = [(1, 1, at(1), ["title"], "x"), (1, 1, at(2), ["title"], "y"), (1, 2, at(3), ["title"], "z"), (1, None, None, ["nope"], "n"), (5, 1, at(1), ["title"], "m")]
    patches = spark.createDataFrame(rows, "id long, expected_version int, submitted_at timestamp, fields array<string>, new_title string")
    got = mg.patch_listing(stored, patches, F.lit(datetime(2024, 1, 29))).collect()
    assert sorted((r.id or 0, r.version or 0, r.title or "", r.status) for r in got) == [
        (1, 1, "t", "invalid"), (1, 2, "x", "applied"), (1, 2, "x", "conflict_version"), (1, 3, "z", "applied"), (5, 0, "", "missing")]


def test_repeated_outcomes_give_one_row(spark):
    pending = spark.createDataFrame([(1, "src", "https://x", 9, "queued", 0, None, None)], "id long, source_name string, url string, item_id long, status string, attempts int, last_error string, last_processed_at timestamp")
    outcome = (1, False, False, 404, False, None, None)
    outcomes = spark.createDataFrame([outcome, outcome], "id long, found boolean, chat_missing boolean, status_code int, blocked boolean, fetch_error string, raised string")
    assert qu.mark_processing(pending).first().status == "processing"
    done = qu.process_queue(pending, outcomes, F.lit(NOW))
    assert [(r.status, r.attempts, r.delete_item) for r in done.collect()] == [("completed", 1, True)]
    assert [r.id for r in qu.apply_deletes(listings(spark, [{"id": 9}, {"id": 10}]), done).collect()] == [10]


def test_offsets_belong_to_a_source(spark):
    messages = spark.createDataFrame([("a", "c", 5), ("b", "c", 5)], "source_name string, chat_id string, message_id long")
    offsets = spark.createDataFrame([("a", "c", 5), ("b", "c", 1)], "source_name string, chat_id string, last_message_id long")
    assert [tuple(r) for r in tb.chat_messages_since(messages, offsets, 10).collect()] == [("b", "c", 5)]


def test_stored_keys_are_cut_before_they_are_aggregated(spark):
    stored, incoming = listings(spark, [{"id": 1, "url": "u"}]), listings(spark, [{"id": 1, "url": "u"}], "row_id")
    plan = mg.resolve_listing(incoming, stored)._jdf.queryExecution().optimizedPlan().toString()
    held = plan[plan.index("max(struct(o"):]
    assert "LeftSemi" in held
