"""Files, tables, merging and blocks on small fixtures, against brute force where there is one."""

import json
import random

import pytest
from pyspark.sql import functions as F

from listforge.operators import merge as mg
from listforge.sources import feeds as fe, mappings as mp, pages as pg, tables as tb


def test_json_feed_file(spark, tmp_path):
    feed = [{"legal": "terms"}, {"id": "7", "url": "https://f/7", "company": "Co", "position": "senior Python dev", "description": "<p>Full-time</p><p>3+ years</p>",
                                 "salary_min": 120000, "salary_max": 150000, "tags": ["x"], "apply_url": "https://a"}]
    (tmp_path / "good.json").write_text(json.dumps(feed, indent=1))
    (tmp_path / "bad.json").write_text("{oops")
    rows = mp.extract("json_feed_jobs", fe.read_json_feed(spark, str(tmp_path))).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.title, row.price, row.currency) == ("Senior Python dev", 120000.0, "USD")
    assert row.typed.salary_range == 120000.0 and row.typed.contract_type == "clt" and row.typed.experience_years == 3
    assert row.links == ["https://a"] and row.attributes["work_model"] == "remoto"


def test_rss_feed_file(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("""<rss><channel><item><title>Co: Backend Engineer</title><link>https://r/1</link><category>Programming</category>
        <region>Anywhere</region><description><![CDATA[<p>Pay $90k</p>]]></description></item>
        <item><title>Co: Nurse</title><link>https://r/2</link><category>Health</category></item></channel></rss>""")
    rows = mp.extract("rss_feed_jobs", fe.read_rss_feed(spark, str(tmp_path))).collect()
    assert [r.title for r in rows] == ["Backend Engineer"]
    assert rows[0].typed.salary_range == 90000.0 and rows[0].city == "Remote"


def test_paged_api_files(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps({"data": [{"numeroCompra": str(i)}, 5, "x", {"numeroCompra": f"{i}b"}], "totalPaginas": 2}))
    got = fe.read_paged_api(spark, str(tmp_path), "struct<numeroCompra:string>").collect()
    assert sorted(r[0] for r in got) == ["0", "0b", "1", "1b"]


def test_blocks_nested(spark):
    html = '<div class="a x"><div>one <b>two</b></div><script>no</script> three</div><div class="a">later</div><img id="i" src=" s.png ">'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = pg.page_blocks(df, [{"field": "box", "tag": "div", "class": "a"}, {"field": "pic", "id": "i", "attr": "src"}]).collect()
    assert {r.field: r.value for r in got} == {"box": "one two three", "pic": "s.png"}


def test_groups_equal_union_find(spark):
    rng = random.Random(3)
    pairs = [(row, f"k{rng.randrange(220)}") for row in range(300) for _ in range(rng.choice([1, 1, 2]))]
    pairs += [(1000 + i, "hot") for i in range(200)]                      # one key holds a large share of the rows
    pairs += [(2000 + i, f"c{j}") for i in range(64) for j in (i, i + 1)]   # one long chain
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for row, key in pairs:
        parent[find(row)] = find(key)
    groups = {}
    for row, _ in pairs:
        groups.setdefault(find(row), set()).add(row)
    expected = {row: min(rows) for rows in groups.values() if len(rows) > 1 for row in rows}
    got = mg.batch_groups(spark.createDataFrame(pairs, "row_id long, key string")).collect()
    assert {r.row_id: r.label for r in got} == expected


def listing_rows(spark, rows):
    base = {f: None for f in ("url", "title", "description", "price", "currency", "state", "city")}
    return spark.createDataFrame(
        [(r["row_id"], r.get("source_id", 1), *[{**base, **r}[f] for f in base], r.get("links", []), r.get("attributes", {})) for r in rows],
        "row_id long, source_id int, url string, title string, description string, price double, currency string, state string, city string, links array<string>, attributes map<string,string>")


def test_ingest_merges_and_is_replay_safe(spark, tmp_path):
    empty = spark.createDataFrame([], tb.LISTING_SCHEMA)
    now = F.lit("2024-01-01").cast("timestamp")
    first = listing_rows(spark, [
        {"row_id": 1, "url": "u1", "title": "A", "price": 10.0, "currency": "BRL", "links": ["https://x/1?a=1"], "attributes": {"company": "c"}},
        {"row_id": 2, "url": "u2", "title": "", "price": 0.0, "currency": "USD", "links": ["https://x/1/"], "attributes": {"salary_range": "5.000", "salary_type": "mensal"}},
        {"row_id": 3, "url": "u3", "title": "C", "attributes": {"dedupe_key": "k"}}])
    state = mg.ingest_batch(first, empty, now)
    tb.publish(state, str(tmp_path / "t"), "v0")
    rows = {r.url: r for r in tb.read_table(spark, str(tmp_path / "t"), tb.LISTING_SCHEMA).collect()}
    assert set(rows) == {"u1", "u3"} and sorted(r.id for r in rows.values()) == [1, 2]
    merged = rows["u1"]
    assert (merged.title, merged.price, merged.currency, merged.version) == ("A", 10.0, "USD", 2)
    assert merged.links == ["https://x/1?a=1", "https://x/1/"]
    assert merged.attributes == {"company": "c", "salary_range": "5000.0", "salary_type": "mensal"}
    second = listing_rows(spark, [{"row_id": 1, "url": "u9", "title": "C2", "attributes": {"dedupe_key": " k "}}, {"row_id": 2, "url": "u1", "price": 11.0}])
    for _ in range(2):  # a replay starts from the same version and writes the same one
        stored = spark.read.schema(tb.LISTING_SCHEMA).parquet(str(tmp_path / "t" / "v0"))
        tb.publish(mg.ingest_batch(second, stored, now), str(tmp_path / "t"), "v1")
        final = {r.url: r for r in tb.read_table(spark, str(tmp_path / "t"), tb.LISTING_SCHEMA).collect()}
        assert {u: r.version for u, r in final.items()} == {"u1": 3, "u3": 2}
        assert final["u3"].title == "C2" and final["u1"].price == 11.0 and final["u1"].title == "A"


def test_run_history_is_partitioned_by_day(spark, tmp_path):
    runs = spark.createDataFrame([(1, " Manual ", "2024-01-01 10:00:00"), (2, None, "2024-01-02 10:00:00")], "id long, trigger string, executed_at string")
    for _ in range(2):  # the same batch again replaces itself
        tb.append_run_history(runs.withColumn("executed_at", F.col("executed_at").cast("timestamp")), str(tmp_path / "h"), "b0")
    got = spark.read.parquet(str(tmp_path / "h"))
    assert {r.id: r.trigger for r in got.collect()} == {1: "manual", 2: "scheduled"}
    assert got.select("day").distinct().count() == 2 and got.count() == 2


def messages_stream(spark, folder, rows):
    spark.createDataFrame(rows, "chat_id string, message_id long").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema("chat_id string, message_id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_second_stream_goes_on_from_the_table(spark, tmp_path):
    """A stream with progress of its own starts from the table as it is, not from nothing."""
    from listforge.streaming import streams as st

    folder = str(tmp_path)
    st.stream_messages(messages_stream(spark, f"{folder}/a", [("c", 1), ("c", 5)]), "s", f"{folder}/out", f"{folder}/cp1").awaitTermination()
    st.stream_messages(messages_stream(spark, f"{folder}/b", [("c", 4), ("c", 6), ("d", 1)]), "s", f"{folder}/out", f"{folder}/cp2").awaitTermination()
    assert sorted((r.chat_id, r.message_id) for r in spark.read.parquet(f"{folder}/out/messages").collect()) == [("c", 1), ("c", 5), ("c", 6), ("d", 1)]
    assert {r.chat_id: r.last_message_id for r in tb.read_table(spark, f"{folder}/out/offsets", st.OFFSETS).collect()} == {"c": 6, "d": 1}


def test_replayed_batch_and_lost_version(spark, tmp_path):
    root, frame = str(tmp_path / "t"), lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    for owner, batch, ids in (("a", 0, (1,)), ("a", 1, (1, 2)), ("a", 1, (1, 2)), ("b", 0, (1, 2, 3))):
        before = sorted(r.id for r in tb.state_before(spark, root, "id long", owner, batch).collect())
        assert before == list(ids[:-1])
        tb.publish(frame(*ids), root, f"v-{owner}-{batch}", owner=owner, batch_id=batch)
    assert tb.pointer(spark, root)["before"] == "v-a-1" and not (tmp_path / "t" / "v-a-0").exists()
    import shutil

    shutil.move(str(tmp_path / "t" / "v-b-0"), str(tmp_path / "elsewhere"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tb.state_before(spark, root, "id long", "b", 1).collect()


def test_late_runs_are_counted(spark, tmp_path):
    from listforge.streaming import streams as st

    shape = "id long, executed_at timestamp, status string, success boolean, scraped_count int"
    rows = spark.createDataFrame([(1, "2024-01-31 10:00:00", "SUCCESS", True, 5), (2, "2024-01-02 10:00:00", "ERROR", False, 0), (3, "2024-01-31 12:00:00", "SUCCESS", True, 7)],
                                 shape.replace("timestamp", "string")).withColumn("executed_at", F.col("executed_at").cast("timestamp"))
    for i in (1, 3, 2):
        rows.where(F.col("id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    st.stream_run_rollup(stream, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    got = {str(r.start)[:10]: (r.runs, r.extracted, r.failures) for r in tb.read_table(spark, str(tmp_path / "table"), st.ROLLUP).collect()}
    assert got == {"2024-01-31": (2, 12, 0), "2024-01-02": (1, 0, 1)}


def test_first_seen_over_batches(spark, tmp_path):
    from listforge.streaming import streams as st

    stream = messages_stream(spark, str(tmp_path), [("c", 1), ("c", 2)])
    for rows in ([("c", 3), ("d", 1)], [("d", 2), ("e", 1)]):
        stream = messages_stream(spark, str(tmp_path), rows)
    st.stream_first_seen(stream, "chat_id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.chat_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["c", "d", "e"]


def test_filters_reach_the_scan(spark, tmp_path):
    from listforge.operators import listing_query as lq

    path = str(tmp_path / "listings")
    spark.createDataFrame([(1, "t", 5.0, "SP", "x")], "id long, title string, price double, state string, description string").write.parquet(path)
    kept = lq.filter_listings(spark.read.parquet(path), lq.ListingFilter(min_price=3.0)).select("id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(price,3.0)" in plan and "ReadSchema: struct<id:bigint,price:double>" in plan


def test_plans_avoid_pair_joins(spark):
    """Top-k replaces a full sort, and no plan holds a nested-loop or cartesian join."""
    import __spark_entry__ as entry

    queries = entry.queries()

    def plan(name):
        return queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

    assert "TakeOrderedAndProject" in plan("query_listings")
    for name in ("query_listings", "resolve_listing", "classify_rules_join", "enqueue_report", "schedule_expand", "match_by_any_link", "runs_by_day"):
        text = plan(name)
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_rows_are_dealt_over_tasks_by_number(spark, tmp_path):
    """One small file, which Spark reads in one task, is several tasks for the text queries; few rows stay as they are."""
    from listforge.plans.registry import Tables
    from listforge.sources import tables as tb

    spark.range(25_000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    t = Tables(spark, str(tmp_path))
    sizes = [n for n in t.dealt("part").rdd.glom().map(len).collect()]
    assert len(sizes) == 3 and sum(sizes) == 25_000 and max(sizes) <= tb.ROWS_PER_TASK
    assert t.dealt("part").distinct().count() == 25_000
    assert "Exchange" not in tb.dealt(t.part.limit(5))._jdf.queryExecution().optimizedPlan().toString()
    assert tb.dealt(t.part.where("p_partkey < 5")).count() == 5
