"""Running values, patches decided at once, the listing store, and streams that keep state, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listforge.operators import listing_store as ls, merge as mg, queue as qu
from listforge.operators.scan import running
from listforge.sources import deltas as de, tables as tb
from listforge.streaming import streams as st
from test_merge import NOW, listings


# --- running values --------------------------------------------------------------------------
@pytest.mark.parametrize("keys", [["k"], ["k", "j"]])
def test_running_values_equal_a_loop(spark, keys):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(2), n, rng.choice([None, None, n]), rng.randrange(3)) for n in range(3000)]
    df = spark.createDataFrame(rows, "k string, j int, n long, v long, w int").repartition(6)
    got = {r.n: (r.newest, r.sum) for r in running(df, keys, ["n"], last={"newest": F.col("v")}, total={"sum": F.col("w")}).collect()}
    newest, total = {}, {}
    for k, j, n, v, w in rows:
        key = (k, j)[:len(keys)]
        newest[key] = n if v is not None else newest.get(key)
        total[key] = total.get(key, 0) + w
        assert got[n] == (newest[key], total[key])
    down = running(df, ["k"], [F.col("n").desc()], total={"left": F.lit(1)})
    assert {r.n: r.left for r in down.collect()} == {n: sum(1 for x in rows[n:] if x[0] == k) for k, _, n, _, _ in rows}


# --- patches ---------------------------------------------------------------------------------
def patched_in_turn(stored, patches, now):
    """Outcome of every patch, applied one by one."""
    state = {r["id"]: dict(r) for r in stored}
    out = []
    for p in patches:
        held = state.get(p["id"])
        if held is None:
            status = "missing"
        elif p["expected_version"] is not None and (held["version"] or 0) != p["expected_version"]:
            status = "conflict_version"
        elif p["submitted_at"] is not None and held["updated_at"] > p["submitted_at"]:
            status = "conflict_time"
        elif not {"title", "city"} & set(p["fields"]):
            status = "invalid"
        else:
            status = "applied"
            for f in {"title", "city"} & set(p["fields"]):
                held[f] = p[f"new_{f}"]
            held |= {"version": (held["version"] or 0) + 1, "updated_at": now}
        held = held or {}
        out.append((p["id"], held.get("version"), held.get("title"), held.get("city"), held.get("updated_at"), status))
    return out


@pytest.mark.parametrize("seed, now", [(1, datetime(2024, 1, 5)), (2, datetime(2024, 1, 5)), (3, datetime(2024, 1, 1)), (4, datetime(2023, 12, 1))])
def test_patches_equal_one_after_another(spark, seed, now):
    rng = random.Random(seed)
    stored = [{"id": i, "url": f"u{i}", "title": f"t{i}", "version": rng.choice([None, 1, 3]), "updated_at": datetime(2024, 1, rng.randint(1, 3))} for i in range(12)]
    patches = []
    for n in range(600):
        one = rng.choice([0] * 8 + list(range(14)))
        patches.append({"id": one, "expected_version": rng.choice([None, 0, 1, 2, 3, 4, 5, rng.randrange(40)]) if rng.random() < 0.8 else None,
                        "submitted_at": datetime(2023, 12, 30) + timedelta(minutes=20 * n), "fields": rng.choice([["title"], ["title", "city"], ["id"], ["city", "nope"]]),
                        "new_title": rng.choice([f"n{n}", None]), "new_city": f"c{n}"})
    shape = "id long, expected_version int, submitted_at timestamp, fields array<string>, new_title string, new_city string"
    table = spark.createDataFrame([tuple(p.values()) for p in patches], shape).repartition(4)
    done = mg.patch_listing(listings(spark, stored), table, F.lit(now))
    got = sorted(((r.id, r.version, r.title, r.city, r.updated_at, r.status) for r in done.collect()), key=str)
    assert got == sorted(patched_in_turn(stored, patches, now), key=str)


def test_a_long_chain_of_patches_takes_few_jobs(spark):
    """Three hundred patches of one listing, each for the version the one before it left."""
    rows = [(1, v, datetime(2024, 1, 2) + timedelta(minutes=v), ["title"], f"n{v}") for v in range(1, 301)]
    patches = spark.createDataFrame(rows, "id long, expected_version int, submitted_at timestamp, fields array<string>, new_title string").repartition(4)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = mg.patch_listing(listings(spark, [{"id": 1, "url": "u", "version": 1}]), patches, F.lit(datetime(2024, 1, 1))).collect()
        jobs = len(tracker.getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r.version, r.title, r.status) for r in got) == sorted((v + 1, f"n{v}", "applied") for v in range(1, 301))
    assert jobs < 300


def test_a_hot_id_is_replaced_in_order(spark):
    rows = spark.createDataFrame([(1, n, f"t{n}") for n in range(500)] + [(2, 1, "x"), (None, 1, "y")], "id long, row_id long, title string").repartition(5)
    got = mg.replace_listing(rows, listings(spark, [{"id": 1, "url": "u", "version": 7}])).collect()
    assert sorted((r.row_id, r.version, r.status) for r in got if r.id == 1) == [(n, 8 + n, "replaced" if n == 499 else "superseded") for n in range(500)]
    assert sorted(r.status for r in got if r.id != 1) == ["missing", "missing"]


# --- delta parts -----------------------------------------------------------------------------
SHAPE = de.Shape("rows", "id long, v string", ("id",), ("id",))


def rows_in(spark, folder):
    return spark.read.parquet(folder).count()


def step(spark, root, version, rows, batch, gone=()):
    state = de.start(spark, root, "s", batch)
    frame = spark.createDataFrame([(i, v, i in gone) for i, v in rows.items()], "id long, v string, __gone boolean").checkpoint()
    return de.publish(spark, root, version, state, {"rows": de.change(frame, root, SHAPE, version, state)}, {}, "s", batch)


def test_small_changes_are_small_deltas(spark, tmp_path):
    root = str(tmp_path / "t")
    held = {i: "a" for i in range(10_000)}
    frame = spark.createDataFrame(list(held.items()), "id long, v string")
    de.publish(spark, root, "s0", de.start(spark, root), {"rows": de.seed(frame, root, SHAPE, "s0", 500)}, {})
    assert de.start(spark, root)["tables"]["rows"]["n"] == 20
    change = {i: "b" for i in range(0, 10_000, 50)}
    step(spark, root, "v0", change, 0)
    held |= change
    assert rows_in(spark, f"{root}/rows/v0/delta") == 200 and not (tmp_path / "t" / "rows" / "v0" / "base").exists()
    for _ in range(2):  # the second time is a replay
        step(spark, root, "v1", {3: "c", 10_001: "n", 50: "x"}, 1, gone=(50,))
        got = {r.id: r.v for r in de.read(spark, root, de.start(spark, root), SHAPE).collect()}
        assert got == {**{k: v for k, v in held.items() if k != 50}, 3: "c", 10_001: "n"}
    held = got
    change = {i: "d" for i in range(1, 10_000, 3)}
    new = step(spark, root, "v2", change, 2)
    held |= change
    parts = new["tables"]["rows"]["parts"].values()
    assert all(p["deltas"] == [] and p["changed"] == 0 and p["base"] == "v2" for p in parts) and sum(p["rows"] for p in parts) == len(held)
    step(spark, root, "v3", {7: "e"}, 3)
    assert {r.id: r.v for r in de.read(spark, root, de.start(spark, root), SHAPE).collect()} == held | {7: "e"}
    assert {f.name for f in (tmp_path / "t" / "rows").iterdir() if any(f.iterdir())} == {"v2", "v3"}


def test_an_empty_store_grows(spark, tmp_path):
    root = str(tmp_path / "t")
    de.publish(spark, root, "s0", de.start(spark, root), {"rows": de.seed(spark.createDataFrame([], SHAPE.schema), root, SHAPE, "s0")}, {})
    step(spark, root, "v0", {1: "a"}, 0)
    step(spark, root, "v1", {}, 1)
    assert [tuple(r) for r in de.read(spark, root, de.start(spark, root), SHAPE).collect()] == [(1, "a")]


def test_small_parts_share_files(spark, tmp_path):
    """Two hundred parts are a file or two, of the table and of a batch; parts that a batch wrote anew hide their old rows."""
    root, files = str(tmp_path / "t"), lambda folder: len(list((tmp_path / "t" / "rows" / folder).rglob("*.parquet")))
    held = {i: "a" for i in range(4000)}
    de.publish(spark, root, "s0", de.start(spark, root), {"rows": de.seed(spark.createDataFrame(list(held.items()), "id long, v string"), root, SHAPE, "s0", 20)}, {})
    assert de.start(spark, root)["tables"]["rows"]["n"] == 200 and files("s0/base") <= 2
    for n, change in enumerate(({i: "b" for i in range(0, 4000, 40)}, {i: "c" for i in range(1, 900, 3)}, {5000: "d", 3: "e"})):
        held |= change
        new = step(spark, root, f"v{n}", change, n)["tables"]["rows"]["parts"]
        assert files(f"v{n}") <= 4 and {r.id: r.v for r in de.read(spark, root, de.start(spark, root), SHAPE).collect()} == held
    assert len({p["base"] for p in new.values()}) > 1
    some = {0, 7, 150}
    part = de.read(spark, root, de.start(spark, root), SHAPE, some).withColumn("p", SHAPE.part(de.start(spark, root)))
    assert {r.p for r in part.collect()} == some and part.count() < 200


# --- listing store ---------------------------------------------------------------------------
def plain(rows):
    return sorted((r.id, r.url, r.title, r.version, tuple(sorted(r.links or [])), tuple(sorted((r.attributes or {}).items()))) for r in rows)


def test_store_equals_the_whole_table(spark, tmp_path):
    """Random batches give the same listings through the index as through all keys of the table."""
    rng = random.Random(11)
    link = lambda: f"https://site.example/{rng.randrange(60)}"
    make = lambda i: {"id": i, "url": rng.choice([f"u{rng.randrange(80)}", None, ""]), "links": [link() for _ in range(rng.randrange(3))], "title": f"t{i}",
                      "source_id": rng.choice([1, 1, 2]), "attributes": rng.choice([{}, {"dedupe_key": f"k{rng.randrange(40)}"}])}
    first = [{**make(i), "url": f"u{i}"} for i in range(1, 60)]
    batches = [[make(i) for i in range(n)] for n in (25, 1, 40)]
    root, schema = str(tmp_path / "t"), ", ".join(f"{n} {k}" for n, k in listings(spark, []).dtypes)
    whole = listings(spark, first)
    ls.create(whole, root, schema, 10)
    for n, rows in enumerate(batches):
        incoming = listings(spark, rows, "row_id")
        whole = mg.ingest_batch(incoming, whole, F.lit(NOW)).checkpoint()
        for _ in range(2 if n == 1 else 1):  # one batch is replayed
            ls.ingest(incoming, root, F.lit(NOW), f"v{n}", schema, owner="s", batch_id=n)
        assert plain(ls.read_listings(spark, root, schema).collect()) == plain(whole.collect())
    state = de.start(spark, root)
    held = mg.stored_keys(whole)
    index = de.read(spark, root, state, ls.KEYS)
    key = lambda df: sorted({(r.rank, r.scope, r.key, r.id) for r in df.collect()})
    assert key(index) == key(held)
    ls.remove(spark.createDataFrame([(3,), (4,), (99_999,)], "id long"), root, "v9", schema)
    assert plain(ls.read_listings(spark, root, schema).collect()) == plain(whole.where("id not in (3, 4)").collect())
    assert key(de.read(spark, root, de.start(spark, root), ls.KEYS)) == key(held.where("id not in (3, 4)"))


def test_a_small_batch_reads_and_writes_little(spark, tmp_path):
    root, schema = str(tmp_path / "t"), ", ".join(f"{n} {k}" for n, k in listings(spark, []).dtypes)
    many = listings(spark, [{"id": 0, "url": "x"}]).drop("id", "url").crossJoin(spark.range(1, 8001).select("id", F.concat(F.lit("u"), "id").alias("url"))).select(*listings(spark, []).columns)
    ls.create(many, root, schema, 50)
    report = ls.ingest(listings(spark, [{"id": i, "url": f"u{i * 70}", "title": "n"} for i in range(1, 21)], "row_id"), root, F.lit(NOW), "v0", schema)
    assert report["keys"][1] == 160 and report["keys"][0] <= 20 and report["rows"][1] == 160 and report["rows"][0] <= 20
    state = de.start(spark, root)
    read = de.read(spark, root, state, de.Shape("rows", schema, ("id",), ("id",)), set(range(report["rows"][0])))
    assert read.count() < 8000 * 0.2
    assert rows_in(spark, f"{root}/rows/v0") <= 20 * 60 and ls.read_listings(spark, root, schema).where("title = 'n' and version = 2").count() == 20


# --- streams ---------------------------------------------------------------------------------
def staged(spark, folder, frames):
    for n, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in/{n:03d}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_repeated_messages_are_delivered_once(spark, tmp_path):
    shape = "chat_id string, message_id long, text string"
    frames = [spark.createDataFrame(r, shape) for r in ([("c", 1, "b"), ("c", 1, "a"), ("c", 2, "x"), ("d", 1, None)], [("c", 2, "y"), ("c", 3, "z"), ("c", 3, "z")], [("c", 1, "a"), ("d", 1, "late")])]
    stream = staged(spark, str(tmp_path), frames)
    st.stream_messages(stream, "s", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "messages")).collect()
    assert sorted((r.chat_id, r.message_id, r.text or "") for r in got) == [("c", 1, "a"), ("c", 2, "x"), ("c", 3, "z"), ("d", 1, "")]


def test_state_of_the_dedup_is_dropped(spark, tmp_path):
    """Keys of five batches three days apart, a delay of two days: old state goes, late rows are counted."""
    frames = [spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(days=3 * n)) for k in range(20 * n, 20 * n + 20)], "k long, at timestamp") for n in range(5)]
    frames.append(spark.createDataFrame([(0, datetime(2024, 1, 20)), (500, datetime(2024, 1, 1))], "k long, at timestamp"))
    stream = st.stream_dedup(staged(spark, str(tmp_path), frames), "k", "at", "2 days")
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.k, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("k").count().collect())
    assert got == [(0, 2)] + [(k, 1) for k in range(1, 100)]
    last = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert max(p["numRowsTotal"] for p in last) <= 60 and sum(p["numRowsDroppedByWatermark"] for p in last) == 1


def test_a_tick_that_dies_leaves_claims(spark, tmp_path):
    root, now = str(tmp_path / "q"), datetime(2024, 1, 31, 12)
    rows = [(i, "src", f"https://x/{i}", "queued" if i < 4 else "completed", i, 0) for i in range(1, 7)]
    st.create_queue(spark.createDataFrame(rows, "id long, source_name string, url string, status string, item_id long, attempts int"), root, 2)
    outcome = "id long, found boolean, chat_missing boolean, status_code int, blocked boolean, fetch_error string, raised string"
    outcomes = spark.createDataFrame([(1, True, False, 200, False, None, None), (2, False, False, 404, False, None, None), (5, True, False, 200, False, None, None)], outcome)
    status = lambda: {r.id: (r.status, r.attempts) for r in st.read_queue(spark, root).collect()}
    for _ in range(2):  # a replayed claim starts from the state before it
        claimed = st.claim_rows(outcomes, root, "a", 0, F.lit(now))
        assert status() == {1: ("processing", 1), 2: ("processing", 1), 3: ("queued", 0), 4: ("completed", 0), 5: ("completed", 0), 6: ("completed", 0)}
    assert st.claim_rows(outcomes, root, "b", 0, F.lit(now + timedelta(minutes=5))) is None
    later = F.lit(now + timedelta(hours=2))
    taken = st.claim_rows(outcomes, root, "b", 1, later)
    assert {r.id: r.attempts for r in taken.collect()} == {1: 2, 2: 2}
    for _ in range(2):
        st.finish_rows(taken, outcomes, root, "b", 1, later)
    assert status() == {1: ("completed", 2), 2: ("completed", 2), 3: ("queued", 0), 4: ("completed", 0), 5: ("completed", 0), 6: ("completed", 0)}
    assert st.claim_rows(outcomes, root, "b", 1, later) is None
    done = st.read_queue(spark, root)
    assert [r.id for r in qu.apply_deletes(listings(spark, [{"id": 1}, {"id": 2}]), done).collect()] == [1]


def test_days_follow_the_zone(spark):
    """The zone was two hours behind UTC in the summer of 2018 and is three hours behind since 2019."""
    times = ["2018-01-15 01:30:00", "2018-01-15 02:30:00", "2024-01-15 02:30:00", "2018-11-04 02:30:00", "2018-11-04 03:30:00"]
    runs = spark.createDataFrame([(i, t, "SUCCESS", True, 1) for i, t in enumerate(times)], "id long, executed_at string, status string, success boolean, scraped_count int")
    runs = runs.withColumn("executed_at", F.col("executed_at").cast("timestamp"))
    got = {(str(r.start), str(r.end)): r.runs for r in st.run_windows(runs).collect()}
    assert got == {("2018-01-14 02:00:00", "2018-01-15 02:00:00"): 1, ("2018-01-15 02:00:00", "2018-01-16 02:00:00"): 1, ("2024-01-14 03:00:00", "2024-01-15 03:00:00"): 1,
                   ("2018-11-03 03:00:00", "2018-11-04 03:00:00"): 1, ("2018-11-04 03:00:00", "2018-11-05 02:00:00"): 1}


# --- large batches ---------------------------------------------------------------------------
def test_a_batch_of_one_file_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """The rows of a batch that arrives as one task are cleaned in tasks of a bounded number of rows; their keys are the same."""
    monkeypatch.setattr(mg, "ROWS_PER_TASK", 50)
    rows = listings(spark, [{"row_id": i, "id": i, "url": f"u{i}", "source_id": 1, "links": [f"https://x.example/{i % 90}"], "attributes": {"dedupe_key": f" k{i}"}} for i in range(220)]).coalesce(1)
    ready = mg.ready_batch(rows.withColumn("row_id", F.col("id")))
    assert ready.rdd.getNumPartitions() == 5 and max(len(p) for p in ready.select("row_id").rdd.glom().collect()) <= 60
    assert {(r.row_id, r.rank, r.scope, r.key) for r in mg.asked_keys(ready).collect()} == {
        k for i in range(220) for k in ((i, 1, -1, f"u{i}"), (i, 2, 1, f"https://x.example/{i % 90}"), (i, 3, 1, f"k{i}"))}


def test_keys_leave_out_what_names_nothing(spark):
    rows = listings(spark, [{"id": 1, "url": None, "source_id": 1, "links": [" a ", "a", "", None], "attributes": {"dedupe_key": "  "}},
                            {"id": 2, "url": "u", "source_id": None, "links": ["b"], "attributes": {"dedupe_key": "k"}},
                            {"id": 3, "url": "", "source_id": 0, "links": None, "attributes": None}, {"id": 4, "url": "v", "source_id": 5, "links": ["c", "d"], "attributes": {"dedupe_key": " k "}}])
    got = sorted((r.id, r.rank, r.scope, r.key) for r in mg.stored_keys(rows).collect())
    assert got == [(1, 2, 1, "a"), (2, 1, -1, "u"), (4, 1, -1, "v"), (4, 2, 5, "c"), (4, 2, 5, "d"), (4, 3, 5, "k")]


def test_queue_batches_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """A batch of one file goes to claims and outcomes in tasks of a bounded number of rows."""
    monkeypatch.setattr(st, "ROWS_PER_TASK", 100)
    root, held = str(tmp_path / "q"), [(i, "s", f"u{i}", "queued", i, 0) for i in range(500)]
    st.create_queue(spark.createDataFrame(held, "id long, source_name string, url string, status string, item_id long, attempts int"), root)
    shape = "id long, found boolean, chat_missing boolean, status_code int, blocked boolean, fetch_error string, raised string"
    spark.createDataFrame([(i, i % 2 == 0, False, 200, False, None, None) for i in range(450)], shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen, claim = [], st.claim_rows
    monkeypatch.setattr(st, "claim_rows", lambda ids, *a, **k: (seen.append(ids.rdd.getNumPartitions()), claim(ids, *a, **k))[1])
    st.stream_queue(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), root, str(tmp_path / "cp"), F.lit(datetime(2024, 1, 1))).awaitTermination()
    assert seen == [5]
    assert {r.id: (r.status, r.attempts) for r in st.read_queue(spark, root).collect()} == {
        i: ("completed" if i % 2 == 0 else "error", 1) if i < 450 else ("queued", 0) for i in range(500)}
