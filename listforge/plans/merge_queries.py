"""Matching, folding, merging, patching and deleting listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listforge.functions import attributes as at, urls
from listforge.operators import listing_store as ls, merge as mg
from listforge.plans.registry import NOW, query
from listforge.session import scratch_folder
from listforge.sources import tables as tb

SI = ("stored_v", "incoming_v")


ROWS_PER_TASK = 100_000


def stored_listings(t) -> DataFrame:
    df = t.dealt("stored_v", ROWS_PER_TASK)
    extra = {"location": "struct<latitude:double,longitude:double>", "images": "array<string>", "videos": "array<string>", "documents": "array<string>",
             "zip_code": "string", "street": "string", "contact_name": "string", "contact_phone": "string", "contact_email": "string"}
    return df.select("*", F.array("link").alias("links"), F.expr("map('dedupe_key', dedupe_key, 'company', 'old', 'seniority', 'pleno')").alias("attributes"),
                     F.col("updated_at").alias("created_at"), *[F.lit(None).cast(k).alias(n) for n, k in extra.items()]).drop("link", "dedupe_key")


def incoming_listings(t) -> DataFrame:
    return t.incoming_v.select("*", F.array("link").alias("links"), F.expr("map('dedupe_key', dedupe_key, 'company', 'new', 'salary_range', '5000', 'salary_type', 'mensal')").alias("attributes")).drop("link", "dedupe_key")


@query("match_by_url", "SELECT i.row_id, s.id AS match_id FROM incoming_v i LEFT JOIN stored_v s USING (url)", SI)
def match_by_url(t):
    return mg.match_by_url(t.incoming_v, t.stored_v).select("row_id", "match_id")


LINK = "regexp_replace(regexp_replace(trim(i.link), '[?#].*$', ''), '/+$', '')"


@query("match_by_any_link", f"SELECT i.row_id, arg_max(s.id, (s.updated_at, -s.id)) AS match_id FROM incoming_v i JOIN stored_v s ON s.source_id = i.source_id AND s.link = {LINK} GROUP BY 1", SI)
def match_by_any_link(t):
    return mg.match_by_any_link(incoming_listings(t), stored_listings(t))


@query("match_by_attribute", "SELECT i.row_id, arg_max(s.id, (s.updated_at, -s.id)) AS match_id FROM incoming_v i JOIN stored_v s ON s.source_id = i.source_id AND s.dedupe_key = trim(i.dedupe_key) GROUP BY 1", SI)
def match_by_attribute(t):
    return mg.match_by_attribute(incoming_listings(t), stored_listings(t))


@query("match_by_hot_attribute", """SELECT i.row_id, m.id AS match_id FROM incoming_v i JOIN (SELECT source_id, price > 250000 AS big, arg_max(id, (updated_at, -id)) AS id FROM stored_v GROUP BY 1, 2) m
ON m.source_id = i.source_id AND m.big = (i.price > 250000)""", SI)
def match_by_hot_attribute(t):
    """Fourteen keys for the whole table: every key is hot on both sides."""
    stored = stored_listings(t).withColumn("attributes", F.expr("map('dedupe_key', cast(price > 250000 as string))"))
    incoming = incoming_listings(t).withColumn("attributes", F.expr("map('dedupe_key', cast(price > 250000 as string))"))
    return mg.match_by_attribute(incoming, stored)


RESOLVED = f"""u AS (SELECT i.row_id, s.id FROM incoming_v i JOIN stored_v s USING (url)),
l AS (SELECT i.row_id, arg_max(s.id, (s.updated_at, -s.id)) AS id FROM incoming_v i JOIN stored_v s ON s.source_id = i.source_id AND s.link = {LINK} GROUP BY 1),
k AS (SELECT i.row_id, arg_max(s.id, (s.updated_at, -s.id)) AS id FROM incoming_v i JOIN stored_v s ON s.source_id = i.source_id AND s.dedupe_key = trim(i.dedupe_key) GROUP BY 1),
res AS (SELECT i.row_id, coalesce(u.id, l.id, k.id) AS match_id FROM incoming_v i LEFT JOIN u USING (row_id) LEFT JOIN l USING (row_id) LEFT JOIN k USING (row_id))"""


@query("resolve_listing", f"WITH {RESOLVED} SELECT row_id, match_id FROM res WHERE match_id IS NOT NULL", SI)
def resolve_listing(t):
    return mg.resolve_listing(incoming_listings(t), stored_listings(t))


@query("intersect_links", f"SELECT i.row_id, i.row_id % 4 = 1 AS v FROM incoming_v i", SI)
def intersect_links(t):
    stored = t.stored_v.select((F.col("id") - 1).alias("row_id"), F.array("link").alias("held"))
    asked = incoming_listings(t).select("row_id", urls.external_links(F.col("links")).alias("asked"))
    return asked.join(stored, "row_id").select("row_id", F.arrays_overlap("asked", "held").alias("v"))


@query("union_links", "SELECT row_id, CASE WHEN row_id % 4 = 1 THEN link || '|z' ELSE 'https://ext.example/' || row_id || '|' || link || '|z' END AS v FROM incoming_v WHERE row_id % 4 <> 1 UNION ALL SELECT row_id, 'https://ext.example/' || row_id || '|' || link || '|z' FROM incoming_v WHERE row_id % 4 = 1", SI)
def union_links(t):
    stored = t.stored_v.select((F.col("id") - 1).alias("row_id"), F.array("link").alias("old"))
    new = t.incoming_v.select("row_id", F.array("link", F.lit("z"), F.concat(F.lit("https://ext.example/"), "row_id")).alias("new"))
    return new.join(stored, "row_id").select("row_id", F.array_join(F.array_union("old", "new"), "|").alias("v"))


@query("union_features", "SELECT p_partkey, p_name || '|' || p_type AS v FROM part")
def union_features(t):
    return t.part.select("p_partkey", F.array_join(F.array_union(F.array("p_name"), F.array("p_type", "p_name", "p_type")), "|").alias("v"))


@query("merge_attributes", """SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'old' END AS company, 'x' AS extra, CASE WHEN id % 3 = 0 THEN NULL ELSE 1500.0 END AS salary,
CASE WHEN id % 3 = 0 THEN NULL ELSE 'mensal' END AS kind FROM stored_v""", ("stored_v",))
def merge_attributes(t):
    old = F.expr("map('company', 'old', 'salary_range', '900', 'salary_type', 'anual')")
    new = F.expr("""map_concat(CASE WHEN id % 2 = 0 THEN map('company', 'new') ELSE map() END, map('extra', 'x', 'salary_type', 'Mensal', 'salary_range', CASE WHEN id % 3 = 0 THEN 'n/d' ELSE 'R$ 1.500,00' END))""")
    m = t.stored_v.select("id", at.merge_attributes(old, new).alias("m"))
    return m.select("id", F.col("m")["company"].alias("company"), F.col("m")["extra"].alias("extra"),
                    F.try_element_at("m", F.lit("salary_range")).cast("double").alias("salary"), F.try_element_at("m", F.lit("salary_type")).alias("kind"))


# --- fold: many rows per key -----------------------------------------------------------------
FOLD = """SELECT o_custkey AS target, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 > 0) AS title, arg_max(o_totalprice, o_orderkey) FILTER (o_orderkey % 4 > 0) AS price,
arg_max(o_orderstatus, o_orderkey) AS currency, count(*) AS merged_rows FROM orders GROUP BY 1"""


@query("fold_merge", FOLD)
def fold_merge(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("row_id"), F.lit(None).cast("long").alias("match_id"), F.lit(1).alias("source_id"),
        F.lit("u").alias("url"), F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END").alias("title"),
        F.expr("CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice ELSE 0.0D END").alias("price"), F.col("o_orderstatus").alias("currency"),
        F.array("o_orderpriority").alias("links"), F.expr("map('k', o_orderstatus)").alias("attributes"))
    return mg.fold_merge(rows).select("target", "title", "price", "currency", "merged_rows")


@query("fold_links", """SELECT o_custkey AS target, (SELECT string_agg(p, '|' ORDER BY k) FROM (SELECT o_orderpriority AS p, min(o_orderkey) AS k FROM orders x WHERE x.o_custkey = c.o_custkey GROUP BY 1)) AS links,
arg_max(o_orderstatus, o_orderkey) AS status FROM orders c GROUP BY 1""")
def fold_links(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("row_id"), F.lit(None).cast("long").alias("match_id"), F.lit(1).alias("source_id"),
        F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit("BRL").alias("currency"), F.array("o_orderpriority").alias("links"),
        F.expr("map('k', o_orderstatus)").alias("attributes"))
    return mg.fold_merge(rows).select("target", F.array_join("links", "|").alias("links"), F.col("attributes")["k"].alias("status"))


MERGED = f"""WITH {RESOLVED} SELECT s.id, s.url, coalesce(nullif(i.title, ''), s.title) AS title, coalesce(i.description, s.description) AS description,
coalesce(nullif(i.price, 0), s.price) AS price, i.currency, i.state, coalesce(nullif(i.city, ''), s.city) AS city,
CASE WHEN s.link = i.link THEN s.link ELSE s.link || '|' || i.link END AS links, trim(i.dedupe_key) AS dedupe_key, 'new' AS company, 'pleno' AS seniority, s.version + 1 AS version
FROM res r JOIN incoming_v i USING (row_id) JOIN stored_v s ON s.id = r.match_id"""


def _flat(df: DataFrame) -> DataFrame:
    a = F.col("attributes")
    return df.select("id", "url", "title", "description", "price", "currency", "state", "city", F.array_join("links", "|").alias("links"),
                     F.trim(F.try_element_at(a, F.lit("dedupe_key"))).alias("dedupe_key"), F.try_element_at(a, F.lit("company")).alias("company"),
                     F.try_element_at(a, F.lit("seniority")).alias("seniority"), "version")


@query("merge_listing", MERGED, SI)
def merge_listing(t):
    incoming, stored = incoming_listings(t), stored_listings(t)
    matched = incoming.join(mg.resolve_listing(incoming, stored), "row_id").withColumn("target", F.col("match_id").cast("string"))
    return _flat(mg.merge_listing(stored, mg.fold_merge(matched)))


INGESTED = f"""WITH {RESOLVED}, m AS (SELECT s.id, s.url, coalesce(nullif(i.title, ''), s.title) AS title, coalesce(nullif(i.price, 0), s.price) AS price, i.currency, s.version + 1 AS version
FROM res r JOIN incoming_v i USING (row_id) JOIN stored_v s ON s.id = r.match_id),
n AS (SELECT NULL AS id, i.url, nullif(i.title, '') AS title, nullif(i.price, 0) AS price, i.currency, 1 AS version FROM res r JOIN incoming_v i USING (row_id) WHERE r.match_id IS NULL),
o AS (SELECT id, url, title, price, currency, version FROM stored_v WHERE id NOT IN (SELECT id FROM m))
SELECT url, title, price, currency, version FROM (SELECT * FROM m UNION ALL SELECT * FROM n UNION ALL SELECT * FROM o)"""


@query("ingest_batch", INGESTED, SI)
def ingest_batch(t):
    state = mg.ingest_batch(incoming_listings(t), stored_listings(t), F.lit(NOW))
    return state.select("url", "title", "price", "currency", "version")


@query("ingest_in_batches", INGESTED, SI)
def ingest_in_batches(t):
    """The same rows in four batches in order of arrival give the same table as in one."""
    state, incoming = stored_listings(t), incoming_listings(t)
    for k in range(4):
        state = mg.ingest_batch(incoming.where(F.col("row_id") % 4 == k), state, F.lit(NOW)).checkpoint()
    return state.select("url", "title", "price", "currency", "version")


@query("ingest_indexed", INGESTED, SI)
def ingest_indexed(t):
    """A listing store takes half of the rows, then one in a hundred, then the rest, each batch in parts of its own size."""
    stored, incoming, root = stored_listings(t), incoming_listings(t), scratch_folder(t.spark, "store")
    schema = ", ".join(f"{n} {k}" for n, k in stored.dtypes)
    ls.create(stored, root, schema, 2000)
    for k, cut in enumerate(("row_id % 100 < 50", "row_id % 100 = 50", "row_id % 100 > 50")):
        ls.ingest(incoming.where(cut), root, F.lit(NOW), f"v{k}", schema)
    return ls.read_listings(t.spark, root, schema).select("url", "title", "price", "currency", "version")


@query("upsert_listings", f"""WITH {RESOLVED} SELECT (SELECT count(*) FROM stored_v) + (SELECT count(*) FROM res WHERE match_id IS NULL) AS n,
(SELECT max(id) FROM stored_v) + (SELECT count(*) FROM res WHERE match_id IS NULL) AS max_id, (SELECT count(*) FROM stored_v) + (SELECT count(*) FROM res WHERE match_id IS NULL) AS ids""", SI)
def upsert_listings(t):
    state = mg.ingest_batch(incoming_listings(t), stored_listings(t), F.lit(NOW))
    return state.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("max_id"), F.countDistinct("id").alias("ids"))


# Rows of a batch that hang together through shared keys: one key per customer and one per pair
# of neighbouring customers, so components are chains of customers ten long.
@query("batch_groups", """SELECT o_orderkey AS row_id, min(o_orderkey) OVER (PARTITION BY o_custkey // 10) AS label FROM orders
QUALIFY count(*) OVER (PARTITION BY o_custkey // 10) > 1""")
def batch_groups(t):
    keys = t.orders.select(F.col("o_orderkey").alias("row_id"), F.explode(F.expr("""
        CASE WHEN o_custkey % 10 = 9 THEN array(concat('c', o_custkey)) ELSE array(concat('c', o_custkey), concat('c', o_custkey + 1)) END""")).alias("key"))
    # an order also carries the key of the next customer of its ten, which links the ten into one chain
    return mg.batch_groups(keys)


# --- single-row writes -----------------------------------------------------------------------
@query("create_listing", "SELECT row_id, url FROM incoming_v WHERE url NOT IN (SELECT url FROM stored_v)", SI)
def create_listing(t):
    return mg.create_listing(t.incoming_v, t.stored_v).select("row_id", "url")


@query("create_rejects", "SELECT row_id, url FROM incoming_v WHERE url IN (SELECT url FROM stored_v)", SI)
def create_rejects(t):
    return mg.create_rejects(t.incoming_v, t.stored_v).select("row_id", "url")


@query("replace_listing", """SELECT i.row_id * 2 AS id, i.title, CASE WHEN s.id IS NOT NULL THEN s.version + 1 END AS version, CASE WHEN s.id IS NOT NULL THEN 'replaced' ELSE 'missing' END AS status
FROM incoming_v i LEFT JOIN stored_v s ON s.id = i.row_id * 2""", SI)
def replace_listing(t):
    new = t.incoming_v.select((F.col("row_id") * 2).alias("id"), "title")
    return mg.replace_listing(new, t.stored_v).select("id", "title", "version", "status")


PATCH = """p AS (SELECT row_id * 2 AS id, CASE WHEN row_id % 5 = 0 THEN 9 WHEN row_id % 5 < 3 THEN 1 END AS expected, CASE WHEN row_id % 3 = 0 THEN TIMESTAMP '1998-01-01' END AS submitted,
row_id % 7 = 0 AS bad, title FROM incoming_v), x AS (SELECT p.*, s.id AS sid, s.version, s.updated_at, s.title AS old_title, s.city, CASE WHEN s.id IS NULL THEN 'missing' WHEN coalesce(s.version <> p.expected, FALSE) THEN 'conflict_version'
WHEN coalesce(s.updated_at > p.submitted, FALSE) THEN 'conflict_time' WHEN bad THEN 'invalid' ELSE 'applied' END AS status FROM p LEFT JOIN stored_v s ON s.id = p.id)"""


def _patches(t):
    return t.incoming_v.select(
        (F.col("row_id") * 2).alias("id"), F.expr("CASE WHEN row_id % 5 = 0 THEN 9 WHEN row_id % 5 < 3 THEN 1 END").alias("expected_version"),
        F.expr("CASE WHEN row_id % 3 = 0 THEN timestamp'1998-01-01' END").alias("submitted_at"),
        F.expr("CASE WHEN row_id % 7 = 0 THEN array('id', 'version') ELSE array('title', 'nope') END").alias("fields"), F.col("title").alias("new_title"))


@query("patch_listing", f"WITH {PATCH} SELECT id, CASE WHEN status = 'applied' THEN title ELSE old_title END AS title, CASE WHEN status = 'applied' THEN version + 1 ELSE version END AS version, status FROM x", SI)
def patch_listing(t):
    return mg.patch_listing(t.stored_v, _patches(t)).select("id", "title", "version", "status")


@query("late_update_reject", f"WITH {PATCH} SELECT status, count(*) AS n FROM x GROUP BY 1", SI)
def late_update_reject(t):
    return mg.patch_listing(t.stored_v, _patches(t)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("delete_listings", "SELECT id FROM stored_v WHERE id NOT IN (SELECT row_id * 3 FROM incoming_v)", SI)
def delete_listings(t):
    return mg.delete_listings(t.stored_v, t.incoming_v.select((F.col("row_id") * 3).alias("id"))).select("id")


@query("bulk_delete", "SELECT count(*) AS deleted FROM stored_v WHERE id IN (SELECT row_id * 3 - 6 FROM incoming_v WHERE row_id * 3 - 6 > 0)", SI)
def bulk_delete(t):
    ids = t.incoming_v.select((F.col("row_id") * 3 - 6).alias("id"))
    return mg.bulk_delete_count(t.stored_v, ids.union(ids))


@query("existing_ids", "SELECT id FROM stored_v WHERE id IN (SELECT row_id * 3 FROM incoming_v)", SI)
def existing_ids(t):
    return mg.existing_ids(t.stored_v, t.incoming_v.select((F.col("row_id") * 3).alias("id")))


@query("envelope_json", """SELECT id, url, title, description, price, city, link AS links, dedupe_key AS dedupe, version * 0 AS category_id, 'jobs' AS category, '{}' AS location,
'title,description,price,currency,state,city,zip_code,street,contact_name,contact_phone,contact_email,images,videos,documents,links,attributes,location' AS names FROM stored_v""", ("stored_v",))
def envelope_json(t):
    df = tb.envelope_json(stored_listings(t).withColumn("source_name", F.lit("s")), "jobs")
    d = F.col("document")
    get = lambda path: F.get_json_object(d, path)
    return df.select("id", get("$.url").alias("url"), get("$.scraped_data.title").alias("title"), get("$.scraped_data.description").alias("description"),
                     get("$.scraped_data.price").cast("double").alias("price"), get("$.scraped_data.city").alias("city"), get("$.scraped_data.links[0]").alias("links"),
                     get("$.scraped_data.attributes.dedupe_key").alias("dedupe"), get("$.category.id").cast("int").alias("category_id"), get("$.category.name").alias("category"),
                     get("$.scraped_data.location").alias("location"), F.array_join(F.json_object_keys(get("$.scraped_data")), ",").alias("names"))


@query("read_evolved_schema", """SELECT id, url, title, currency, version FROM (SELECT id, url, title, 'BRL' AS currency, 1 AS version FROM stored_v
UNION ALL SELECT row_id, url, title, currency, 1 FROM incoming_v)""", SI)
def read_evolved_schema(t):
    oldest = t.stored_v.select(F.col("id").alias("job_id"), "url", F.col("title").alias("job_title"), F.lit("x").alias("retired"))
    newer = t.incoming_v.select(F.col("row_id").alias("id"), "url", "title", "currency")
    return tb.read_evolved_schema([oldest, newer], "id long, url string, title string, currency string, version int", {"currency": "BRL", "version": 1},
                                  {"job_id": "id", "job_title": "title"}, ("retired",))
