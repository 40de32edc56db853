"""Entity resolution and the versioned merge.

Matching never pairs rows inside a key group.  The stored side is cut down to the keys that are asked
for (a semi-join with the batch, which Spark broadcasts when the batch is small), then reduced to one
winner per key, so each incoming key finds at most one row, and an incoming row takes the best answer
over its keys, again by aggregation.  A key that holds a third of all rows therefore costs a split join
partition, not a quadratic blow-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from listforge import fixed_values as fv
from listforge.functions import attributes as at, text as tx, urls
from listforge.operators.scan import running
from listforge.session import ensure_checkpoint_dir
from listforge.sources import tables as tb

TEXT_FIELDS = ["title", "description", "state", "city", "zip_code", "street", "contact_name",
               "contact_phone", "contact_email"]
LIST_FIELDS = ["images", "videos", "documents"]


def truthy(c: Column, kind: str) -> Column:
    """The value, or null when it counts as missing: 0, '', empty list."""
    if kind == "number":
        return F.when(c != 0, c)
    if kind == "list":
        return F.when(F.size(c) > 0, c)
    if kind == "struct":
        return c
    return tx.empty_to_null(c)


def field_kind(name: str) -> str:
    return ("number" if name == "price" else "list" if name in LIST_FIELDS else
            "struct" if name == "location" else "text")


def latest_by(df: DataFrame, keys: list[str], order: Column, id_column: str = "id") -> DataFrame:
    """Winner per key: greatest order, then smallest id.  An aggregate, not a window, so a hot key
    is reduced inside every partition before anything is shuffled."""
    best = F.max(F.struct(order.alias("o"), (-F.col(id_column)).alias("i")))
    return df.groupBy(*keys).agg(best.alias("__best")).select(
        *keys, (-F.col("__best.i")).alias("match_id"), F.col("__best.o").alias("match_order"))


def match_by_url(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    keys = stored.select("url", F.col("id").alias("match_id"))
    return incoming.join(keys, "url", "left")


def link_keys(stored: DataFrame) -> DataFrame:
    """Stored links are compared as stored, only trimmed."""
    return (stored.select("source_id", "id", "updated_at", F.explode("links").alias("link"))
            .select("source_id", "id", "updated_at", F.trim("link").alias("link")).where("link <> ''"))


def match_by_any_link(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(row_id, match_id): same source and a shared link; the newest stored listing wins."""
    asked = incoming.select("row_id", "source_id", F.explode(F.array_distinct(urls.external_links("links"))).alias("link"))
    held = link_keys(stored).join(asked.select("source_id", "link"), ["source_id", "link"], "left_semi")
    best = latest_by(held, ["source_id", "link"], F.col("updated_at"))
    hit = asked.join(best, ["source_id", "link"])
    return hit.groupBy("row_id").agg(F.max(F.struct("match_order", (-F.col("match_id")).alias("i"))).alias("b")).select(
        "row_id", (-F.col("b.i")).alias("match_id"))


def match_by_attribute(incoming: DataFrame, stored: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """(row_id, match_id): same source and equal attribute; the newest stored listing wins."""
    value = F.trim(F.try_element_at(F.col("attributes"), F.lit(key)))
    keys = stored.select("source_id", "id", "updated_at", value.alias("value")).where("value <> ''")
    asked = incoming.select("row_id", "source_id", value.alias("value")).where("value <> ''")
    keys = keys.join(asked.select("source_id", "value"), ["source_id", "value"], "left_semi")
    best = latest_by(keys, ["source_id", "value"], F.col("updated_at"))
    return asked.join(best, ["source_id", "value"]).select("row_id", "match_id")


# --- all three at once -------------------------------------------------------------------
def _keys(df: DataFrame, links: Column, *extra: Column) -> DataFrame:
    """Rows of (rank, scope, key): url in scope -1, links and dedupe keys in the scope of their source."""
    dedupe = F.trim(F.try_element_at(F.col("attributes"), F.lit("dedupe_key")))
    scope = F.coalesce(F.col("source_id").cast("long"), F.lit(0))
    entries = F.concat(F.array("url", dedupe), links)
    rank = F.when(F.col("pos") == 0, 1).when(F.col("pos") == 1, 3).otherwise(2)
    named = df.select(*extra, scope.alias("scope"), F.posexplode(entries).alias("pos", "key")).where("key <> '' and (pos = 0 or scope <> 0)")
    return named.select(*extra, rank.alias("rank"), F.when(F.col("pos") == 0, F.lit(-1).cast("long")).otherwise(F.col("scope")).alias("scope"), "key")


def asked_keys(incoming: DataFrame) -> DataFrame:
    """(row_id, rank, scope, key) of incoming rows."""
    links = F.coalesce(F.col("links"), F.array().cast("array<string>"))
    return _keys(incoming, F.array_distinct(urls.external_links(links)), F.col("row_id"))


def stored_keys(stored: DataFrame) -> DataFrame:
    """(id, updated_at, rank, scope, key) of stored listings."""
    links = F.coalesce(F.col("links"), F.array().cast("array<string>"))
    return _keys(stored, F.array_distinct(F.transform(links, lambda x: F.trim(x))), F.col("id"), F.col("updated_at"))


def resolve_listing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(row_id, match_id): url first, then a shared link, then the dedupe key, in one join."""
    return resolve_keys(asked_keys(incoming), stored_keys(stored))


def resolve_keys(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """(row_id, match_id) from the keys of both sides; of the stored keys only those asked for are aggregated."""
    named = stored.join(asked.select("rank", "scope", "key"), ["rank", "scope", "key"], "left_semi")
    held = latest_by(named, ["rank", "scope", "key"], F.col("updated_at"))
    hit = asked.join(held, ["rank", "scope", "key"])
    best = F.max(F.struct((-F.col("rank")).alias("r"), F.col("match_order").alias("o"), (-F.col("match_id")).alias("i")))
    return hit.groupBy("row_id").agg(best.alias("b")).select("row_id", (-F.col("b.i")).alias("match_id"))


def batch_groups(row_keys: DataFrame) -> DataFrame:
    """(row_id, label): rows that share a key, directly or through others, get the least row id.

    Minimum labels travel row -> key -> row until nothing changes; labels are then followed to
    their own label, so long chains finish in a logarithmic number of rounds.  Each round is
    checkpointed to the shared folder, and no group is ever gathered in one place."""
    spark = row_keys.sparkSession
    ensure_checkpoint_dir(spark)
    shared = row_keys.groupBy("key").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).where("lo < hi").select("key")
    edges = row_keys.join(shared, "key", "left_semi").distinct().checkpoint()
    if edges.isEmpty():
        return edges.select("row_id", F.col("row_id").alias("label"))
    labels = edges.groupBy("row_id").agg(F.min("row_id").alias("label"))
    while True:
        per_key = edges.join(labels, "row_id").groupBy("key").agg(F.min("label").alias("label"))
        spread = edges.join(per_key, "key").groupBy("row_id").agg(F.min("label").alias("new"))
        hop = labels.select(F.col("row_id").alias("new"), F.col("label").alias("far"))
        step = (labels.join(spread, "row_id").join(hop, "new", "left")
                .select("row_id", F.col("label").alias("old"), F.least("label", "new", "far").alias("label")).checkpoint())
        labels = step.select("row_id", "label")
        if step.where("old <> label").isEmpty():
            return labels


def prepare_ingest(incoming: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Clean-up every listing passes before it is matched: description, salary attributes, currency (BRL
    when absent) and, given the source table, the id of its ``source_name``; names that are new get the
    ids ``find_or_create_source`` gives them."""
    out = incoming
    if sources is not None and "source_name" in incoming.columns:
        from listforge.operators.catalog import find_or_create_source, source_key

        created = find_or_create_source(incoming.select(F.col("source_name").alias("name")), sources)
        known = sources.select(F.lower("name").alias("__key"), F.col("id").alias("__source")).unionByName(
            created.select(F.col("name").alias("__key"), F.col("id").alias("__source")))
        known = known.groupBy("__key").agg(F.min("__source").alias("__source"))
        out = (out.withColumn("__key", source_key(F.col("source_name"))).join(known, "__key", "left")
               .withColumn("source_id", F.col("__source")).drop("__key", "__source"))
    if "description" in out.columns:
        out = out.withColumn("description", tx.clean_description_ingest(F.col("description")))
    empty = F.create_map().cast("map<string,string>")
    return (out.withColumn("attributes", at.salary_sanitize(F.coalesce("attributes", empty)))
            .withColumn("currency", F.coalesce("currency", F.lit("BRL"))))


ROWS_PER_TASK = 25_000


def ready_batch(incoming: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """A batch as it is matched, stored.  Its rows are dealt over tasks by their number, as the clean-up costs far more
    than reading them and a batch of a few files is as many tasks."""
    ensure_checkpoint_dir(incoming.sparkSession)
    return prepare_ingest(tb.dealt(incoming, ROWS_PER_TASK), sources).checkpoint()


def merge_targets(incoming: DataFrame, held_keys: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """incoming + (match_id, target): where every row of the batch goes.

    Rows that share a key, directly or through others, form a group.  A row that matches no stored
    listing itself goes where the last row before it in its group went that does, as it would if the
    rows came one by one; rows of a group before the first such row become one new listing.  Rows that
    match different stored listings stay apart.  ``held_keys`` are ``stored_keys``, of all listings or at least
    of those with a key of the batch.  ``asked`` are the ``asked_keys`` of the batch, if they are stored already."""
    ensure_checkpoint_dir(incoming.sparkSession)
    asked = asked_keys(incoming).checkpoint() if asked is None else asked
    matched = incoming.select("row_id").join(resolve_keys(asked, held_keys), "row_id", "left").checkpoint()
    groups = batch_groups(asked.select("row_id", F.concat_ws("\u0001", "rank", "scope", "key").alias("key")))
    own = matched.select("row_id", F.col("match_id").alias("own")).join(groups, "row_id", "left")
    found = own.where("label is null").select("row_id", F.col("row_id").alias("label"), F.col("own").alias("match_id"))
    if not groups.isEmpty():
        found = found.unionByName(_grouped_targets(own.where("label is not null")))
    return incoming.join(found, "row_id").withColumn("target", F.when(
        F.col("match_id").isNotNull(), F.concat(F.lit("s"), F.col("match_id").cast("string"))).otherwise(
        F.concat(F.lit("b"), F.col("label").cast("string")))).drop("label")


def _grouped_targets(own: DataFrame) -> DataFrame:
    """(row_id, label, match_id) of rows that share keys with others of their batch."""
    held = own.where("own is not null").groupBy("label").agg(
        F.min("row_id").alias("first_row"), F.min("own").alias("lo"), F.max("own").alias("hi"))
    single = (own.join(held.where("lo = hi"), "label", "left")
              .withColumn("match", F.coalesce("own", F.when(F.col("row_id") > F.col("first_row"), F.col("lo")))).select("row_id", "label", "match"))
    # only groups that touch several stored listings need their rows in order
    mixed = own.join(held.where("lo <> hi").select("label"), "label", "left_semi")
    several = running(mixed, ["label"], ["row_id"], last={"earlier": F.col("own")}).select("row_id", "earlier")
    return single.join(several, "row_id", "left").select("row_id", "label", F.coalesce("match", "earlier").alias("match_id"))


# --- fold and merge ----------------------------------------------------------------------
FOLDED = TEXT_FIELDS + LIST_FIELDS + ["price", "location"]


def fold_merge(rows: DataFrame, key: str = "target", order: str = "row_id") -> DataFrame:
    """One row per key: for every field the last value that is not missing, in arrival order."""
    def last_truthy(name: str) -> Column:
        value = truthy(F.col(name), field_kind(name))
        return F.max(F.when(value.isNotNull(), F.struct(F.col(order), value.alias("v"))))["v"].alias(name)

    names = [n for n in FOLDED if n in rows.columns]
    last_row = F.max(F.struct(F.col(order), "source_id", "currency")).alias("__last")
    first_url = F.min(F.when(tx.empty_to_null(F.col("url")).isNotNull(), F.struct(F.col(order), "url")))["url"].alias("url")
    folded = rows.groupBy(key).agg(*[last_truthy(n) for n in names], last_row, first_url,
                                   F.count(F.lit(1)).alias("merged_rows"), F.first("match_id", True).alias("match_id"))
    folded = folded.select("*", F.col("__last.source_id").alias("source_id"), F.col("__last.currency").alias("currency")).drop("__last")

    links = (rows.select(key, order, F.posexplode("links").alias("pos", "link")).groupBy(key, "link")
             .agg(F.min(F.struct(order, "pos")).alias("at"))
             .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "link"))).alias("l"))
             .select(key, F.col("l.link").alias("links")))
    pairs = (rows.select(key, order, F.explode("attributes").alias("name", "value")).groupBy(key, "name")
             .agg(F.max(F.struct(order, "value")).alias("b"))
             .groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "b.value")))).alias("attributes")))
    return folded.join(links, key, "left").join(pairs, key, "left")


def fold_batch(rows: DataFrame, key: str = "target", order: str = "row_id") -> DataFrame:
    """The same for a batch, in which most keys have one row: those rows are folded as they stand, and only
    the rows of the other keys are shuffled."""
    rows = rows.checkpoint()
    several = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key).checkpoint()
    alone = rows if several.isEmpty() else rows.join(several, key, "left_anti")
    values = {n: truthy(F.col(n), field_kind(n)) for n in FOLDED if n in rows.columns}
    values |= {"url": tx.empty_to_null(F.col("url")), "merged_rows": F.lit(1).cast("long"), "match_id": F.col("match_id"),
               "source_id": F.col("source_id"), "currency": F.col("currency"), "links": F.when(F.size("links") > 0, F.array_distinct("links")),
               "attributes": F.when(F.size("attributes") > 0, F.map_from_entries(F.array_sort(F.map_entries("attributes"))))}
    single = alone.select(key, *[c.alias(n) for n, c in values.items()])
    if several.isEmpty():
        return single
    return single.unionByName(fold_merge(rows.join(several, key, "left_semi"), key, order))


def merge_listing(stored: DataFrame, folded: DataFrame, now: Column | None = None, untouched: bool = False) -> DataFrame:
    """Stored listings with the folded batch applied, and with ``untouched`` the others as they are."""
    new = folded.where("match_id is not null").select(
        [F.col(c).alias(f"new_{c}") for c in folded.columns if c not in ("match_id",)] + [F.col("match_id").alias("id"), F.lit(True).alias("__hit")])
    joined = stored.join(new, "id", "left" if untouched else "inner")
    empty = F.array().cast("array<string>")
    out: dict[str, Column] = {}
    for name in FOLDED:
        if f"new_{name}" in joined.columns:
            out[name] = F.coalesce(F.col(f"new_{name}"), F.col(name))
    out["url"] = F.coalesce(tx.empty_to_null(F.col("url")), F.col("new_url"))
    out["source_id"], out["currency"] = F.col("new_source_id"), F.col("new_currency")
    out["links"] = F.array_union(F.coalesce("links", empty), F.coalesce("new_links", empty))
    out["attributes"] = at.merge_attributes(F.col("attributes"), F.col("new_attributes"))
    out["version"] = (F.coalesce("version", F.lit(0)) + F.col("new_merged_rows")).cast("int")
    if now is not None:
        out["updated_at"] = now
    kinds = dict(stored.dtypes)
    return joined.select(*[(F.when(F.col("__hit"), out[n]).otherwise(F.col(n)).cast(kinds[n]) if n in out else F.col(n)).alias(n) for n in stored.columns])


def insert_listing(folded: DataFrame, stored: DataFrame, now: Column, base: DataFrame | None = None) -> DataFrame:
    """Rows for groups without a stored match.  Ids continue after the greatest stored id (``base``, if known) in
    the order of the groups, so a replayed batch gives the same ids."""
    fresh = folded.where("match_id is null")
    numbered = with_row_ids(fresh, stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("base")) if base is None else base, "target")
    empty = F.array().cast("array<string>")
    columns = {"id": F.col("id"), "version": F.col("merged_rows").cast("int"), "created_at": now, "updated_at": now,
               "links": F.coalesce("links", empty), "attributes": at.merge_attributes(F.lit(None).cast("map<string,string>"), F.col("attributes"))}
    types = dict(stored.dtypes)
    return numbered.select(*[columns.get(n, F.col(n) if n in numbered.columns else F.lit(None).cast(types[n])).alias(n)
                             for n in stored.columns])


def with_row_ids(df: DataFrame, base: DataFrame, order: str) -> DataFrame:
    """Add consecutive ids after a base value (one row, one column) in the order of a unique column.

    The rows are sorted over all partitions and kept, then numbered by their place in a partition plus
    the sizes of the partitions before it, so no single task numbers all rows."""
    ensure_checkpoint_dir(df.sparkSession)
    fixed = df.orderBy(order).withColumn("__m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright(F.col("__m"), 33).alias("__p")
    sizes = fixed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    # one row per partition of the batch: a table of task counts, not of data
    offsets = sizes.select("__p", (F.sum("n").over(_by_partition()) - F.col("n")).alias("__off"))
    numbered = fixed.withColumn("__p", F.shiftright(F.col("__m"), 33)).join(offsets, "__p")
    local = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("id", base.scalar() + F.col("__off") + local + 1).drop("__m", "__p", "__off")


def _by_partition():
    return Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)


def ingest_batch(incoming: DataFrame, stored: DataFrame, now: Column, sources: DataFrame | None = None) -> DataFrame:
    """New state of the listing table: merged + untouched in one join, and inserted."""
    folded = fold_batch(merge_targets(ready_batch(incoming, sources), stored_keys(stored))).checkpoint()
    return merge_listing(stored, folded, now, untouched=True).unionByName(insert_listing(folded, stored, now))


# --- single-row writes ---------------------------------------------------------------------
def sanitized(df: DataFrame) -> DataFrame:
    """Description and salary attributes as every write stores them."""
    if "description" in df.columns:
        df = df.withColumn("description", tx.clean_description_ingest(F.col("description")))
    if "attributes" in df.columns:
        df = df.withColumn("attributes", at.salary_sanitize(F.coalesce("attributes", F.create_map().cast("map<string,string>"))))
    return df


def _creatable(incoming: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """incoming + __new: its url is neither stored nor that of an earlier row.  Rows without a url are never duplicates."""
    has_url = F.coalesce(F.col("url") != "", F.lit(False))
    firsts = incoming.where(has_url).groupBy("url").agg(F.min(order).alias("__first"))
    firsts = firsts.join(stored.select("url", F.lit(True).alias("__stored")).where("url <> ''").distinct(), "url", "left")
    return incoming.join(firsts, "url", "left").withColumn(
        "__new", ~has_url | (F.col("__stored").isNull() & (F.col(order) == F.col("__first")))).drop("__first", "__stored")


def create_listing(incoming: DataFrame, stored: DataFrame, order: str = "row_id") -> DataFrame:
    """Rows that can be stored: of each url that is not stored yet the first row."""
    return sanitized(_creatable(incoming, stored, order).where("__new").drop("__new"))


def create_rejects(incoming: DataFrame, stored: DataFrame, order: str = "row_id") -> DataFrame:
    return _creatable(incoming, stored, order).where("not __new").drop("__new")


def replace_listing(replacements: DataFrame, stored: DataFrame, order: str = "row_id") -> DataFrame:
    """Full overwrite by id; status 'missing' for unknown ids.  Several rows of one id are applied in order,
    one version each; all but the last are 'superseded'."""
    held = stored.select("id", F.col("version").alias("__version"), F.lit(True).alias("__held"))
    if order not in replacements.columns:
        replacements = replacements.withColumn(order, F.lit(0))
    names = [c for c in replacements.columns if c != "version"]
    asked = replacements.withColumn("__t", F.monotonically_increasing_id())
    placed = running(asked, ["id"], [order, "__t"], total={"__place": F.lit(1)})
    staged = sanitized(placed).join(asked.groupBy("id").agg(F.count(F.lit(1)).alias("__n")), "id", "left").join(held, "id", "left")
    last = F.coalesce(F.col("__place") == F.col("__n"), F.lit(True))
    return staged.select(
        *names, F.when(F.col("__held"), F.coalesce("__version", F.lit(0)) + F.col("__place")).cast("int").alias("version"),
        F.when(F.col("__held"), F.when(last, "replaced").otherwise("superseded")).otherwise("missing").alias("status"))


def patch_status(exists: Column, version: Column, updated_at: Column, expected: Column, submitted: Column, field_names: Column) -> Column:
    """missing / conflict_version / conflict_time / invalid / applied, in that order of checking."""
    usable = F.exists(field_names, lambda f: f.isin(fv.PATCHABLE_FIELDS))
    return (F.when(~F.coalesce(exists, F.lit(False)), "missing")
            .when(F.coalesce(F.coalesce(version, F.lit(0)) != expected, F.lit(False)), "conflict_version")
            .when(F.coalesce(updated_at > submitted, F.lit(False)), "conflict_time")
            .when(~F.coalesce(usable, F.lit(False)), "invalid").otherwise("applied"))


def patch_listing(stored: DataFrame, patches: DataFrame, now: Column | None = None, order: str = "submitted_at") -> DataFrame:
    """Outcome per patch plus the listing as it is after that patch.

    ``patches``: id, expected_version, submitted_at, fields (names that are set) and one new_<field>
    column per field that can be set.  Patches of one id are applied in their order, each against the
    version the ones before it left; an applied patch sets the time of the listing to ``now``.

    All patches are decided at once.  The first one that fits the stored version starts a chain.  After it a
    patch without an expected version applies whenever its time and fields allow.  One with an expected version, less
    the number of such free patches before it, applies when the chain has that length, so each patch has one
    successor: the first later one that asks for the next version.  The patches on the chain are found by pointer jumping."""
    now = F.current_timestamp() if now is None else now
    ensure_checkpoint_dir(stored.sparkSession)
    asked = patches.withColumn("__t", F.monotonically_increasing_id()).orderBy("id", F.col(order).asc_nulls_first(), "__t").drop("__t")
    asked = asked.withColumn("__n", F.monotonically_increasing_id()).checkpoint()
    held = stored.select("id", F.lit(True).alias("__held"), F.coalesce("version", F.lit(0)).cast("long").alias("__v"), F.col("updated_at").alias("__u"))
    known = asked.join(held, "id", "left")

    usable = F.coalesce(F.col("__held"), F.lit(False)) & F.coalesce(F.exists("fields", lambda f: f.isin(fv.PATCHABLE_FIELDS)), F.lit(False))
    fits = usable & ~F.coalesce(F.col("__u") > F.col("submitted_at"), F.lit(False)) & F.coalesce(F.col("expected_version") == F.col("__v"), F.lit(True))
    known = known.join(known.where(fits).groupBy("id").agg(F.min("__n").alias("__first")), "id", "left")
    later = usable & (F.col("__n") > F.col("__first")) & ~F.coalesce(now > F.col("submitted_at"), F.lit(False))
    known = known.withColumn("__kind", F.when(F.col("__n") == F.col("__first"), "first").when(later & F.col("expected_version").isNull(), "free").when(later, "bound"))
    known = running(known, ["id"], ["__n"], total={"__free": (F.col("__kind") == "free").cast("int")})

    level = F.when(F.col("__kind") == "first", F.col("__v")).otherwise(F.col("expected_version") - F.col("__free"))
    nodes = known.where("__kind in ('first', 'bound')").select("id", "__n", level.alias("level"), (F.col("__kind") == "first").alias("first")).checkpoint()
    chain = nodes.where("first").select("__n")
    bound = not nodes.where("not first").isEmpty()
    if bound:
        both = nodes.select("id", "level", "__n", F.col("__n").alias("to")).unionByName(nodes.select("id", (F.col("level") + 1).alias("level"), "__n", F.lit(None).cast("long").alias("to")))
        jump = running(both, ["id", "level"], [F.col("__n").desc()], last={"next": F.col("to")}).where("to is null and next is not null").select("__n", "next").checkpoint()
    while bound:
        newest = chain.join(jump, "__n").select(F.col("next").alias("__n")).checkpoint()
        if newest.isEmpty():
            break
        chain = chain.unionByName(newest).checkpoint()
        jump = jump.join(jump.select(F.col("__n").alias("next"), F.col("next").alias("far")), "next").select("__n", F.col("far").alias("next")).checkpoint()

    known = known.join(chain.withColumn("__on", F.lit(True)), "__n", "left")
    applied = F.coalesce(F.col("__on"), F.lit(False)) | F.coalesce(F.col("__kind") == "free", F.lit(False))
    known = known.withColumn("__applied", applied.cast("int"))
    settable = [n for n in stored.columns if f"new_{n}" in patches.columns and n in fv.PATCHABLE_FIELDS]
    values = {n: F.when((F.col("__applied") == 1) & F.array_contains("fields", n), F.struct(_patch_value(n).alias("v"))) for n in settable}
    done = running(known, ["id"], ["__n"], last={f"__set_{n}": c for n, c in values.items()}, total={"__count": F.col("__applied")})
    done = done.drop(*[c for c in stored.columns if c != "id"]).join(stored, "id", "left")
    before = F.col("__count") - F.col("__applied")
    status = patch_status(F.col("__held"), F.col("__v") + before, F.when(before > 0, now).otherwise(F.col("__u")), F.col("expected_version"), F.col("submitted_at"), F.col("fields"))
    out = {"version": F.when(F.col("__count") > 0, F.col("__v") + F.col("__count")).otherwise(F.col("version")).cast("int")} if "version" in stored.columns else {}
    out["updated_at"] = F.when(F.col("__count") > 0, now).otherwise(F.col("updated_at")).cast("timestamp")
    out |= {n: F.when(F.col(f"__set_{n}").isNotNull(), F.col(f"__set_{n}.v")).otherwise(F.col(n)) for n in settable}
    return done.select(*[out.get(n, F.col(n)).alias(n) for n in stored.columns], status.alias("status"))


def _patch_value(name: str) -> Column:
    value = F.col(f"new_{name}")
    return tx.clean_description_ingest(value) if name == "description" else at.salary_sanitize(value) if name == "attributes" else value


def delete_listings(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id"), "id", "left_anti")


def bulk_delete_count(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """How many stored listings the positive ids hit; repeats count once."""
    return stored.join(ids.where("id > 0").select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def existing_ids(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.select("id").join(ids.select("id"), "id", "left_semi")
