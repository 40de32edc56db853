"""N-gram Jaccard join in metric space.

The distance of two sets of word shingles is one less their Jaccard similarity, a metric; a link is a
distance of at most ``eps``.  Equal sets are one class and are compared once.

*Pivots and regions.*  The first pivots are single shingles in one order for the whole corpus, rare ones
first (by a table of document frequencies of fixed size; any order gives the same links).  The region of a
pivot holds the sets for which it is the first pivot at a distance below one.  A set within ``eps`` of another
misses at most the share ``eps`` of its shingles, so the first ``c`` pivots two linked sets have in common are among
the first ``n - ceil(t * n) + c`` pivots of either: that is the window by which sets are also put into the
regions behind their own.  Regions of one class fall away, and so do sets that meet others in fewer than ``c``
regions or no single other set in ``c`` of them, which leaves little more than the sets that have links.

*Recursion.*  In each region a document becomes the pivot and its distance to the others is taken exactly.
What lies within ``eps`` of it is one component and is not compared again among itself, so a group of near
copies costs one comparison a member.  Regions that hold one component are done.  Of the rest, small ones
compare their members; large ones split again, with the empty set as the pivot: by the triangle inequality
two linked sets differ in size by a share of ``eps``, which gives rings and the guests of a ring.  A ring
that still holds several components is compared in pairs of tiles of bounded size, each a piece of work
of its own that returns spanning links, so no step puts a region into one task or writes out its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import byte_slices, mix, shuffles_freed, stored
from listforge.llm.components import components
from listforge.llm.embedding_dedup import spanning
from listforge.llm.lm_scoring import tokens_of

BITS, CHUNKS, MARKS = 22, 32, 24
SMALL, TILE, PAIRED = 48, 256, 8


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of every text.  A text of fewer words
    has its whole sequence as one; one without words has none."""
    h, sizes = tokens_of(texts)
    out, at = [], 0
    for size in sizes:
        w = h[at:at + size - 1]
        at += size
        if len(w) == 0:
            out.append(w)
            continue
        n = min(k, len(w))
        g = w[:len(w) - n + 1] + np.uint64(n if n < k else 0)
        for j in range(1, n):
            g = mix(g * np.uint64(31) + w[j:len(w) - n + 1 + j])
        out.append(np.unique(g))
    return out


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BITS)).astype(np.int64)


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """Rough document frequency (its binary logarithm) of the shingles of each of ``2 ** BITS`` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                np.add.at(counts, slots(np.concatenate(sets)), 1)
        if counts.any():
            for i, c in enumerate(np.split(np.minimum(counts, 65535).astype(np.uint16), CHUNKS)):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([int(counts.sum()) % 8]), pa.array([pa.compress(c.tobytes(), "zstd", asbytes=True)])], names=["chunk", "salt", "c"])

    def added(table: pa.Table) -> pa.Table:
        size = (1 << BITS) // CHUNKS
        c = np.zeros(size, np.uint16)
        for x in table.column("c"):
            more = np.frombuffer(pa.decompress(x.as_py(), size * 2, "zstd", asbytes=True), np.uint16)
            c = np.where(c > 65535 - more, np.uint16(65535), c + more)
        return pa.table({"chunk": table.column("chunk")[:1], "salt": pa.array([0]), "c": pa.array([pa.compress(c.tobytes(), "zstd", asbytes=True)])})

    shape = "chunk long, salt long, c binary"
    with shuffles_freed(docs.sparkSession):
        got = docs.select("text").mapInArrow(run, shape).groupBy("chunk", "salt").applyInArrow(added, shape).groupBy("chunk").applyInArrow(added, shape).collect()
    total = np.zeros((CHUNKS, (1 << BITS) // CHUNKS), np.uint16)
    for r in got:
        total[r.chunk] = np.frombuffer(pa.decompress(bytes(r.c), total.shape[1] * 2, "zstd", asbytes=True), np.uint16)
    return np.log2(np.maximum(total.ravel(), 1)).astype(np.uint8)


def shared_at_least(n: int) -> int:
    """How many pivots of the windows two linked sets have in common, the smaller of ``n``."""
    return 1 + n * 3 // 100


def window(n: int, percent: int) -> int:
    """Length of the window of a set of ``n``: a linked set misses ``n - ceil(t * n)`` of it at most."""
    return min(n, n - -(-percent * n // 100) + shared_at_least(n))


def allowed(percent: int):
    """Whether two sets of these sizes can be linked."""
    return F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent


def classes_of(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n, sid`` for every row; ``sid`` names its set and is null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n", "sid"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, sid long")


def regions(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``key, sid, n``: the sets in the regions that hold more than one class."""
    sent = docs.sparkSession.sparkContext.broadcast(frequencies(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = sent.value
        for batch in batches:
            for part in byte_slices(batch, "text"):
                keys, ids, sizes = [], [], []
                for s in {x.tobytes(): x for x in shingle_sets(part.column("text"), k)}.values():
                    if len(s):
                        p = window(len(s), percent)
                        order = (rank[slots(s)].astype(np.uint64) << np.uint64(58)) | (mix(s) >> np.uint64(6))
                        at = np.argpartition(order, p - 1)[:p] if p < len(s) else slice(None)
                        keys.append(s[at])
                        ids.append(np.full(len(keys[-1]), set_id(s), np.int64))
                        sizes.append(np.full(len(keys[-1]), len(s), np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)),
                                                      pa.array(np.concatenate(sizes))], names=["key", "sid", "n"])

    held = docs.select("text").mapInArrow(run, "key long, sid long, n int")
    shared = stored(held.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo <> hi").select("key"), "shared-pivots")
    met = stored(held.join(shared, "key", "left_semi").distinct(), "met-pivots")
    partner = F.ceil(F.col("n") * F.lit(percent) / 100)
    enough = met.groupBy("sid", "n").agg(F.count("*").alias("m")).filter(F.col("m") >= 1 + F.floor(partner * 3 / 100)).select("sid")
    met = stored(met.join(stored(enough, "enough"), "sid", "left_semi"), "met-pivots")
    rows = stored(met.join(shared_keys(met), "key"), "regions")
    rows = stored(rows.drop("size").join(with_partner(rows, percent), "sid", "left_semi"), "met-pivots")
    return stored(rows.join(shared_keys(rows), "key").drop("size"), "regions")


def shared_keys(rows: DataFrame) -> DataFrame:
    """``key, size`` of the regions that hold more than one class."""
    sizes = rows.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.count("*").alias("size"))
    return stored(sizes.filter("lo <> hi").select("key", "size"), "shared-pivots")


def with_partner(rows: DataFrame, percent: int) -> DataFrame:
    """``sid`` of the sets that meet one and the same other set in ``c`` regions, as far as that can be told.

    Regions of up to ``PAIRED`` sets are counted by pairs; of larger ones, all are taken to be shared.  In a large
    corpus most sets meet others in ``c`` regions by chance, but each of them in a region or two."""
    met = stored(rows.groupBy("sid").agg(F.count_if(F.col("size") > PAIRED).alias("far"), F.first("n").alias("n")), "met")
    few = rows.filter(F.col("size") <= PAIRED).select("key", "sid").join(met, "sid")
    other = few.select("key", F.col("sid").alias("psid"), F.col("n").alias("pn"), F.col("far").alias("pfar"))
    needed = 1 + F.floor(F.least("n", "pn") * 3 / 100)
    pairs = (few.join(other, "key").filter((F.col("sid") < F.col("psid")) & allowed(percent)).groupBy("sid", "psid")
             .agg((F.count("*") + F.first(F.least("far", "pfar"))).alias("m"), F.first(needed).alias("needed")).filter("m >= needed"))
    pairs = stored(pairs.select("sid", "psid"), "partners")
    alone = met.filter(F.col("far") >= 1 + F.floor(F.ceil(F.col("n") * F.lit(percent) / 100) * 3 / 100)).select("sid")
    return stored(pairs.select("sid").unionByName(pairs.select(F.col("psid").alias("sid"))).unionByName(alone).distinct(), "partnered")


def marks_of(ids: DataFrame) -> np.ndarray:
    """A bit for each of ``2 ** MARKS`` slots that some of the ids fall into; its size is fixed."""
    slot = F.shiftrightunsigned("sid", 64 - MARKS)

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 15, np.uint8)
        bits[table.column("low").to_numpy()] = 1
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([np.packbits(bits).tobytes()])})

    with shuffles_freed(ids.sparkSession):
        got = (ids.select(F.shiftright(slot, 15).cast("int").alias("chunk"), slot.bitwiseAND(F.lit((1 << 15) - 1)).cast("int").alias("low"))
               .distinct().groupBy("chunk").applyInArrow(pack, "chunk int, bits binary").collect())
    out = np.zeros((1 << (MARKS - 15), 1 << 12), np.uint8)
    for r in got:
        out[r.chunk] = np.frombuffer(bytes(r.bits), np.uint8)
    return np.unpackbits(out.ravel()).astype(bool)


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``sid, items`` of the wanted classes, and of few others: the texts are read once more, and a set is
    kept when the slot of its name is marked, so that no text is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(marks_of(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(sent.value)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                found = {}
                for s in shingle_sets(part.column("text"), k):
                    if len(s) and marks[((sid := set_id(s)) % (1 << 64)) >> (64 - MARKS)]:
                        found[sid] = s.tobytes()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["sid", "items"])

    return stored(docs.select("text").mapInArrow(run, "sid long, items binary").dropDuplicates(["sid"]), "sets")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, d, linked`` for pairs of classes: the exact distance, and whether it makes a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "x"):
                ds, links = [], []
                for x, y in zip(part.column("x"), part.column("y")):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    whole = len(x) + len(y) - both
                    ds.append(1 - both / whole)
                    links.append(100 * both >= percent * whole)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ds, pa.float64()), pa.array(links, pa.bool_())], names=["a", "b", "d", "linked"])

    one = sets.select(F.col("sid").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("sid").alias("b"), F.col("items").alias("y"))
    return stored(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, d double, linked boolean"), "compared")


def link_classes(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, label`` of the classes that have a link, over all regions."""
    pair = [F.least("sid", "psid").alias("a"), F.greatest("sid", "psid").alias("b")]
    pivots = rows.groupBy("key").agg(F.min(F.struct("n", "sid")).alias("p")).select("key", F.col("p.sid").alias("psid"), F.col("p.n").alias("pn"))
    first = rows.join(stored(pivots, "pivots"), "key").filter(F.col("sid") != F.col("psid"))
    done = compared(first.filter(allowed(percent)).select(*pair).distinct(), sets, percent)
    labels = components(done.filter("linked"))
    named = rows.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("key", "size")
    rest = stored(named.join(stored(mixed, "mixed"), "key"), "rest")
    few = rest.filter(F.col("size") <= SMALL)
    other = few.select("key", F.col("sid").alias("psid"), F.col("n").alias("pn"), F.col("label").alias("plabel"))
    close = (few.join(other, "key").filter((F.col("sid") < F.col("psid")) & (F.col("label") != F.col("plabel")) & allowed(percent))
             .select(*pair).distinct().join(done, ["a", "b"], "left_anti"))
    close = stored(close, "close")
    ends = stored(close.select(F.col("a").alias("sid")).unionByName(close.select(F.col("b").alias("sid"))).distinct(), "ends")
    more = compared(close, sets.join(ends, "sid", "left_semi"), percent)
    tiled = tile_links(rest.filter(F.col("size") > SMALL), sets, percent)
    links = done.filter("linked").select("a", "b").unionByName(more.filter("linked").select("a", "b")).unionByName(tiled)
    return components(links)


def tile_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that span the components within large regions (``key, sid, n, label``).

    Regions that share members are one.  Its sets go into rings by size, the distance to the empty set,
    each ring one link wide, so a set meets its own ring and, as a guest, the one below.  A ring that holds
    one component is done; the others are cut into tiles, and each pair of tiles is one piece of work."""
    hub = rows.groupBy("key").agg(F.min("sid").alias("b"))
    area = components(rows.join(stored(hub, "hubs"), "key").filter(F.col("sid") != F.col("b")).select(F.col("sid").alias("a"), "b").distinct())
    members = rows.select("sid", "n", "label").distinct().join(area.withColumnRenamed("node", "sid").withColumnRenamed("label", "area"), "sid")
    ring = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)) - 1e-9).cast("int")
    placed = stored(members.select("*", F.explode(F.array(F.struct(ring.alias("ring"), F.lit(True).alias("own")), F.struct((ring - 1).alias("ring"), F.lit(False).alias("own")))).alias("r"))
                    .select("area", "r.ring", "r.own", "sid", "label"), "rings")
    rings = stored(placed.groupBy("area", "ring").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count_if("own").alias("owned"))
                   .filter("lo <> hi and owned > 0").select("area", "ring", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")), "ring-sizes")
    cut = placed.join(rings, ["area", "ring"]).withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    work = (cut.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
            .select("area", "ring", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "own", "sid").join(sets, "sid"))

    def run(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        table = table.sort_by("sid")
        sids, tiles, own = (table.column(c).to_numpy() for c in ("sid", "tile", "own"))
        items = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("items")]
        i, j = np.flatnonzero(tiles == x), np.flatnonzero(tiles == y)
        both = overlaps([items[k] for k in i], [items[k] for k in j])
        n = np.array([len(v) for v in items])
        hit = 100 * both >= percent * (n[i][:, None] + n[j][None, :] - both)
        hit &= own[i][:, None] | own[j][None, :]
        a, b = np.nonzero(np.triu(hit, 1) if x == y else hit)
        root = spanning(i[a], j[b], len(sids))
        some = np.flatnonzero(root != np.arange(len(sids)))
        return pa.table({"a": sids[some], "b": sids[root[some]]})

    return stored(work.groupBy("area", "ring", "x", "y").applyInArrow(run, "a long, b long").distinct(), "tile-links")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices over the items both sides have."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right)) if left and right else np.zeros(0, np.uint64)
    out = np.zeros((len(left), len(right)), np.int64)
    where = []
    for side in (left, right):
        row = np.repeat(np.arange(len(side)), [len(v) for v in side])
        flat = np.concatenate(side) if side else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        there = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        order = np.argsort(at[there], kind="stable")
        where.append((row[there][order], at[there][order]))
    for start in range(0, len(shared), width):
        parts = []
        for (row, at), side in zip(where, (left, right)):
            lo, hi = np.searchsorted(at, [start, start + width])
            m = np.zeros((len(side), min(width, len(shared) - start)), np.float32)
            m[row[lo:hi], at[lo:hi] - start] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def join_documents(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the size of its set and the least id reachable by links.

    Words are split at ASCII white space and A-Z is lower-cased.  Rows whose text is null or has no words
    have 0 shingles and no links; rows with a null id take part, but never name a component unless alone.
    """
    docs = docs.select("doc_id", "text")
    members = stored(classes_of(docs, k), "classes")
    reps = stored(members.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least")), "reps")
    rows = regions(docs, k, percent)
    labels = link_classes(rows, sets_of(docs, rows.select("sid").distinct(), k), percent)
    named = stored(reps.select("sid", "least").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid")), "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = stored(named.join(least, "label").select("sid", "component_id"), "components")
    return (members.join(by_class, "sid", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay when of every component only one document does: that with the least id, null last, and of
    rows that share an id with different texts that with the least hash.  Rows that repeat id and text stay or go together."""
    key = F.xxhash64("doc_id", "text")
    linked = stored(join_documents(docs.select(key.alias("doc_id"), "text"), k, percent).filter("n_shingles > 0").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("component"))
                    .distinct().join(docs.select(key.alias("__row"), "doc_id").distinct(), "__row"), "linked")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).getField("__row").alias("kept"))
    gone = linked.join(first, "component").filter(F.col("__row") != F.col("kept")).select("__row")
    return docs.withColumn("__row", key).join(gone, "__row", "left_anti").select(docs.columns)
