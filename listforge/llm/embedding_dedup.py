"""Near-duplicate vectors by iterative quantisation.

A rotation is learned on a bounded sample so that the signs of the rotated vectors make balanced binary
codes with small quantisation error; rotations from several starts give longer codes.  Codes are cut into
substrings, one hash table each, and vectors that agree in a substring meet in its bucket.  The length of
a substring follows the number of vectors, and the number of tables follows from it, so that a pair at the
threshold is missed with a probability of about ``MISS``.  In the bucket the cosine of the original vectors
decides, in double precision.  A pair that meets in several tables counts in the first alone.

Buckets are cut into tiles of bounded size and every pair of tiles of a bucket is a task's unit of work, so
no bucket has a limit and none is in one task.  A unit returns for each vector its number of links and one
link to the least vector of its component within the unit: as many rows as vectors, not as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import stored
from listforge.llm.components import components

TILE = 1024
MISS = 0.02


def unit_rows(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(which values are usable, the usable ones scaled to length one, in double precision; they may differ in length)."""
    good, out = [], []
    for v in lists.to_pylist():
        x = np.array([np.nan] if v is None or not v else [np.nan if e is None else e for e in v], np.float64)
        norm = float(np.sqrt(x @ x)) if np.isfinite(x).all() else 0.0
        good.append(norm > 0 and np.isfinite(norm))
        if good[-1]:
            out.append(x / norm)
    return np.array(good, bool), out


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, unit`` of the vectors that have a direction; ``unit`` holds its doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                good, units = unit_rows(part.column("embedding"))
                if good.any():
                    yield pa.RecordBatch.from_arrays([part.column("vec_id").filter(pa.array(good)), pa.array([u.tobytes() for u in units], pa.binary())], names=["vec_id", "unit"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, unit binary")


def rotation(sample: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """The rotation that iterates between signs and the best rotation towards them."""
    rng = np.random.default_rng(seed)
    r, _ = np.linalg.qr(rng.standard_normal((sample.shape[1],) * 2))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(sample @ r).T @ sample)
        r = (u @ vt).T
    return r


def learn(units: DataFrame, rows: int, width: int, tables: int) -> np.ndarray | None:
    """Projection to the code bits of all tables, learned from the ``rows`` vectors with the least hash of the id."""
    got = units.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(rows).select("unit").collect()
    if not got:
        return None
    x = np.array([np.frombuffer(bytes(r[0])) for r in got])
    _, _, vt = np.linalg.svd(x.T @ x)
    codes = -(-width * tables // x.shape[1])
    return np.concatenate([vt.T @ rotation(x @ vt.T, seed) for seed in range(codes)], 1)[:, :width * tables]


def table_shape(n: int, least: float) -> tuple[int, int]:
    """(bits of a table's key, number of tables): about 32 vectors in a bucket when codes are balanced."""
    width = int(np.clip(np.ceil(np.log2(max(n, 1) / 32)), 4, 20))
    meet = (1 - np.arccos(least) / np.pi) ** width
    return width, int(np.ceil(np.log(MISS) / np.log(1 - meet)))


def keys_of(bits: np.ndarray, width: int) -> np.ndarray:
    """Substrings of the codes as numbers, one column a table."""
    tables = bits.shape[1] // width
    cut = bits[:, :tables * width].reshape(len(bits), tables, width)
    return cut @ (1 << np.arange(width))


def tile_links(a: np.ndarray, b: np.ndarray, ka: np.ndarray, kb: np.ndarray, table: int, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (one of ``a``, one of ``b``) that link and meet in no table before this one."""
    rough = a.astype(np.float32) @ b.astype(np.float32).T >= np.float32(least - 1e-3)
    i, j = np.nonzero(np.triu(rough, 1) if same else rough)
    exact = np.einsum("ij,ij->i", a[i], b[j]) >= least
    i, j = i[exact], j[exact]
    first = ~(ka[i, :table] == kb[j, :table]).any(1)
    return i[first], j[first]


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least row of each row's component under the given links."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def dedup(vectors: DataFrame, least: float = 0.95, sample: int = 4000) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.  Equal
    directions are looked up once and count for each other with their number.  Vectors of different lengths
    link with nothing of each other; every length is searched on its own.  A row with a null id is in the result alone.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    units = stored(usable(rows.filter("vec_id is not null")), "units")
    same = stored(units.groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "directions")
    found = vectors.sparkSession.createDataFrame([], "rep long, more long, b long")
    sizes = same.groupBy(F.length("unit").alias("size")).count().filter("count > 1").orderBy("size").collect()
    for size, n in sizes:
        of_size = same.filter(F.length("unit") == size)
        width, tables = table_shape(n, least)
        p = learn(of_size.select(F.col("rep").alias("vec_id"), "unit"), sample, width, tables)
        found = found.unionByName(stored(found_links(of_size, p, width, least), "links"))
    joined = components(found.select(F.col("rep").alias("a"), "b").filter("a <> b"))
    extra = found.groupBy("rep").agg(F.sum("more").alias("more"))
    by_rep = (same.join(extra, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
              .select("unit", (F.coalesce("more", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id")))
    named = units.join(stored(by_rep, "by-direction"), "unit").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return (rows.select("vec_id").join(named, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def found_links(same: DataFrame, p: np.ndarray, width: int, least: float) -> DataFrame:
    """``rep, more, b``: links of a direction found in one pair of tiles, and a direction of its component there."""
    sent = same.sparkSession.sparkContext.broadcast(p)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("unit").to_pylist())).reshape(batch.num_rows, -1)
                keys = keys_of(x @ sent.value > 0, width)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys.astype(np.int32)), pa.list_(pa.int32()))], names=["unit", "rep", "m", "keys"])

    coded = stored(same.mapInArrow(keyed, "unit binary, rep long, m long, keys array<int>"), "codes")
    buckets = coded.select("*", F.posexplode("keys").alias("t", "key"))
    sizes = stored(buckets.groupBy("t", "key").agg(F.count("*").alias("size")).filter("size > 1")
                   .withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")), "buckets")
    tile = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    placed = buckets.join(sizes, ["t", "key"]).withColumn("tile", tile)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    work = (placed.select("*", other)
            .select("t", "key", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "unit", "rep", "m", "keys"))

    def run(table: pa.Table) -> pa.Table:
        t, x, y = (table.column(c)[0].as_py() for c in ("t", "x", "y"))
        table = table.sort_by("rep")
        tiles, reps, m = (table.column(c).to_numpy() for c in ("tile", "rep", "m"))
        units = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(len(reps), -1)
        keys = np.array(table.column("keys").to_pylist(), np.int32)
        i, j = np.flatnonzero(tiles == x), np.flatnonzero(tiles == y)
        a, b = tile_links(units[i], units[j], keys[i], keys[j], t, least, x == y)
        a, b = i[a], j[b]
        more = np.bincount(a, m[b], len(reps)) + np.bincount(b, m[a], len(reps))
        root = spanning(a, b, len(reps))
        some = np.flatnonzero(more > 0)
        return pa.table({"rep": reps[some], "more": more[some].astype(np.int64), "b": reps[root[some]]})

    return work.groupBy("t", "key", "x", "y").applyInArrow(run, "rep long, more long, b long")
