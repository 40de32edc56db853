"""Ranked lexical search by pipelined term partitioning.

One pass over the texts counts the terms of every document that some search item may hold.  Terms are dealt to
``len(SHARES) + 1`` owners by the share of documents that hold them, the rarest first, and documents to shards of
about ``SHARD`` by hash.  A bundle is one item in one shard of documents; it starts without documents and visits
owner after owner.  At each it meets, by cogroup, the postings of the owner's terms in its shard, adds their integer
contributions to its sparse accumulator of documents and takes that along.  The best of all shards are the answer.

A bundle leaves a document behind only when it cannot be among the best any more: the ``best``-th partial score of
the shard is already higher than the document's own plus the most that the terms still to come can add.  That bound
is exact, so results are those of the full sum, ties included.

Which documents' terms matter is told to the tasks by a bitmap of ``BITS`` bits over hashes of the items' terms; its
size is fixed, terms let through by chance fall out of the join with the items' terms.  Groups of a cogroup are bounded: one
shard of documents, at most about ``GROUP`` items.  Frequent terms are spread over all shards.

Null and empty texts have no terms, match nothing and do not count as documents.  Repeated rows and ids are
documents of their own.  A null doc_id ranks after equal scores, rows of one item_id (or without one) are one item of all
their terms, items without terms or hits have no rows, empty tables give none.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listforge.llm.common import as_bytes, byte_slices, stored

LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BITS = 1 << 22
SHARD = 16_384
GROUP = 256
SHARES = (0.001, 0.01, 0.1)
BUNDLE = "shard int, grp int, item string, terms array<array<long>>, rest array<long>, rows array<long>, docs array<long>, scores array<long>"
LONGS = pa.list_(pa.field("element", pa.int64()))
SHAPE = pa.schema({"shard": pa.int32(), "grp": pa.int32(), "item": pa.string(), "terms": pa.list_(pa.field("element", LONGS)), "rest": LONGS,
                   "rows": LONGS, "docs": LONGS, "scores": LONGS})


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return text.translate(LETTERS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item, term``: the distinct terms of every item; the item is its id as text, '' for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                pairs = [(i, t.decode()) for i, text in zip(part.column("item").to_pylist(), as_bytes(part.column("text"))) for t in dict.fromkeys(terms_of(text))]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["item", "term"])

    ids = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    return items.select(ids, F.col("text").cast("string")).mapInArrow(run, "item string, term string").distinct()


def bitmap(terms: DataFrame) -> np.ndarray:
    """Which of ``BITS`` hash values the terms have; at most BITS / 32 rows come to the driver."""
    bit = F.crc32(F.col("term").cast("binary")) % BITS
    words = terms.select((bit / 32).cast("long").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int")).alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    flags = np.zeros((BITS // 32, 32), bool)
    flags[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)[:, None] >> np.arange(32) & 1 > 0
    return np.packbits(flags.reshape(-1), bitorder="little")


def count_terms(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``row, doc_id, n, terms, counts``: the number of terms of every document, and how often it holds each that an item may hold."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = sent.value, {}

        def asked(term: bytes) -> bool:
            flag = known.get(term)
            if flag is None:
                at = zlib.crc32(term) % BITS
                if len(known) > 400_000:
                    known.clear()
                flag = known[term] = bool(bits[at >> 3] >> (at & 7) & 1)
            return flag

        for batch in batches:
            for part in byte_slices(batch, "text"):
                sizes, terms, counts, ends = [], [], [], [0]
                for text in as_bytes(part.column("text")):
                    words = terms_of(text)
                    found = [(t, c) for t, c in Counter(words).items() if asked(t)]
                    sizes.append(len(words))
                    terms += [t for t, _ in found]
                    counts += [c for _, c in found]
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(sizes, pa.int64()),
                                                  pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())),
                                                  pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], names=["row", "doc_id", "n", "terms", "counts"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "row long, doc_id long, n long, terms array<string>, counts array<long>")


def visitor(best: int, stage: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda bundles, postings: visit(bundles, postings, best, stage)


def visit(bundles: pa.Table, postings: pa.Table, best: int, stage: int) -> pa.Table:
    """One shard of documents at one owner: the bundles with the contributions of the owner's terms added."""
    bundles = bundles.cast(SHAPE)
    if not bundles.num_rows:
        return bundles
    held = [bundles[c].combine_chunks() for c in ("rows", "docs", "scores")]
    sizes = held[0].value_lengths().to_numpy()
    old_rows = held[0].flatten().to_numpy()
    every, first, place = np.unique(np.concatenate([old_rows, postings["row"].to_numpy()]), return_index=True, return_inverse=True)
    ids = pa.concat_arrays([held[1].flatten(), postings["doc_id"].combine_chunks()]).take(pa.array(first))
    sums = np.zeros((bundles.num_rows, len(every)), np.int64)
    sums[np.repeat(np.arange(len(sizes)), sizes), place[:len(old_rows)]] = held[2].flatten().to_numpy()
    order = np.argsort(postings["term"].to_numpy(), kind="stable")
    names, starts = np.unique(postings["term"].to_numpy()[order], return_index=True)
    at = dict(zip(names.tolist(), np.split(order, starts[1:]) if len(names) else []))
    where, value = place[len(old_rows):], postings["value"].to_numpy()
    after = [r[stage + 1] for r in bundles["rest"].to_pylist()]
    out, ends = [], [0]
    for i, terms in enumerate(bundles["terms"].to_pylist()):
        for term in terms[stage]:
            if term in at:
                sums[i, where[at[term]]] += value[at[term]]
        floor = 1
        if len(every) >= best:
            floor = max(1, np.partition(sums[i], len(every) - best)[len(every) - best] - after[i])
        out.append(np.flatnonzero(sums[i] >= floor))
        ends.append(ends[-1] + len(out[-1]))
    keep, ends = np.concatenate(out), pa.array(ends, pa.int32())
    lists = {"rows": pa.array(every[keep]), "docs": ids.take(pa.array(keep)),
             "scores": pa.array(np.concatenate([sums[i, k] for i, k in enumerate(out)]))}
    return pa.Table.from_arrays([pa.ListArray.from_arrays(ends, lists[c]) if c in lists else bundles[c] for c in bundles.column_names], schema=SHAPE)


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def search(docs: DataFrame, items: DataFrame, best: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` highest-scoring documents of every item."""
    asked = stored(item_terms(items), "item-terms")
    counts = stored(count_terms(docs, bitmap(asked)), "term-counts")
    totals = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], max(totals["terms"] or 0, 1)
    n_shards = -(-n_docs // SHARD) or 1
    m = F.lit(50).cast("long") + div(F.lit(50).cast("long") * F.col("n") * n_docs, F.lit(n_terms).cast("long"))
    postings = counts.filter("n > 0").select(
        "row", "doc_id", m.alias("m"), F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int").alias("shard"),
        F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(
        "row", "doc_id", "shard", F.col("t.terms").alias("name"),
        div(F.lit(1_000_000_000).cast("long") * F.col("t.counts"), F.col("t.counts") * 1000 + F.col("m") * 20).alias("part"))
    owner = sum((F.when(F.col("df") > share * n_docs, 1).otherwise(0) for share in SHARES), F.lit(0))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    terms = (postings.groupBy("name").agg(F.count("*").alias("df"), F.max("part").alias("peak")).join(asked.select(F.col("term").alias("name")).distinct(), "name", "left_semi")
             .select("name", F.monotonically_increasing_id().alias("term"), owner.alias("owner"), weight.alias("weight"), (weight * F.col("peak")).alias("peak")))
    terms = stored(terms.filter("weight > 0"), "terms")
    groups = F.ceil(asked.select("item").distinct().count() / F.lit(GROUP))
    wanted = asked.join(terms, asked["term"] == terms["name"]).select(
        "item", F.pmod(F.xxhash64("item"), F.greatest(groups, F.lit(1))).cast("int").alias("grp"), terms["term"], "owner", "peak")
    wanted = stored(wanted, "wanted")
    stages = len(SHARES) + 1
    of_owner = [F.col("owner") == s for s in range(stages)]
    bundles = wanted.groupBy("item", "grp").agg(
        F.array(*[F.collect_list(F.when(o, F.col("term"))) for o in of_owner]).alias("terms"),
        F.array(*[F.sum(F.when(F.col("owner") >= s, F.col("peak")).otherwise(0)) for s in range(stages)], F.lit(0).cast("long")).alias("rest"))
    none = F.array().cast("array<long>")
    bundles = bundles.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "grp", "item", "terms", "rest",
                             none.alias("rows"), none.alias("docs"), none.alias("scores"))
    for stage in range(stages):
        where = wanted.filter(F.col("owner") == stage).select("term", F.col("grp").alias("of")).distinct()
        share = (postings.join(terms.filter(F.col("owner") == stage), "name").join(where, "term")
                 .select("shard", F.col("of").alias("grp"), "row", "doc_id", "term", (F.col("part") * F.col("weight")).alias("value")))

        bundles = bundles.groupBy("shard", "grp").cogroup(share.groupBy("shard", "grp")).applyInArrow(visitor(best, stage), BUNDLE)
    found = bundles.select("item", "shard", F.explode(F.arrays_zip("rows", "docs", "scores")).alias("d")).select(
        "item", (F.col("shard") % 256).alias("part"), F.col("d.rows").alias("row"), F.col("d.docs").alias("doc_id"), F.col("d.scores").alias("score"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= best)
    kind = items.schema["item_id"].dataType
    return ranked.select(F.when(F.col("item") != "", F.col("item")).cast(kind).alias("item_id"), "rank", "doc_id", "score")
