"""Line de-duplication: blocks of words that an earlier document holds, found by hashed windows.

This replaces the alignment of document pairs by patience diff: pairs chosen by shared rare lines missed blocks whose lines
stand apart in other texts, or that start or end within a line, and cut words no earlier document holds in one piece.

A text is read as its words (white space, so line ends too, does not count).  A block of ``min_words`` words is
deleted from the later document when one earlier document holds it without a gap, wherever it starts or ends in a
line.  That is decided exactly, in three passes:

* Every window of ``min_words`` words is anchored at the least hash of the ``min_words // 3``-word runs in it, so
  two texts that share a window share its anchor.  Texts that are equal as a whole count as one here.
* Windows whose anchor stands in two different texts are named by a hash of all their words.  Each name
  points to its earliest holder; no window pairs two copies with each other.
* A document loses the union of its windows that an earlier document holds, and all its words when an
  earlier document has the same text.

Only whole windows of one earlier document count, so pieces from several never add up to a block.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listforge.llm.common import as_bytes, byte_slices, mix, stored

LINE = re.compile(rb"[^\n]*\n|[^\n]+")
SENTENCE = re.compile(rb"(?<=[.!?])[ \t]+")
WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")
BASE = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1


def units(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, words) of the sentences of every line; together they cover the text."""
    out = []
    for m in LINE.finditer(text):
        start, line = m.start(), m.group()
        cuts = [0, *(s.end() for s in SENTENCE.finditer(line)), len(line)]
        out += [(start + a, start + b, len(line[a:b].split())) for a, b in zip(cuts, cuts[1:]) if a < b]
    return out


def in_order(pairs: list[tuple[int, int]]) -> list[int]:
    """Indices of a longest subsequence whose second values rise; the first values rise already."""
    tops, piles, back = [], [], [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[k], piles[k] = y, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from every position on."""
    if len(h) < k:
        return h[:0]
    power, width, out, held = h, 1, h[:0], 0
    while True:
        if k & width:
            n = len(h) - held - width + 1
            out = out[:n] * np.uint64(pow(BASE, width, 1 << 64)) + power[held:held + n] if held else power
            held += width
        if 2 * width > k:
            return mix(out)
        n = len(h) - 2 * width + 1
        power = power[:n] * np.uint64(pow(BASE, width, 1 << 64)) + power[width:width + n]
        width *= 2


def least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of the ``w`` values from every position on."""
    width = 1
    while width < w and len(v):
        step = min(width, w - width)
        v, width = np.minimum(v[:-step], v[step:]), width + step
    return v


def windows(texts: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, anchor, hashes of all words of the slice) of every window inside one text."""
    words = [t.split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    k = max(1, min_words // 3)
    anchor = least(rolled(h, k), min_words - k + 1)
    counts = np.maximum(0, sizes - min_words + 1)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = place + (np.cumsum(sizes) - sizes)[owner]
    return owner, place, anchor[at], rolled(h, min_words)[at]


def joined(places: list[int], min_words: int) -> list[int]:
    """start, end, start, end, ... of the stretches of words that the windows cover together."""
    out: list[int] = []
    for p in sorted(places):
        if out and p <= out[-1]:
            out[-1] = p + min_words
        else:
            out += [p, p + min_words]
    return out


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def find_cuts(docs: DataFrame, min_words: int = 25) -> DataFrame:
    """``row, copy, spans, earlier``: what to delete, by the key of the row (a hash of id and text).  A ``copy`` has
    the text of an earlier document and goes as a whole; ``spans`` are starts and ends of stretches of words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                owner, _, anchor, _ = windows(as_bytes(part.column("text")), min_words)
                fresh = np.ones(len(owner), bool)
                fresh[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1])
                whole = part.column("whole").to_numpy()[owner[fresh]]
                yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(anchor[fresh].view(np.int64))], names=["whole", "anchor"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                owner, place, anchor, hashed = windows(as_bytes(part.column("text")), min_words)
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1))
                anchors = part.column("anchors")
                kept = np.concatenate([np.isin(anchor[a:b].view(np.int64), anchors[i].values.to_numpy()) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))])
                chosen = pa.array(owner[kept])
                yield pa.RecordBatch.from_arrays([part.column("row").take(chosen), part.column("doc_id").take(chosen), pa.array(place[kept].astype(np.int32)),
                                                  pa.array(hashed[kept].view(np.int64))], names=["row", "doc_id", "place", "name"])

    keyed = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("whole"), "text")
    key = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "row")
    first = keyed.groupBy("whole").agg(F.min(key).alias("f"))
    anchors = stored(keyed.select("whole", "text").mapInArrow(read, "whole long, anchor long"), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).filter(F.col("a") != F.col("b")).select("anchor")
    asked = (anchors.join(shared, "anchor").groupBy("whole").agg(F.collect_set("anchor").alias("anchors"))
             .join(first, "whole").select(F.col("f.row").alias("row"), "anchors"))
    held = stored(keyed.select("row", "doc_id", "text").join(asked, "row").mapInArrow(name, "row long, doc_id long, place int, name long"), "windows")
    holder = held.withColumn("f", F.min(key).over(Window.partitionBy("name")))
    found = (holder.filter(F.col("row") != F.col("f.row")).groupBy("row")
             .agg(F.collect_set("place").alias("places"), F.array_sort(F.collect_set(F.nullif("f.id", F.lit(LAST)))).alias("earlier")))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [joined(p, min_words) for p in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([False] * len(spans)), pa.array(spans, pa.list_(pa.int32())), batch.column("earlier")],
                                             names=["row", "copy", "spans", "earlier"])

    copies = (keyed.select("row", "whole").join(first, "whole").filter(F.col("row") != F.col("f.row")).groupBy("row").agg(F.first(F.nullif("f.id", F.lit(LAST))).alias("id"))
              .select("row", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("spans"), F.array_compact(F.array("id")).alias("earlier")))
    return found.mapInArrow(align, "row long, copy boolean, spans array<int>, earlier array<long>").unionByName(copies)


def ends(text: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(text)]


def pieces(text: bytes, spans: list[int]) -> list[tuple[int, int]]:
    """(start, end) in bytes of the stretches of words, each with the white space on one side, that without a line end if there is one."""
    words, out = ends(text), []
    for a, b in zip(spans[::2], spans[1::2]):
        start, end = words[a][0], words[b - 1][1]
        before, after = text[words[a - 1][1]:start] if a else b"", text[end:words[b][0]] if b < len(words) else b""
        if not a:
            start = 0
        if b == len(words):
            end = len(text)
        elif not a or before.count(b"\n") >= after.count(b"\n"):
            end = words[b][0]
        else:
            start = words[a - 1][1]
        out.append((start, end))
    return out


def remove(text: bytes, spans: list[int]) -> bytes:
    """The text without the stretches of words between the starts and ends in ``spans``."""
    out, at = [], 0
    for a, b in pieces(text, spans):
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def spans_of(text: bytes | None, copy: bool | None, spans: list[int] | None, min_words: int) -> list[int]:
    """The stretches of a row; a copy is one stretch if it is long enough."""
    if not copy:
        return spans or []
    n = len((text or b"").split())
    return [0, n] if n >= min_words else []


def touched(text: bytes, spans: list[int]) -> int:
    """How many sentences of lines a cut takes words from."""
    stops = np.cumsum([n for *_, n in units(text) if n])
    return sum(int(np.searchsorted(stops, b - 1, "right") - np.searchsorted(stops, a, "right")) + 1 for a, b in zip(spans[::2], spans[1::2])) if spans else 0


def cut_lines(docs: DataFrame, min_words: int = 25) -> DataFrame:
    """``doc_id, n_cut, cut_words, earlier, text`` for every row: the text without the blocks that earlier
    documents (lower ``doc_id``) hold, how many lines or sentences lost words, how many words went, and for
    every word that went the id of the earliest document that holds a block around it.

    Null and empty texts stay as they are.  Rows that repeat both id and text are one document and get one
    answer each; of rows that share an id only, the one with the lower hash counts as the earlier.  A null id
    comes after all others.
    """
    found = find_cuts(docs, min_words)
    keyed = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").join(found, "row", "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            spans = [spans_of(*r, min_words) for r in zip(texts, batch.column("copy").to_pylist(), batch.column("spans").to_pylist())]
            new = [t if not p else remove(t, p) for t, p in zip(texts, spans)]
            earlier = [e if p and e else [] for e, p in zip(batch.column("earlier").to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([touched(t, p) if p else 0 for t, p in zip(texts, spans)], pa.int64()),
                                              pa.array([sum(p[1::2]) - sum(p[::2]) for p in spans], pa.int64()), pa.array(earlier, pa.list_(pa.int64())),
                                              pa.array(new, pa.binary()).cast(pa.string())], names=["doc_id", "n_cut", "cut_words", "earlier", "text"])

    return keyed.mapInArrow(rewrite, "doc_id long, n_cut long, cut_words long, earlier array<long>, text string")


def without_repeats(docs: DataFrame, min_words: int = 25, drop_emptied: bool = False) -> DataFrame:
    """The rows with repeated blocks cut out of ``text``; all other columns stay, ``n_chars`` follows the text.
    ``drop_emptied`` leaves out rows that lost all their words; rows that had none stay."""
    found = find_cuts(docs, min_words).select(F.col("row").alias("__row"), F.col("copy").alias("__copy"), F.col("spans").alias("__spans"))
    columns, counted = docs.columns, "n_chars" in docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            old = batch.column(at).cast(pa.binary()).to_pylist()
            spans = [spans_of(*r, min_words) for r in zip(old, batch.column("__copy").to_pylist(), batch.column("__spans").to_pylist())]
            column = pa.array([t if not p else remove(t, p) for t, p in zip(old, spans)], pa.binary()).cast(pa.string())
            out = batch.set_column(at, pa.field("text", pa.string()), column)
            if counted:
                k = batch.schema.get_field_index("n_chars")
                sizes = pc.if_else(pa.array([bool(p) for p in spans]), pc.utf8_length(column).cast(batch.column(k).type), batch.column(k))
                out = out.set_column(k, batch.schema.field(k), sizes)
            if drop_emptied:
                out = out.filter(pa.array([not p or bool(t.strip()) for p, t in zip(spans, column.cast(pa.binary()).to_pylist())], pa.bool_()))
            yield out.select(columns)

    return docs.withColumn("__row", row_key()).join(found, "__row", "left").select(*columns, "__copy", "__spans").mapInArrow(rewrite, docs.schema)
