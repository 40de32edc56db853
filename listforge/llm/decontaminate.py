"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are folded (lower case, runs of anything but letters and digits become one space).
An item of ``n`` characters may differ from a passage by ``k = n * rate`` edits.  Cut into ``k + 1`` pieces, at
least one piece of a matching passage is unchanged, so an automaton over all pieces finds every candidate
in one pass over a text, and Myers' bit-parallel distance decides about the passage around it.  Ends that
stand next to each other belong to one passage, of which the nearest end counts; every passage is returned.  An item
too short for an edit must stand between word bounds, so that a one-word item is not found inside other words.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import byte_slices

NOT_WORD = re.compile(r"[\W_]+")
BLOCK_CHARS = 4_000_000


def folded(text: str) -> str:
    return NOT_WORD.sub(" ", text.lower()).strip()


def folded_at(text: str) -> tuple[str, list[int]]:
    """The folded text with the place in ``text`` of each of its characters."""
    out, places, gap = [], [], False
    for i, ch in enumerate(text):
        low = ch.lower()
        for c in low:
            if c.isalnum():
                if gap and out:
                    out.append(" ")
                    places.append(i)
                gap = False
                out.append(c)
                places.append(i)
            else:
                gap = True
    return "".join(out), places


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of about equal length that cover the item."""
    n, parts = len(item), min(edits + 1, len(item))
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def ends_within(masks: dict[str, int], m: int, text: str, edits: int) -> Iterator[tuple[int, int]]:
    """(end, distance) of every part of the text within ``edits`` of a pattern of ``m`` characters, by rising end."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for j, ch in enumerate(text):
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= edits:
            yield j + 1, score


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        out[ch] |= 1 << i
    return dict(out)


class Matcher:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, found = [], defaultdict(list)
        for item_id, text in items:
            text = folded(text)
            if text:
                edits = int(len(text) * rate)
                for at, piece in pieces(text, edits):
                    found[piece].append((len(self.items), at + len(piece)))
                self.items.append((item_id, text, edits, masks_of(text), masks_of(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, where)
        if self.items:
            self.automaton.make_automaton()

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of every passage of every item within its budget."""
        if not self.items:
            return []
        wanted: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, where in self.automaton.iter(text):
            for k, upto in where:
                edits, n = self.items[k][2], len(self.items[k][1])
                a = max(0, end + 1 - upto - edits)
                wanted[k].append((a, a + n + 2 * edits))
        out = []
        for k, spans in wanted.items():
            passages: dict[int, tuple[int, int]] = {}
            for a, b in joined(spans):
                for d, end in self.passages(k, text, a, b):
                    start = self.start(k, text, a, end, d)
                    passages[start] = min(passages.get(start, (d, end)), (d, end))
            out += [(self.items[k][0], d, start, end) for start, (d, end) in sorted(passages.items())]
        return out

    def passages(self, k: int, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """(distance, end) of the passages of one item in a part of the text."""
        _, pattern, edits, forward, _ = self.items[k]
        ends = [(d, a + end) for end, d in ends_within(forward, len(pattern), text[a:b], edits)]
        if not edits:
            bound = lambda i: i in (0, len(text)) or " " in text[i - 1:i + 1]
            return [(d, end) for d, end in ends if bound(end) and bound(end - len(pattern))]
        found: list[tuple[int, int]] = []
        last = None
        for d, end in ends:
            if last is None or end > last + 1:
                found.append((d, end))
            elif d < found[-1][0]:
                found[-1] = (d, end)
            last = end
        return found

    def start(self, k: int, text: str, a: int, end: int, d: int) -> int:
        """Where the passage that ends at ``end`` with distance ``d`` starts; of several the latest."""
        _, pattern, _, _, backward = self.items[k]
        back, _ = next(ends_within(backward, len(pattern), text[a:end][::-1], d))
        return end - back


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, so that what a task holds does not grow with the benchmark."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).distinct().toLocalIterator():
        if held and size + len(r[1]) > chars:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, spans: bool = True) -> DataFrame:
    """``doc_id, item_id, distance, start, end``: for each text and test item within ``rate`` edits a character
    of the item, every passage, as places in the text (end exclusive).

    Null and empty texts and items match nothing; repeated rows are repeated; of equal distances in one
    passage the first end counts.  The items go to the tasks in blocks of ``BLOCK_CHARS`` characters, one pass for each.
    """
    spark = docs.sparkSession
    shape = "doc_id long, item_id long, distance int, start long, end long"
    result = spark.createDataFrame([], shape)
    for block in blocks_of(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                for part in byte_slices(batch, "text"):
                    rows = []
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                        found = matcher.match(folded(text)) if text else []
                        if found and spans:
                            _, places = folded_at(text)
                            found = [(i, d, places[a], places[b - 1] + 1) for i, d, a, b in found]
                        rows += [(doc_id, *f) for f in found]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                                         names=["doc_id", "item_id", "distance", "start", "end"])

        result = result.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape))
    return result


def without_matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06) -> DataFrame:
    """The rows whose text holds no test item, all columns as they are."""
    spark = docs.sparkSession
    for block in blocks_of(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                for part in byte_slices(batch, "text"):
                    yield part.filter(pa.array([not (t and matcher.match(folded(t))) for t in part.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
