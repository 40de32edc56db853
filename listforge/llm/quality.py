"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Features of a text are hashed one- and two-grams of its words and one- to three-grams of their shapes
(case, digits, punctuation), so that invented words still say how they are written.  A weight table of
``2 ** bits`` values is all that is sent to the scoring tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import as_bytes, byte_slices, fold, mix

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x200-9A-Za-z\x80-\xff]+")
_SEEN: dict[bytes, tuple[int, int]] = {}


def shape(token: bytes) -> int:
    if not (token[:1].isalnum() or token[0] >= 0x80):
        return xxhash.xxh32_intdigest(token)
    kind = (token.isdigit(), any(48 <= c <= 57 for c in token), token.isupper() and len(token) > 1, token[:1].isupper(),
            min(len(token), 12) // 4)
    return xxhash.xxh32_intdigest(repr(kind).encode())


def known(token: bytes) -> tuple[int, int]:
    hit = _SEEN.get(token)
    if hit is None:
        if len(_SEEN) >= 300_000:
            _SEEN.clear()
        hit = (xxhash.xxh64_intdigest(token.lower()), shape(token))
        if len(token) <= 64:
            _SEEN[token] = hit
    return hit


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, feature numbers, values) of the texts, as a sparse matrix by rows."""
    lists = [TOKEN.findall(t) for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    total = int(sizes.sum())
    pairs = np.fromiter((v for x in lists for t in x for v in known(t)), dtype=np.uint64, count=2 * total).reshape(total, 2)
    doc = np.repeat(np.arange(len(texts)), sizes)
    width = np.uint64((1 << bits) - 1)
    columns, owners, values = [], [], []
    for which, grams in ((0, 2), (1, 3)):
        h = pairs[:, which]
        for n in range(1, grams + 1):
            if total < n:
                continue
            same = doc[n - 1:] == doc[:total - n + 1]
            g = np.full(total - n + 1, np.uint64(which * 8 + n), dtype=np.uint64)
            for k in range(n):
                g = mix(g * np.uint64(31) + h[k:total - n + 1 + k])
            columns.append((g & width)[same].astype(np.int64))
            owners.append(doc[:total - n + 1][same])
            at = np.maximum(sizes[owners[-1]], 1).astype(np.float32)
            values.append(5 / at if which else 1 / np.sqrt(at))
    if not columns:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return starts, np.concatenate(columns)[order], np.concatenate(values)[order].astype(np.float32)


class Leader:
    """Follow-the-regularised-leader state of one logistic regression; the last weight is the bias."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.002, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1, np.float64)
        self.n = np.zeros((1 << bits) + 1, np.float64)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, columns: np.ndarray, values: np.ndarray, label: float, weight: float) -> None:
        at, back = np.unique(columns, return_inverse=True)
        x = np.append(np.bincount(back, weights=values, minlength=len(at)), 1.0)
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sample_of_labels(docs: DataFrame, labels: DataFrame, label: str, held: tuple[int, int], rows: int) -> DataFrame:
    """``text, y``: up to ``rows`` labelled training texts of each class, those with the least hash of
    the id.  ``held`` is (modulus, remainder) of the fold that is never learned from.  Of rows that repeat an id
    the least text is taken, so the sample has at most ``2 * rows`` texts however often an id stands in the table."""
    marked = (labels.filter(F.col(label).isin(0, 1) & (fold("doc_id", held[0]) != held[1]))
              .groupBy("doc_id").agg(F.max(label).alias("y")))
    chosen = None
    for y in (0, 1):
        part = marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held: tuple[int, int] = (3, 1), bits: int = 18,
          rows: int = 3000, shards: int = 4, passes: int = 3) -> np.ndarray:
    """Weights learned from at most ``rows`` labelled texts of each class.  Every shard runs its own
    updates over its part of the sample; the mean of the shards' weights is the model."""

    def fit(table: pa.Table) -> pa.Table:
        rows_of = list(zip(table.column("doc_id").to_pylist(), as_bytes(table.column("text").combine_chunks()), table.column("y").to_pylist()))
        rows_of.sort(key=lambda r: xxhash.xxh64_intdigest(str(r[0])))
        model, ys = Leader(bits), np.array([r[2] for r in rows_of])
        share = {y: len(ys) / (2 * max(1, (ys == y).sum())) for y in (0, 1)}
        starts, columns, values = features([r[1] for r in rows_of], bits)
        for _ in range(passes):
            for i, y in enumerate(ys):
                at = slice(starts[i], starts[i + 1])
                model.learn(columns[at], values[at], float(y), share[y])
        w = model.weights(slice(None)).astype(np.float32)
        return pa.table({"n": pa.array([len(ys)], pa.int64()), "w": pa.array([w.tobytes()])})

    sample = sample_of_labels(docs, labels, label, held, rows)
    found = sample.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")).applyInArrow(fit, "n long, w binary").collect()
    total = sum(r.n for r in found)
    if not total:
        return np.zeros((1 << bits) + 1, np.float32)
    return sum(np.frombuffer(bytes(r.w), np.float32) * (r.n / total) for r in found).astype(np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray, held: tuple[int, int] = (3, 1), slice_bytes: int = 1_000_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null reads as the empty text, which scores by the bias
    alone.  A null id is not held out, and has no label to learn from."""
    bits = int(np.log2(len(weights) - 1))
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for part in byte_slices(batch, "text", slice_bytes):
                starts, columns, values = features(as_bytes(part.column("text")), bits)
                sums = np.concatenate([[0.0], np.cumsum(w[columns] * values, dtype=np.float64)])
                logit = sums[starts[1:]] - sums[starts[:-1]] + float(w[-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", held[0]) == held[1], F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
