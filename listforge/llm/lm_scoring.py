"""Language-model scoring with a hashed maximum-entropy model.

The ``HEAD`` most frequent words are outcomes of their own, the others share ``1 << TAIL_BITS`` hashed outcomes.
Words of their own fall into ``SIDE`` classes of equal mass by frequency, shared outcomes are dealt to the rarer half of
the classes.  The probability of a token is the product

    P(class | context) * P(outcome | class, context) * P(word | outcome),

a softmax over classes, a softmax over the outcomes of the class, and for shared outcomes the add-one share of
the word by corpus counts.  The class factor is log-linear in hashed features of the context: the previous word,
the previous two words, the word before the previous one (a skip), and a bias; it starts from the discounted class
counts after the previous word.  The outcome factor starts
from the outcome's share of its class and has a weight for every (previous word, outcome) and every (previous two
words, outcome) of the training texts; outcomes without a weight share what the class total leaves them, so the
softmax over all of them is summed over the weighted ones alone.

Weights grow with the corpus: tokens are dealt by their previous word to shards of about ``SHARD`` tokens, a shard
holds all weights of its contexts, and its task learns and scores.  The tokens of a word that precedes more than
``HOT`` tokens are spread over several shards by text, so that no word, passage or copy makes a shard large.  Each
shard steps along its gradient: in batches for the classes, over its counts for the outcomes, whose expected counts
are led to the observed ones less a discount estimated from words seen once and twice.

Words are named by 64-bit hashes; two of ``n`` distinct words share one with probability about ``n * n / 2 ** 65``;
contexts in a shard by 32 and 40 bits, the word before the previous one by 24.  Counts of all words stay a distributed table.  What is broadcast are the
figures of the outcomes, of fixed size; rarer words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listforge.llm.common import byte_slices, fold, mix, stored

SIDE, HEAD, TAIL_BITS = 16, 1 << 17, 15
OUTCOMES = HEAD + (1 << TAIL_BITS)
OUTCOME_BITS = 18
ROWS = 1 << 15
CONTEXTS = 3
SHARD, HOT = 1_000_000, 200_000
TRAIN = np.uint32(1 << 23)
BASE = 0x9E3779B97F4A7C15
BACK = np.uint64(pow(BASE, -1, 1 << 64))
END = np.uint64(0xD6E8FEB86659FD93)
BLOCK = 1 << 20
SLOT = np.uint64(43)
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", np.uint64(BASE)), ("down", BACK)):
            _POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, the end of each text among them; number of tokens of each text).

    A word's hash is its bytes as a polynomial modulo 2 ** 64, taken from running sums over blocks of the
    column's own buffer and then mixed, so that no word becomes a Python object.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    held = ~BLANK[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    first = np.flatnonzero(held & (cut[:-1] | np.concatenate([[True], ~held[:-1]])[:len(raw)]))
    last = np.flatnonzero(held & (cut[1:] | np.concatenate([~held[1:], [True]])[:len(raw)]))
    names = np.empty(len(first), np.uint64)
    marks = np.searchsorted(first, np.arange(0, len(raw) + BLOCK, BLOCK))
    for i, j in zip(marks[:-1], marks[1:]):
        if i < j:
            start, end = first[i], last[j - 1] + 1
            up, down = powers(max(BLOCK, int(end - start)))
            sums = np.zeros(end - start + 1, np.uint64)
            np.cumsum((LOWER[raw[start:end]] + np.uint64(1)) * up[:end - start], out=sums[1:])
            names[i:j] = (sums[last[i:j] - start + 1] - sums[first[i:j] - start]) * down[first[i:j] - start]
    names = mix(names)
    counts = np.diff(np.searchsorted(first, offsets))
    out = np.full(len(names) + len(counts), END)
    out[np.arange(len(names)) + np.repeat(np.arange(len(counts)), counts)] = names
    return out, counts + 1


def count_words(docs: DataFrame, slice_bytes: int = 2_000_000, held_most: int = 1_500_000) -> DataFrame:
    """``h, c``: how often every token occurs in all texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            names, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return names, np.bincount(back, weights=np.concatenate([x[1] for x in held])).astype(np.int64)

        def out(names: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(names), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[i:i + 100_000].view(np.int64)), pa.array(counts[i:i + 100_000])], names=["h", "c"])

        for batch in batches:
            for part in byte_slices(batch, "text", slice_bytes):
                held.append(np.unique(tokens_of(part.column("text"))[0], return_counts=True))
                size += len(held[-1][0])
                if size > held_most:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > held_most // 2:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*merged())

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Figures of fixed size every task needs: the most frequent words and what is known of every outcome."""

    names: np.ndarray
    counts: np.ndarray
    kind: np.ndarray  # class of every outcome
    base: np.ndarray  # natural log of its share of the class
    share: np.ndarray  # log10 of one over the total of a shared outcome, 0 for a word of its own
    total: int
    distinct: int

    def __post_init__(self) -> None:
        self.place = np.zeros(1 << 21, np.int32)
        self.place[(self.names >> SLOT).astype(np.int64)] = np.arange(len(self.names))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of every token among the frequent words, whether it is there)."""
        if not len(self.names):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = self.place[(h >> SLOT).astype(np.int64)]
        return at, self.names[at] == h

    def outcomes(self, h: np.ndarray) -> np.ndarray:
        at, there = self.find(h)
        return np.where(there, at, HEAD + (h >> np.uint64(64 - TAIL_BITS)).astype(np.int64))

    def parts(self, h: np.ndarray) -> np.ndarray:
        """Over how many shards the tokens after each word are spread."""
        at, there = self.find(h)
        if not len(self.names):
            return np.ones(len(h), np.int64)
        rest = self.counts.min() if len(self.names) > HEAD // 2 else 0
        return 1 + np.where(there, self.counts[at], rest) // HOT


def lexicon(counts: DataFrame) -> Lexicon:
    """The figures of the outcomes.  An outcome's mass is the counts of its words, one more for each of them, and
    of a shared outcome one more for words never seen."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(HEAD).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    _, leads = np.unique(h >> SLOT, return_index=True)  # of two words with one place the rarer is not of the head
    leads = leads[np.argsort(h[leads])]
    h, c = h[leads], c[leads]
    masses = np.zeros(OUTCOMES)
    masses[:len(h)] = c
    shared = counts.groupBy(F.shiftrightunsigned("h", 64 - TAIL_BITS).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
    tail = HEAD + np.arange(1 << TAIL_BITS)
    words_in = np.zeros(1 << TAIL_BITS)
    masses[HEAD + shared.column("b").to_numpy()] = shared.column("c").to_numpy()
    words_in[shared.column("b").to_numpy()] = shared.column("n").to_numpy()
    own = (h >> np.uint64(64 - TAIL_BITS)).astype(np.int64)
    np.subtract.at(masses, HEAD + own, c)
    np.subtract.at(words_in, own, 1)
    share = np.zeros(OUTCOMES)
    share[tail] = -np.log10(masses[tail] + words_in + 1)
    masses[:len(h)] += 1
    masses[tail] += words_in + 1
    order = np.argsort(-masses[:len(h)], kind="stable")
    before = np.cumsum(masses[order]) - masses[order]
    kind = (SIDE // 2 + np.arange(OUTCOMES) % (SIDE // 2)).astype(np.uint8)
    kind[order] = np.minimum(SIDE - 1, before * SIDE // max(1, masses[order].sum()))
    base = np.log(np.maximum(masses, 1e-300)) - np.log(np.maximum(np.bincount(kind, weights=masses, minlength=SIDE), 1e-300))[kind]
    return Lexicon(h, c, kind, base, share, total, distinct)


def words_before(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before every token and the one before that; before a text stands the end mark."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one, two = np.full(len(h), END), np.full(len(h), END)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[place < 1], two[place < 2] = END, END
    return one, two


def contexts(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashes of the three context features of every token, from short names of the words before it."""
    one, two = one.astype(np.uint64), two.astype(np.uint64)
    return np.stack([mix(one), mix(one * np.uint64(3) + mix(two)), mix(two + np.uint64(17))])


def rows_of(ctx: np.ndarray) -> np.ndarray:
    """Feature rows of every token in the class table."""
    salt = (np.arange(CONTEXTS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[:, None]
    return ((ctx + salt) >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.uint16)


def logits(table: np.ndarray, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Scores of a batch: what they start from and the rows of the features."""
    out = start.copy()
    for r in rows:
        out += table[r]
    return out


def log_share(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log of the softmax of every row at one place."""
    z -= z.max(1, keepdims=True)
    chosen = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return chosen - np.log(z.sum(1))


def step(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, start: np.ndarray, at: np.ndarray, rate: float) -> None:
    """One gradient update of a table on a batch, with a step per row that falls with its past gradients."""
    z = logits(table, rows, start)
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(z)), at] -= 1
    flat = rows.ravel()
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    g = np.add.reduceat(z[order % len(at)], first, axis=0)
    touched = ordered[first].astype(np.int64)
    squares[touched] += (g * g).mean(1)
    table[touched] -= g * (rate / np.sqrt(squares[touched] + 1e-6))[:, None]


def class_starts(one: np.ndarray, kind: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of every token's previous word, log weights of the classes after each of them): its class counts less a
    discount, the rest by the classes of all tokens, which are the bias."""
    words, place = np.unique(one, return_inverse=True)
    counts = np.bincount(place * SIDE + kind, weights=learned, minlength=len(words) * SIDE).reshape(-1, SIDE)
    bias = counts.sum(0) + 1
    kept = np.maximum(counts - 0.75, 0)
    n = counts.sum(1, keepdims=True)
    rest = np.where(n, n - kept.sum(1, keepdims=True), 1)
    return place, np.log((kept + rest * bias / bias.sum()) / np.maximum(n, 1)).astype(np.float32)


def class_scores(one: np.ndarray, ctx: np.ndarray, kind: np.ndarray, learned: np.ndarray, rate: float = 0.25, batch: int = 16384) -> np.ndarray:
    """Natural log of the class factor of every token, after one pass of updates over those to learn from."""
    table, squares = np.zeros((ROWS, SIDE), np.float32), np.full(ROWS, 1.0, np.float32)
    rows, kind = rows_of(ctx), kind.astype(np.int64)
    place, starts = class_starts(one, kind, learned)
    order = np.random.default_rng(5).permutation(np.flatnonzero(learned))
    for i in range(0, len(order), batch):
        at = order[i:i + batch]
        step(table, squares, rows[:, at], starts[place[at]], kind[at], rate)
    out = np.empty(len(kind))
    for i in range(0, len(kind), batch):
        out[i:i + batch] = log_share(logits(table, rows[:, i:i + batch], starts[place[i:i + batch]]), kind[i:i + batch])
    return out


class Level:
    """The (context, outcome) items of all tokens by sorted key, and the (context, class) groups they fall into."""

    def __init__(self, context: np.ndarray, kind: np.ndarray, at: np.ndarray, learned: np.ndarray):
        bits = np.uint64(OUTCOME_BITS)
        keys = (((context << np.uint64(4)) | kind.astype(np.uint64)) << bits) | at.astype(np.uint64)
        keys, self.first, self.item = np.unique(keys, return_index=True, return_inverse=True)
        groups, self.item = keys >> bits, self.item.astype(np.int32)
        self.starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        self.group = np.repeat(np.arange(len(self.starts), dtype=np.int32), np.diff(np.append(self.starts, len(keys))))
        self.count = np.bincount(self.item, weights=learned, minlength=len(keys))
        self.seen = self.count > 0
        once, twice = (self.count == 1).sum(), (self.count == 2).sum()
        self.wanted = np.maximum(self.count - min(0.9, max(0.1, once / (once + 2 * twice + 1))), 0)
        self.n = self.sums(self.count)
        self.weight = np.zeros(len(keys))

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts)

    def begin(self, p: np.ndarray) -> None:
        """Weights that meet the wanted counts when the outcomes have the probabilities ``p`` without them."""
        target = self.wanted / np.maximum(self.n, 1)[self.group]
        z = np.maximum(1 - self.sums(np.where(self.seen, p, 0)), 1e-4) / np.maximum(1 - self.sums(target), 1e-4)
        self.weight = np.where(self.seen, np.log(np.maximum(target * z[self.group], 1e-12) / p), 0.0)

    def move(self, expected: np.ndarray) -> None:
        """A step along the gradient, wanted less expected counts, scaled by the size of both."""
        self.weight += np.where(self.seen, (self.wanted - expected) / np.maximum(self.wanted + expected, 1e-9), 0.0)


def outcome_scores(one: np.ndarray, pair: np.ndarray, kind: np.ndarray, at: np.ndarray, base: np.ndarray, learned: np.ndarray, steps: int = 4) -> np.ndarray:
    """Natural log of the outcome factor of every token.  ``base`` is the log of the outcome's share of its class."""
    near, far = Level(one, kind, at, learned), Level(pair, kind, at, learned)
    share, up = np.exp(base[near.first]), near.item[far.first]  # an item of two words belongs to one of the last word
    over = near.group[up[far.starts]]

    def totals() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q = share * np.exp(near.weight)
        z = np.maximum(1 + near.sums(np.where(near.seen, q - share, 0)), 1e-9)
        more = q[up] * np.expm1(far.weight)
        return q, z, more, np.maximum(z[over] + far.sums(more), 1e-9)

    near.begin(share)
    q, z, _, _ = totals()
    far.begin(q[up] / z[near.group[up]])
    for _ in range(steps):
        q, z, more, deep = totals()
        rate = far.n / deep
        near.move(np.bincount(over, weights=rate, minlength=len(near.starts))[near.group] * q + np.bincount(up, weights=rate[far.group] * more, minlength=len(q)))
        far.move(rate[far.group] * (q[up] + more))
    _, _, _, deep = totals()
    return base + near.weight[near.item] + far.weight[far.item] - np.log(deep)[far.group[far.item]]


def planes(x: np.ndarray, n: int) -> bytes:
    """The ``n`` low bytes of every number, one byte place after the other."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)[:, :n].T.tobytes()


def packed(one: np.ndarray, two: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[bytes, int, int]:
    """(bytes, tokens, previous words) of some tokens in the order of their previous words."""
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
    runs = np.diff(np.append(first, len(one))).astype(np.uint32)
    raw = planes(one[first], 4) + planes(runs, 4) + planes(two, 3) + planes(at, 3) + planes(row, 2)
    return pa.compress(raw, "zstd", asbytes=True), len(one), len(first)


def unpacked(blob: bytes, n: int, words: int) -> tuple[np.ndarray, ...]:
    raw, place, out = np.frombuffer(pa.decompress(blob, 8 * words + 8 * n, "zstd", asbytes=True), np.uint8), 0, []
    for size, width in ((words, 4), (words, 4), (n, 3), (n, 3), (n, 2)):
        part = np.zeros((size, 4), np.uint8)
        part[:, :width] = raw[place:place + size * width].reshape(width, size).T
        out.append(part.view("<u4").ravel())
        place += size * width
    return np.repeat(out[0], out[1]), *out[2:]


def dealt(docs: DataFrame, lex: Lexicon, shards: int, held: tuple[int, int], slice_bytes: int = 8_000_000) -> DataFrame:
    """``shard, base, tokens, n, words``: the tokens of a slice of texts for one shard; texts are counted from ``base``."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for whole in byte_slices(batch, "text", slice_bytes):
                for part in (whole.slice(i, 65536) for i in range(0, whole.num_rows, 65536)):
                    h, sizes = tokens_of(part.column("text"))
                    one, two = words_before(h, sizes)
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    base = part.column("row")[0].as_py()
                    learned = part.column("learned").to_numpy(zero_copy_only=False)[row]
                    turn = mix((row + base).astype(np.uint64)) >> np.uint64(33)
                    shard = ((one >> np.uint64(20)) + turn % known.parts(one).astype(np.uint64)) % np.uint64(shards)
                    at = known.outcomes(h).astype(np.uint32) | np.where(learned, TRAIN, np.uint32(0))
                    order = np.lexsort((at, one.astype(np.uint32), shard))
                    columns, shard = [x[order] for x in (one.astype(np.uint32), two.astype(np.uint32), at, row.astype(np.uint32))], shard[order]
                    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                    blobs, n, words = zip(*[packed(*(x[i:j] for x in columns)) for i, j in zip(cuts, [*cuts[1:], len(shard)])])
                    yield pa.RecordBatch.from_arrays([pa.array(shard[cuts].astype(np.int64)), pa.array(np.full(len(cuts), base)), pa.array(blobs, pa.binary()),
                                                      pa.array(n, pa.int64()), pa.array(words, pa.int64())], names=["shard", "base", "tokens", "n", "words"])

    learned = F.coalesce(fold("doc_id", held[0]) != held[1], F.lit(True)).alias("learned")
    return docs.select("text", learned, "row").mapInArrow(run, "shard long, base long, tokens binary, n long, words long")


def shard_scores(table: pa.Table, lex: Lexicon) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(base, texts of a slice, sums of the log10 scores of their tokens in the shard), learned from the shard's training tokens.
    The slices are put in order first, so that a shard learns the same however its rows arrive."""
    found = [unpacked(blob, n, words) + (base,) for base, blob, n, words in sorted(
        zip(*(table.column(c).to_pylist() for c in ("base", "tokens", "n", "words"))), key=lambda r: r[0])]
    one, two, at = (np.concatenate([f[i] for f in found]) for i in range(3))
    slices = [(f[4], f[3]) for f in found]
    del found
    learned, at = at >= TRAIN, (at & ~TRAIN).astype(np.int32)
    kind, ctx = lex.kind[at], contexts(one, two)
    own = class_scores(one, ctx, kind, learned)
    own += outcome_scores(one.astype(np.uint64), ctx[1] >> np.uint64(24), kind, at, lex.base[at], learned)
    own, place = own / np.log(10) + lex.share[at], 0
    for base, row in slices:
        sums = np.bincount(row, weights=own[place:place + len(row)])
        held = np.flatnonzero(np.bincount(row))
        yield base, held, sums[held]
        place += len(row)


def score_texts(docs: DataFrame, held: tuple[int, int] = (7, 2), slice_bytes: int = 2_000_000) -> DataFrame:
    """Learn from the rows outside the held-out fold and score every row:
    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10).

    Null reads as the empty text, which is its end token alone; a null id counts as training.  Repeated
    rows are repeated in the result.  Without any training token every known count is 0.  ``docs`` is read
    three times and its rows are numbered by their place, so it must be a stored table or read alike every time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = stored(count_words(docs.filter(F.coalesce(fold("doc_id", held[0]) != held[1], F.lit(True)))), "word-counts")
    lex = lexicon(counts)
    sent = docs.sparkSession.sparkContext.broadcast(lex)
    numbered = docs.withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexi = sent.value
        for b in batches:
            for part in byte_slices(b, "text", slice_bytes):
                h, sizes = tokens_of(part.column("text"))
                at, head = lexi.find(h)
                seen = np.where(head, np.log10((lexi.counts[at] if len(lexi.names) else 0) + 1.0), 0.0)
                starts, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
                tail = np.flatnonzero(~head)
                offsets = np.concatenate([[0], np.searchsorted(tail, ends)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(sizes), pa.array(np.add.reduceat(head.astype(np.int64), starts)),
                     pa.array(np.add.reduceat(seen, starts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[tail].view(np.int64)))],
                    names=["doc_id", "row", "n_tokens", "n_head", "seen", "tail"])

    shape = T.StructType.fromDDL("doc_id long, row long, n_tokens long, n_head long, seen double, tail array<long>")
    texts = stored(numbered.mapInArrow(run, shape), "lm-rows")
    shards = 1 + texts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0] // SHARD

    def fit(table: pa.Table) -> pa.Table:
        bases, rows, sums = zip(*shard_scores(table, sent.value))
        return pa.table({"base": pa.array(bases, pa.int64()), "rows": pa.array([r.astype(np.uint16).tobytes() for r in rows], pa.binary()),
                         "sums": pa.array([x.astype(np.float32).tobytes() for x in sums], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        rows, sums = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("rows", np.uint16), ("sums", np.float32)))
        held = np.flatnonzero(np.bincount(rows))
        return pa.table({"row": held + table.column("base")[0].as_py(), "own": np.bincount(rows, weights=sums)[held]})

    own = (dealt(numbered, lex, shards, held).groupBy("shard").applyInArrow(fit, "base long, rows binary, sums binary")
           .groupBy("base").applyInArrow(gather, "row long, own double"))
    rare = (texts.select("row", F.explode("tail").alias("h")).join(counts, "h")
            .groupBy("row").agg(F.count("*").alias("n"), F.sum(F.log10(F.col("c") + 1.0)).alias("s")))
    known, seen = F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0.0))
    norm = float(np.log10(lex.total + lex.distinct + 1))
    return (texts.drop("tail").join(rare, "row", "left").join(own, "row")
            .select("doc_id", F.coalesce(fold("doc_id", held[0]) == held[1], F.lit(False)).alias("held_out"), "n_tokens",
                    (F.col("n_head") + known).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
                    (F.col("seen") + seen - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("own") + seen).alias("score")))
