"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character
inputs, trained in numpy, scoring all overlapping windows of a text.

A word enters as its hashed word vector plus the mean of its hashed character trigram vectors.  Only words of
``least_texts`` different labelled texts have a vector of their own, so that a word of one text cannot stand for
its label; the vector's first place starts as the log ratio of the shares of toxic and of clean texts that hold the word.  A text is read in windows of ``WIDTH`` words, each starting ``STRIDE`` after the one before, and its
score is that of its most toxic window.  In training the highest window of a clean text carries the gradient, and of
a toxic text one drawn in proportion to ``exp(logit)``: while nothing is learned any window may be the toxic one.

Tasks train on their part of a bounded sample and the driver averages parameters and moments between rounds, so
what travels is the model alone.  A fifth of the sample is never counted or trained on: rounds go on until its loss has not
fallen by ``gain`` for ``patience`` rounds, and the parameters with the least loss are the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import as_bytes, byte_slices, fold, stored
from listforge.llm.quality import sample_of_labels

WIDTH, STRIDE = 32, 16
WORDS, GRAMS, DIM, HIDDEN, SLOTS = 1 << 14, 1 << 11, 12, 8, 1 << 17
EDGE = b".,;:!?\"'()[]{}|*%$&#-_"


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"word": draw(WORDS, DIM, scale=0.02), "gram": draw(GRAMS, DIM, scale=0.05)}
    for side in "fb":
        p["w" + side] = draw(DIM, 3 * HIDDEN, scale=0.4)
        p["u" + side] = draw(HIDDEN, 3 * HIDDEN, scale=0.3)
        p["b" + side] = np.zeros(3 * HIDDEN, np.float32)
    p["att"] = draw(2 * HIDDEN, scale=0.3)
    p["out"] = draw(2 * HIDDEN, scale=0.5)
    p["bias"] = np.zeros(1, np.float32)
    p["known"] = np.ones(SLOTS, np.float32)  # which words, by hash, have a vector; never trained
    return p


def pack(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float32).tobytes()


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(raw, np.float32), {}, 0
    for k, like in sorted(fresh().items()):
        out[k] = flat[at:at + like.size].reshape(like.shape).copy()
        at += like.size
    return out


def named(bare: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, bare), np.int64, len(bare))


def spell(tokens: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the word, 0 if it is not known, hashed trigrams and the trigrams' owner of every token."""
    bare = [t.strip(EDGE) or t for t in tokens]
    h = named(bare)
    word = h % (WORDS - 1) + 1
    if known is not None:
        word = np.where(known[h % SLOTS] > 0, word, 0)
    line = np.frombuffer(b"\0" + b"\0".join(bare) + b"\0", np.uint8).astype(np.int64)
    centre = np.flatnonzero(line)
    grams = (line[centre - 1] * 1009 + line[centre] * 31 + line[centre + 1] * 7919) % GRAMS
    owner = np.repeat(np.arange(len(bare)), [len(t) for t in bare]) if bare else np.zeros(0, np.int64)
    return word, grams, owner


def embed(p: dict[str, np.ndarray], word: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.maximum(np.bincount(owner, minlength=len(word)), 1).astype(np.float32)
    sums = np.stack([np.bincount(owner, weights=p["gram"][grams, d], minlength=len(word)) for d in range(DIM)], 1)
    return p["word"][word] + (sums / counts[:, None]).astype(np.float32), counts


class Lexicon:
    """Rows of tokens seen so far; row 0 pads.  ``gates`` holds their input to both directions' gates."""

    def __init__(self, p: dict[str, np.ndarray] | None, most: int = 300_000):
        self.p, self.most = p, most
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.gates = {s: np.zeros((1, 3 * HIDDEN), np.float32) for s in "fb"}
        self.size = 1

    def read(self, texts: list[list[bytes]]) -> np.ndarray:
        """Row numbers of the words of all texts, one after the other."""
        if self.size > self.most:
            self.clear()
        rows, new = self.rows, []
        for text in texts:
            for t in text:
                if t not in rows:
                    rows[t] = len(rows) + 1
                    new.append(t)
        if new and self.p is not None:
            vectors, _ = embed(self.p, *spell(new, self.p["known"]))
            need = self.size + len(new)
            for s in "fb":
                if need > len(self.gates[s]):
                    self.gates[s] = np.concatenate([self.gates[s], np.zeros((2 * need - len(self.gates[s]), 3 * HIDDEN), np.float32)])
                self.gates[s][self.size:need] = vectors @ self.p["w" + s] + self.p["b" + s]
        self.size += len(new)
        return np.fromiter((rows[t] for text in texts for t in text), np.int64, sum(map(len, texts)))


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, position of its first word in all words); every text has at least one."""
    counts = np.maximum(1, -(-(sizes - WIDTH) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return owner, starts[owner] + (np.arange(len(owner)) - first[owner]) * STRIDE


def fill(rows: np.ndarray, sizes: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows of every window, padded with 0."""
    ends = np.cumsum(sizes)[owner]
    at = start[:, None] + np.arange(WIDTH)
    inside = at < ends[:, None]
    if not len(rows):
        return np.zeros(at.shape, np.int64)
    return np.where(inside, rows[np.minimum(at, len(rows) - 1)], 0)


def forward(p: dict[str, np.ndarray], x: dict[str, np.ndarray], held: np.ndarray, keep: bool = False):
    """Logits of windows.  ``x[side]`` is (WIDTH, windows, gates); ``held`` marks real words."""
    steps, n = held.shape
    states, kept = np.zeros((steps, n, 2 * HIDDEN), np.float32), {}
    for k, side in enumerate("fb"):
        u, h, log = p["u" + side], np.zeros((n, HIDDEN), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            gx, gh = x[side][t], h @ u
            zr = gx[:, :2 * HIDDEN] + gh[:, :2 * HIDDEN]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(gx[:, 2 * HIDDEN:] + r * gh[:, 2 * HIDDEN:])
            new = c + z * (h - c)
            if keep:
                log.append((t, h, z, r, c, gh[:, 2 * HIDDEN:]))
            h = new
            states[t, :, k * HIDDEN:(k + 1) * HIDDEN] = h
        kept[side] = log
    bent = np.tanh(states)
    e = np.where(held, bent @ p["att"], np.float32(-1e9))
    a = np.exp(e - e.max(0))
    a *= held
    a /= np.maximum(a.sum(0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", a, states)
    logit = pooled @ p["out"] + p["bias"][0]
    return (logit, (states, bent, a, pooled, kept)) if keep else logit


def backward(p, x, held, cache, dlogit, at, word, grams, owner, counts, vectors):
    """Gradients of all parameters; ``at`` is (WIDTH, windows) into the distinct words of the batch."""
    states, bent, a, pooled, kept = cache
    g = {"bias": np.array([dlogit.sum()], np.float32), "out": pooled.T @ dlogit, "known": np.zeros_like(p["known"])}
    dpool = dlogit[:, None] * p["out"]
    da = np.einsum("tnh,nh->tn", states, dpool)
    de = a * (da - (a * da).sum(0))
    g["att"] = np.einsum("tnh,tn->h", bent, de)
    dstate = a[:, :, None] * dpool + de[:, :, None] * p["att"] * (1 - bent * bent)
    dvec = np.zeros_like(vectors)
    for k, side in enumerate("fb"):
        u, du = p["u" + side], np.zeros_like(p["u" + side])
        dx, dh = np.zeros_like(x[side]), np.zeros((held.shape[1], HIDDEN), np.float32)
        for t, h, z, r, c, hc in reversed(kept[side]):
            dh = dh + dstate[t, :, k * HIDDEN:(k + 1) * HIDDEN]
            dz, dc = dh * (h - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
            dr = dc * hc * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dc], 1)
            dgh = np.concatenate([dz, dr, dc * r], 1)
            du += h.T @ dgh
            dh = dh * z + dgh @ u.T
        dx[~held] = 0
        flat = dx.reshape(-1, 3 * HIDDEN)
        summed = np.zeros((len(vectors) + 1, 3 * HIDDEN), np.float32)
        np.add.at(summed, at.ravel(), flat)
        summed = summed[1:]
        g["u" + side], g["b" + side] = du, summed.sum(0)
        g["w" + side] = vectors.T @ summed
        dvec += summed @ p["w" + side].T
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(g["word"], word, dvec)
    np.add.at(g["gram"], grams, (dvec / counts[:, None])[owner])
    return g


def best_windows(p: dict[str, np.ndarray], lexicon: Lexicon, texts: list[list[bytes]], batch: int = 4096,
                 drawn: np.ndarray | None = None, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(highest logit of each text, first word of that window); for texts marked in ``drawn`` a window drawn in
    proportion to ``exp(logit)`` takes the place of the highest."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = lexicon.read(texts)
    owner, start = windows(sizes)
    logits = np.empty(len(owner), np.float32)
    for i in range(0, len(owner), batch):
        seen = fill(rows, sizes, owner[i:i + batch], start[i:i + batch]).T
        logits[i:i + batch] = forward(p, {s: lexicon.gates[s][seen] for s in "fb"}, seen > 0)
    if drawn is not None:
        logits += np.where(drawn[owner], rng.gumbel(size=len(owner)), 0).astype(np.float32)
    first = np.searchsorted(owner, np.arange(len(texts)))
    best = np.maximum.reduceat(logits, first)
    order = np.lexsort((start, -logits, owner))
    return best, start[order][first] - np.concatenate([[0], np.cumsum(sizes)])[:-1]


class Adam:
    """Adam with decay of the weights; ``m`` and ``v`` live on from round to round."""

    def __init__(self, m: dict[str, np.ndarray], v: dict[str, np.ndarray], t: int, rate: float, decay: float):
        self.m, self.v, self.t, self.rate, self.decay = m, v, t, rate, decay

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k in p.keys() - {"known"}:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.005 * (g[k] * g[k] - self.v[k])
            p[k] -= self.rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.995 ** self.t)) + 1e-6)
            if k != "bias":
                p[k] *= 1 - self.rate * self.decay


def class_weights(ys: np.ndarray) -> np.ndarray:
    """Weights that give both classes the same sum."""
    ones = max(1, int((ys == 1).sum()))
    zeros = max(1, int((ys == 0).sum()))
    return np.where(ys == 1, len(ys) / (2 * ones), len(ys) / (2 * zeros)).astype(np.float32)


def local_round(p: dict[str, np.ndarray], adam: Adam, texts: list[list[bytes]], ys: np.ndarray, seed: int,
                updates: int = 60, fresh_after: int = 12, batch: int = 64) -> None:
    """At least ``updates`` steps, and at least one pass; windows are chosen anew at the start of a pass, but not
    before ``fresh_after`` steps with the last choice."""
    rng, share, until, chosen_at = np.random.default_rng(seed), class_weights(ys), adam.t + updates, -fresh_after
    while adam.t < until:
        if adam.t >= chosen_at + fresh_after:
            _, start = best_windows(p, Lexicon(p, 1 << 60), texts, drawn=ys == 1, rng=rng)
            chosen_at = adam.t
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            chosen = order[i:i + batch]
            parts = [texts[j][start[j]:start[j] + WIDTH] for j in chosen]
            lexicon = Lexicon(None)
            rows = lexicon.read(parts)
            sizes = np.array([len(t) for t in parts], np.int64)
            owner = np.arange(len(parts))
            at = fill(rows, sizes, owner, np.cumsum(sizes) - sizes).T
            spelled = spell(list(lexicon.rows), p["known"])
            vectors, counts = embed(p, *spelled)
            held = at > 0
            x = {}
            for s in "fb":
                gates = np.concatenate([np.zeros((1, 3 * HIDDEN), np.float32), vectors @ p["w" + s] + p["b" + s]])
                x[s] = gates[at]
            logit, cache = forward(p, x, held, keep=True)
            d = (share[chosen] * (1 / (1 + np.exp(-logit)) - ys[chosen]) / len(chosen)).astype(np.float32)
            g = backward(p, x, held, cache, d, at, *spelled, counts, vectors)
            g["word"][0] = 0
            adam.step(p, g)


def loss_of(p: dict[str, np.ndarray], texts: list[list[bytes]], ys: np.ndarray) -> tuple[float, float, int, int]:
    """Sums of the log loss over toxic and over clean texts, and their numbers."""
    if not texts:
        return 0.0, 0.0, 0, 0
    best, _ = best_windows(p, Lexicon(p, 1 << 60), texts)
    each = np.logaddexp(0, np.where(ys == 1, -best, best).astype(np.float64))
    return float(each[ys == 1].sum()), float(each[ys == 0].sum()), int((ys == 1).sum()), int((ys == 0).sum())


def round_of(sent: tuple[bytes, bytes, bytes], turn: int, steps: int, rate: float, decay: float):
    """One task's part of a round, from the parameters of the last round: their loss on the texts held back, then training."""

    def fit(table: pa.Table) -> pa.RecordBatch:
        found = sorted(zip(table.column("doc_id").to_pylist(), as_bytes(table.column("text").combine_chunks()), table.column("y").to_pylist()))
        back = np.array([held_back(t) for _, t, _ in found])
        texts, ys = [t.lower().split() for _, t, _ in found], np.array([y for *_, y in found], np.float32)
        p, m, v = map(unpack, sent)
        loss = loss_of(p, [t for t, b in zip(texts, back) if b], ys[back])
        used = [t for t, b in zip(texts, back) if not b]
        adam = Adam(m, v, steps, rate, decay)
        if used:
            local_round(p, adam, used, ys[~back], turn)
        columns = {"n": len(used), "steps": adam.t, "toxic": loss[0], "clean": loss[1], "n_toxic": loss[2], "n_clean": loss[3], "p": pack(p), "m": pack(m), "v": pack(v)}
        return pa.RecordBatch.from_pydict({k: [x] for k, x in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]
        if read:
            table = pa.Table.from_batches(read)
            for shard in sorted(set(table.column("shard").to_pylist())):
                yield fit(table.filter(pc.equal(table.column("shard"), shard)))

    return run


FITTED = "n long, steps long, toxic double, clean double, n_toxic long, n_clean long, p binary, m binary, v binary"


def held_back(text: bytes) -> bool:
    return xxhash.xxh32_intdigest(text) % 5 == 0


def with_ratios(p: dict[str, np.ndarray], sample: DataFrame, least_texts: int) -> dict[str, np.ndarray]:
    """The parameters with the known words of the sample and their log ratios.  Repeated texts count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y in zip(as_bytes(batch.column("text")), batch.column("y").to_pylist()):
                if not held_back(text):
                    h = np.unique(named([t.strip(EDGE) or t for t in [*text.lower().split(), b""]]))
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), int(y == 1)))], names=["h", "toxic"])

    words = (sample.groupBy("text").agg(F.max("y").alias("y")).mapInArrow(run, "h long, toxic long")
             .groupBy("h").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).filter(F.col("n") >= least_texts))
    found = np.array([(r.h, r.n, r.toxic) for r in words.collect()], np.int64).reshape(-1, 3)
    p["known"][:] = 0
    p["word"][0] = 0
    if len(found):
        h, n, toxic = found.T
        all_toxic, all_clean = toxic[n.argmax()], n.max() - toxic[n.argmax()]  # the empty word stands in every text
        ratio = np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((n - toxic + 0.5) / (all_clean + 1))
        p["known"][h % SLOTS] = 1
        p["word"][h % (WORDS - 1) + 1, 0] = ratio / 4
    return p


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held: tuple[int, int] = (5, 0), rows: int = 4000, shards: int = 4,
          rounds: int = 16, patience: int = 3, gain: float = 0.003, least_texts: int = 4, rate: float = 0.01, decay: float = 0.02) -> dict[str, np.ndarray]:
    """Learn from at most ``rows`` labelled texts of each class, none of the held-out fold, in ``shards`` tasks and
    at most ``rounds`` rounds; without any labelled text the fresh parameters come back with a bias that scores
    everything clean."""
    sample = stored(sample_of_labels(docs, labels, label, held, rows), "toxicity")
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
    dealt = stored(sample.select("*", shard).repartition(8 * shards, "shard"), "toxicity-shards")  # a file is one shard, read anew by every round
    p = with_ratios(fresh(), sample, least_texts)
    m, v, steps = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    best, least_loss, counted, waited = p, np.inf, np.inf, 0
    for turn in range(rounds + 1):
        fit = round_of((pack(p), pack(m), pack(v)), turn, steps, rate, decay)
        got = dealt.mapInArrow(fit, FITTED).collect()
        total = sum(r.n for r in got)
        if not total:
            p["bias"] -= 5
            return p
        loss = sum(sum(r[c] for r in got) / max(1, sum(r["n_" + c] for r in got)) for c in ("toxic", "clean")) / 2
        if turn:
            waited = 0 if loss < counted - gain else waited + 1
            counted = loss if not waited else counted
            if loss < least_loss:
                best, least_loss = p, loss
        if waited == patience:
            break
        p, m, v = ({k: sum(q[k] * r.n for q, r in zip(parts, got)).astype(np.float32) / np.float32(total) for k in p}
                   for parts in ([unpack(bytes(r[c])) for r in got] for c in "pmv"))
        steps = max(r.steps for r in got)
    return best


def score_toxicity(docs: DataFrame, p: dict[str, np.ndarray], held: tuple[int, int] = (5, 0), slice_bytes: int = 1_500_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.  Null and empty texts score by the bias alone; a null id
    is not held out, and has no label to learn from."""
    sent = docs.sparkSession.sparkContext.broadcast(pack(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpack(sent.value)
        lexicon = Lexicon(model)
        for batch in batches:
            for part in byte_slices(batch, "text", slice_bytes):
                best, _ = best_windows(model, lexicon, [t.lower().split() for t in as_bytes(part.column("text"))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(best.astype(np.float64), -30, 30))))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", held[0]) == held[1], F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, p: dict[str, np.ndarray], threshold: float = 0.5, slice_bytes: int = 1_500_000) -> DataFrame:
    """The rows whose score is below the threshold, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(pack(p))
    limit = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpack(sent.value)
        lexicon = Lexicon(model)
        for batch in batches:
            for part in byte_slices(batch, "text", slice_bytes):
                best, _ = best_windows(model, lexicon, [t.lower().split() for t in as_bytes(part.column("text"))])
                yield part.filter(pa.array(best < limit))

    return docs.mapInArrow(run, docs.schema)
