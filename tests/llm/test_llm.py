"""Document operators against brute force on small tables, and on rows that are easy to get wrong."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listforge.llm import (components, decontaminate, embedding_dedup, jaccard_join, line_dedup, lm_scoring, mixing, personal_data,
                           quality, token_counts, toxicity)
from listforge.llm.common import byte_slices, documents, shuffles_freed, stored

FOLDER = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"word{i}" for i in range(60))
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, h string, label string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, repeated ids, clashing column names."""
    rows = [(1, "a b c d e f\n" + PASSAGE + "\nend of one", "en", "s1"), (2, "other words here\n" + PASSAGE + "\ntail", "en", "s1"),
            (2, "other words here\n" + PASSAGE + "\ntail", "en", "s1"), (3, None, None, None), (4, "", "de", "s2"), (5, " \n\t ", "de", None),
            (6, "x", None, "s2"), (7, "word " * 60_000, "en", "s1"), (8, "é" * 5000, "fr", "s3"), (9, "word " * 60_000, "en", "s1"),
            (None, "null id text", "en", "s1"), (None, None, None, None), (10, "Same words Here now", "en", "s3"), (11, "same  words here\nNOW", "en", "s3")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1.0, "r", "h", None) for r in rows], SHAPE)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, FOLDER)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def empty(df):
    return df.sparkSession.createDataFrame([], df.schema)


def by_id(df):
    return {r[0]: r for r in df.collect()}


def words_of(text):
    return (text or "").encode().lower().split()


# --- token counts ------------------------------------------------------------------------------
def test_token_counts_equal_the_library(docs, odd, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path("piece_bpe_32k.model"))
    got = by_id(token_counts.count_tokens(docs))
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(model.encode(t)) for i, t in texts.items()}
    rows = token_counts.count_tokens(odd, limit=100)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows.collect()) == sorted(
        (r.doc_id or 0, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 100) for r in odd.collect())
    assert token_counts.count_tokens(empty(odd)).count() == 0


def test_pieces_of_awkward_texts():
    pieces = token_counts.load("piece_bpe_32k.model")
    assert pieces.by_word
    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", "\t", "▁", "é", "<s>", "the", "　", "\0", "<0x0A>", "😀", "\r\n", "ing"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert pieces.count(text) == len(pieces.model.encode(text)), repr(text)
    assert "".join(token_counts.segments("ab cd ef", 2)) == "abcdef"


def test_merges_file(docs, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))
    got = by_id(token_counts.count_tokens(docs.filter("doc_id < 20"), "byte_bpe_50k.json"))
    assert all(r.n_tokens == len(model.encode(texts[i], add_special_tokens=False)) for i, r in got.items())


def test_slices_are_balanced_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 5, 50, 1, 1)] + [None])], names=["text"])
    assert [p.num_rows for p in byte_slices(batch, "text", 10)] == [2, 1, 3]


# --- language-model scoring ---------------------------------------------------------------------
def test_base_score_and_counts(docs, texts):
    got = by_id(lm_scoring.score_texts(docs))
    tokens = {i: [*words_of(t), b"\n end"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    out = [i for i in texts if held[i]]
    assert sum(got[i].score for i in out) > sum(got[i].base_score for i in out)


def test_lm_scores_odd_rows(odd):
    rows = lm_scoring.score_texts(odd).collect()
    assert len(rows) == odd.count() and all(r.n_tokens >= 1 and r.score < 0 for r in rows)
    assert lm_scoring.score_texts(empty(odd)).count() == 0


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    table = rng.standard_normal((64, lm_scoring.SIDE)).astype(np.float32)
    rows, start = rng.integers(0, 64, (3, 5)).astype(np.uint16), rng.standard_normal((5, lm_scoring.SIDE)).astype(np.float32)
    total = sum(np.exp(lm_scoring.log_share(lm_scoring.logits(table, rows, start), np.full(5, k))) for k in range(lm_scoring.SIDE))
    assert np.allclose(total, 1, atol=1e-5)


def test_outcomes_of_a_context_sum_to_one():
    """The scores of all outcomes after each of some contexts, seen and unseen, asked for as tokens not learned from."""
    rng, size = np.random.default_rng(3), 40
    masses = rng.integers(1, 50, size).astype(float)
    kind = (np.arange(size) % 3).astype(np.uint8)
    base = np.log(masses / np.bincount(kind, weights=masses)[kind])
    one, two, at = rng.integers(0, 6, 3000), rng.integers(0, 6, 3000), np.minimum(rng.integers(0, size, 3000), rng.integers(0, size, 3000))
    asked = [(a, b, w) for a in range(7) for b in range(7) for w in range(size)]
    x, y, z = (np.concatenate([p, q]) for p, q in zip((one, two, at), np.array(asked).T))
    learned = np.arange(len(x)) < 3000
    got = lm_scoring.outcome_scores(x.astype(np.uint64), (x * 100 + y).astype(np.uint64), kind[z], z, base[z], learned)[3000:]
    sums = collections.Counter()
    for (a, b, w), v in zip(asked, got):
        sums[a, b, kind[w]] += math.exp(v)
    assert all(math.isclose(v, 1, abs_tol=1e-6) for v in sums.values())
    assert np.allclose(got[-size:], base)
    counts = collections.Counter(zip(one, at))
    often = max(counts, key=counts.get)
    assert np.mean([got[i] for i, (a, b, w) in enumerate(asked) if (a, w) == often]) > base[often[1]]


def test_lm_beats_a_bigram_on_held_out_texts(spark):
    """A discounted bigram reaches -3.51 a token on these held-out texts."""
    rows = lm_scoring.score_texts(documents(spark, "/root/testdata/sf0.01")).filter("held_out").collect()
    assert sum(r.score for r in rows) / sum(r.n_tokens for r in rows) >= -3.51


def test_lm_scores_do_not_hang_on_shards(spark, monkeypatch, docs):
    """Every text is scored in full however the tokens are dealt, hot words included."""
    whole = by_id(lm_scoring.score_texts(docs))
    monkeypatch.setattr(lm_scoring, "SHARD", 20_000)
    monkeypatch.setattr(lm_scoring, "HOT", 500)
    split = by_id(lm_scoring.score_texts(docs))
    assert whole.keys() == split.keys() and all(whole[i][:6] == split[i][:6] for i in whole)
    assert abs(sum(r.score for r in split.values()) / sum(r.score for r in whole.values()) - 1) < 0.1


# --- decontamination ----------------------------------------------------------------------------
def nearest(pattern, text):
    prev, best = list(range(len(pattern) + 1)), len(pattern)
    for ch in text:
        cur = [0]
        for i, p in enumerate(pattern):
            cur.append(min(prev[i + 1] + 1, cur[i] + 1, prev[i] + (p != ch)))
        prev, best = cur, min(best, cur[-1])
    return best


def test_edit_matching_equals_dynamic_programming():
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choices("abc ", k=n))
    for _ in range(300):
        items = [(k, draw(rng.randint(1, 25))) for k in range(4)]
        text = decontaminate.folded(draw(rng.randint(0, 60)))
        found = decontaminate.Matcher(items, 0.2).match(text)
        got = {i: min(d for j, d, _, _ in found if j == i) for i, *_ in found}
        want = {}
        for i, item in items:
            item = decontaminate.folded(item)
            if item and len(item) < 5:
                if f" {item} " in f" {text} ":
                    want[i] = 0
            elif item and text and (d := nearest(item, text)) <= int(len(item) * 0.2):
                want[i] = d
        assert got == want, (items, text)


def test_every_passage_and_word_bounds():
    item, rng = "the quick brown fox jumps over the lazy dog near the river", random.Random(5)
    for times in range(1, 6):
        text, places = "", []
        for _ in range(times):
            text += " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 30))) + " "
            places.append((len(text), len(text) + len(item)))
            text += item + " "
        for rate in (0.0, 0.06):
            assert decontaminate.Matcher([(1, item)], rate).match(text.strip()) == [(1, 0, a, b) for a, b in places]
    assert sorted(decontaminate.Matcher([(1, "cat"), (2, "a")], 0.06).match("concatenate cat a cat")) == [(1, 0, 12, 15), (1, 0, 18, 21), (2, 0, 16, 17)]
    assert len(decontaminate.Matcher([(1, "ab " * 10)], 0.06).match("ab " * 200)) >= 1


def test_leaks_are_found_with_their_places(spark):
    item = "The quick brown fox, jumps over the lazy dog near the river bank at noon."
    near = item.replace("brown", "browne").replace("lazy", "lzy").upper()
    docs = spark.createDataFrame([(1, "start " + item + " end"), (2, "İİ " + near), (3, "the quick brown fox sleeps"), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.matches(docs, bench).collect()}
    assert set(rows) == {1, 2} and rows[1].distance == 0 and rows[2].distance == 2
    assert docs.collect()[0].text[rows[1].start:rows[1].end] == item[:-1]
    assert {r.doc_id for r in decontaminate.without_matches(docs, bench).collect()} == {3, 4, 5}
    assert decontaminate.matches(docs, empty(bench)).count() == 0 and decontaminate.without_matches(empty(docs), bench).count() == 0


# --- Jaccard join -------------------------------------------------------------------------------
def linked(rows, k, percent):
    sets = {i: frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j:j + k]) for j in range(len(w) - k + 1)]) for i, t in rows for w in [words_of(t)]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x in ids:
        for y in ids:
            if x < y and min(len(sets[x]), len(sets[y])) * 100 >= percent * max(len(sets[x]), len(sets[y])):
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                    a, b = find(x), find(y)
                    root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_components_equal_brute_force(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_documents(docs, 4, 85).collect()}
    assert got == linked(texts.items(), 4, 85)


@pytest.mark.parametrize("small, tile", [(48, 256), (4, 8)])
def test_jaccard_groups_that_recurse(spark, monkeypatch, small, tile):
    """Chains and two groups that share most of a passage: regions need more than one pivot."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        words = base[:]
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(120)] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(base[i:i + 60])) for i in range(20)] + [(200, "a b"), (201, "A  b"), (202, "b a"), (203, None), (204, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == linked(rows, 4, 85)


def shuffle_bytes(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_stored_steps_leave_no_shuffle_files(spark):
    """The shuffles of all steps used to stay on disk until the driver collected garbage."""
    before = set(shuffle_bytes(spark))
    rows = stored(spark.range(200_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.count("*").alias("n")).join(spark.range(50_000).withColumnRenamed("id", "k").hint("merge"), "k"))
    jaccard_join.marks_of(rows.select(F.col("k").alias("sid")))
    for _ in range(100):
        left = {k: v for k, v in shuffle_bytes(spark).items() if k not in before}
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert rows.count() == 50_000


def test_shuffles_freed_keeps_the_setting(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for own in (None, "true", "false"):
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)
        with shuffles_freed(spark):
            assert spark.conf.get(name) == "true"
        assert spark.conf.get(name, None) == own
    spark.conf.unset(name)


def test_sets_that_meet_many_others_by_chance_go(spark):
    """Sets 1-4 of 100 shingles (c = 4) meet each other in one or two regions a pair; 10 and 11 in four; 20 and 21 in
    three and a large one, which counts for any pair; 30 and 31 in four, but of sizes that cannot be linked."""
    rows = [(f"{a}-{b}-{i}", s, 100) for a in range(1, 5) for b in range(a + 1, 5) for i in range(2) for s in (a, b)]
    rows += [(f"x{i}", s, 100) for i in range(4) for s in (10, 11)] + [(f"y{i}", s, 100) for i in range(3) for s in (20, 21)]
    rows += [("hot", s, 100) for s in (20, 21, *range(40, 60))] + [(f"z{i}", s, n) for i in range(4) for s, n in ((30, 50), (31, 100))]
    df = spark.createDataFrame(rows, "name string, sid long, n int").select(F.xxhash64("name").alias("key"), "sid", "n")
    rows = df.join(jaccard_join.shared_keys(df), "key")
    assert {r.sid for r in jaccard_join.with_partner(rows, 85).collect()} == {10, 11, 20, 21}


def test_jaccard_texts_of_shared_pieces(spark):
    """Every pair of 24 texts shares a passage, as in a corpus of few words; 3 are near copies of others."""
    piece = {(a, b): [f"p{a}.{b}.{i}" for i in range(12)] for a in range(24) for b in range(a + 1, 24)}
    texts = [[w for (a, b), p in piece.items() if k in (a, b) for w in p] for k in range(24)]
    texts += [texts[0][:-9] + ["other"], texts[7][12:], texts[9][:100] + ["new"] + texts[9][100:]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in jaccard_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == {**{k: k for k in range(24)}, 24: 0, 25: 7, 26: 9}
    kept = jaccard_join.regions(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert kept.select("sid").distinct().count() == 6


def test_jaccard_odd_rows(odd):
    rows = jaccard_join.join_documents(odd).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count() and found[9].component_id == 7 and found[11].component_id == 10 and found[3].n_shingles == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 3, 4, 5, 6, 7, 8, 10}
    assert jaccard_join.join_documents(empty(odd)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


# --- embeddings ---------------------------------------------------------------------------------
def test_embedding_links_and_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((150, 64))
    x = np.concatenate([centres, centres[:60] + 0.2 * rng.standard_normal((60, 64)), centres[:20], np.repeat(centres[:1], 30, 0) + 0.02 * rng.standard_normal((30, 64))])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] + [1.0] * 63, 1), (1003, [None] + [1.0] * 63, 1), (1004, [], None), (1005, [2.0 * v for v in rows[5][1]], 1), (None, rows[0][1], 1)]
    got = {r.vec_id: r for r in embedding_dedup.dedup(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()}
    y = np.array([r[1] for r in rows] + [odd[5][1]])
    ids = [*range(len(rows)), 1005]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    assert sum(got[i].n_links for i in ids) >= 0.9 * near.sum() and all(got[i].n_links <= n for i, n in zip(ids, near.sum(1)))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1005)) and got[None].n_links == 0
    assert got[1005].component_id == got[5].component_id and len(got) == len(rows) + len(odd)
    assert embedding_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_tiles_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1, 32)) + 0.05 * rng.standard_normal((90, 32))
    got = embedding_dedup.dedup(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert all(r.component_id == 0 and r.n_links == 89 for r in got)


# --- classifiers --------------------------------------------------------------------------------
def test_toxicity_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh().items()}
    texts = [[b"alpha", b"beta,", b"gamma"], [b"delta"] * 5, []]
    lex = toxicity.Lexicon(None)
    rows, sizes = lex.read(texts), np.array([3, 5, 0])
    at = toxicity.fill(rows, sizes, np.arange(3), np.cumsum(sizes) - sizes).T
    spelled, y = toxicity.spell(list(lex.rows)), np.array([1.0, 0.0, 1.0])

    def loss(keep=False):
        vectors, counts = toxicity.embed(p, *spelled)
        x = {s: np.concatenate([np.zeros((1, 3 * toxicity.HIDDEN)), vectors @ p["w" + s] + p["b" + s]])[at] for s in "fb"}
        logit, cache = toxicity.forward(p, x, at > 0, keep=True)
        if keep:
            return toxicity.backward(p, x, at > 0, cache, 1 / (1 + np.exp(-logit)) - y, at, *spelled, counts, vectors)
        return float(np.sum(np.log1p(np.exp(logit)) - y * logit))

    grads = loss(True)
    for name in p:
        flat, g = p[name].reshape(-1), grads[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(g) if g.any() else np.arange(len(flat)), 3):
            old, eps = flat[i], 1e-2
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * eps) - g[i]) < 2e-3 + 0.05 * abs(g[i]), name


def test_windows_cover_a_text():
    owner, start = toxicity.windows(np.array([0, 5, 32, 33, 100]))
    assert owner.tolist() == [0, 1, 2, 3, 3, *[4] * 6] and start.tolist()[-1] + toxicity.WIDTH >= 0 + 5 + 32 + 33 + 100


def test_toxic_words_are_learned(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        words = [rng.choice("red blue green house river stone walk talk sing".split()) for _ in range(rng.randint(5, 120))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["vilebad,", "nastyone"])
        rows.append((i, " ".join(words), i % 4 == 0))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id long, toxic int")
    p = toxicity.train(docs, labels)
    got = by_id(toxicity.score_toxicity(docs, p))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out == (r in held) for r in rows)
    assert sum(got[i].predicted == int(t) for i, _, t in held) >= 0.95 * len(held)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, p).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}


def test_few_toxic_labels_are_enough(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).filter("held_out").join(labels.filter("toxic in (0, 1)").select("doc_id", "toxic"), "doc_id")
    rows = scored.collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert sum(toxic) > len(toxic) / 2 and sum(clean) <= 0.02 * len(clean)


def test_text_score_is_that_of_its_best_window():
    rng = random.Random(3)
    p = toxicity.fresh()
    texts = [[rng.choice(["red", "blue,", "stone", "vile"]).encode() for _ in range(n)] for n in (0, 1, 32, 33, 50, 130)]
    best, _ = toxicity.best_windows(p, toxicity.Lexicon(p), texts, batch=3)
    for text, got in zip(texts, best):
        starts = range(0, max(1, len(text) - toxicity.WIDTH + toxicity.STRIDE), toxicity.STRIDE)
        alone = [toxicity.best_windows(p, toxicity.Lexicon(p), [text[s:s + toxicity.WIDTH]])[0][0] for s in starts]
        assert abs(max(alone) - got) < 1e-4


def test_classifiers_on_odd_rows(odd, docs, labels):
    p, w = toxicity.train(odd, labels, rounds=1), quality.train(docs, labels)
    for df in (toxicity.score_toxicity(odd, p), quality.score_quality(odd, w)):
        rows = df.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in rows)
    once, twice = (quality.sample_of_labels(d, labels, "quality", (3, 1), 50) for d in (docs, docs.union(docs)))
    assert sorted(once.collect()) == sorted(twice.collect())
    assert toxicity.without_toxic(odd, toxicity.train(odd, empty(labels))).columns == odd.columns
    assert toxicity.score_toxicity(empty(odd), p).count() == quality.score_quality(empty(odd), w).count() == 0
    assert quality.train(odd, empty(labels)).any() == np.False_


def test_quality_on_held_out_rows(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score_quality(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


# --- personal data ------------------------------------------------------------------------------
def luhn(d):
    return sum(v - 9 if v > 9 else v for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def spans_of(x):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end(), "card")] * (12 <= len(d) <= 19 and luhn(d))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data_equals_patterns(spark):
    rng = random.Random(7)
    parts = ["a", "b@", "@", ".", "a.b", "1", "12", "4539", "1488", "0343", "6467", " ", "-", "+", "+49", "(", ")", "😀", "é", "", "_", "x@y.z", "10.0.0.1", "300",
             "255.", "\n", "card 4111 1111 1111 1111", "4111-1111-1111-1111 ", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 14)))) for i in range(3000)] + [(-1, None), (-2, "")]
    for r in personal_data.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = spans_of(dict(rows)[r.doc_id] or "")
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[3] == k for w in want) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("iban")] == [s for s in base.split(",") if s]


def test_long_runs_do_not_overflow(spark, odd):
    rows = [(1, "1" * 100_000), (2, "1 " * 100_000), (3, "a" * 100_000 + "@b.c"), (4, "a@b" + ".c" * 100_000), (5, "+1" + "(" * 100_000)]
    got = by_id(personal_data.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].n_email for i in range(1, 6)] == [0, 0, 1, 1, 0]
    assert personal_data.digest(odd).count() == odd.count() and personal_data.digest(empty(odd)).count() == 0


def test_checksums_and_context(spark):
    text = "my iban GB82WEST12345698765432 or GB83WEST12345698765432, ip 10.0.0.1"
    spans = personal_data.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [(s.kind, text[s.start:s.end]) for s in spans] == [("iban", "GB82WEST12345698765432"), ("ip", "10.0.0.1")]
    assert spans[0].score == 1.0 and spans[1].score == 0.8
    rows = [(1, text), (2, "x" * 60 + " 10.0.0.1 then call +49 30 1234567"), (3, "10.0.0.1"), (4, None)]
    got = by_id(personal_data.digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [(got[i].scores, got[i].n_likely) for i in (1, 2, 3, 4)] == [("100,80", 2), ("60,70", 0), ("60", 0), ("", 0)]


# --- line de-duplication ------------------------------------------------------------------------
def test_longest_run_in_order():
    rng = random.Random(8)
    for _ in range(200):
        ys = rng.sample(range(50), rng.randint(0, 9))
        got = line_dedup.in_order(list(enumerate(ys)))
        best = max((len(c) for m in range(1 << len(ys)) for c in [[y for i, y in enumerate(ys) if m >> i & 1]] if c == sorted(c)), default=0)
        picked = [ys[i] for i in got]
        assert picked == sorted(picked) and len(picked) == best


def test_units_cover_the_text():
    text = ("One two. Three four! " * 30 + "\n\nshort line\r\n" + "x" * 10).encode()
    parts = line_dedup.units(text)
    assert b"".join(text[a:b] for a, b, _ in parts) == text and line_dedup.remove(text, []) == text and len(parts) == 60 + 4


def test_repeated_passages_go_from_the_later_text(odd):
    rows = line_dedup.cut_lines(odd, 25)
    got = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == odd.count()
    assert got[1].n_cut == 0 and got[2].text == "other words here\ntail" and got[2].cut_words == 60 and got[2].earlier == [1]
    assert got[7].n_cut == 0 and got[9].text == "" and got[3].text is None and got[4].text == ""
    kept = line_dedup.without_repeats(odd, 25)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    assert {r.doc_id: r.n_chars for r in kept.collect()}[2] == len("other words here\ntail")
    assert line_dedup.cut_lines(empty(odd)).count() == 0


def test_passages_inside_lines_and_moved_blocks(spark):
    rng = random.Random(9)
    sentence = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)).capitalize() + "."
    a, b = [sentence() for _ in range(5)], [sentence() for _ in range(5)]
    rows = [(1, "\n".join(a + b)), (2, " ".join([sentence(), *a, sentence()])), (3, "\n".join([*b, "between", *a])), (4, a[0] + "\nfree text"), (5, sentence())]
    got = {r.doc_id: r for r in line_dedup.cut_lines(spark.createDataFrame(rows, "doc_id long, text string"), 25).collect()}
    assert got[1].n_cut == 0 and got[5].n_cut == 0 and got[4].n_cut == 0
    assert not any(s in got[2].text for s in a) and got[2].n_cut == 5 and got[3].text == "between\n"


def plain_cuts(rows, m=25):
    """Places of the words that stand in a window of ``m`` words that an earlier row (id, text) holds, by id."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        own = [tuple(w[k:k + m]) for k in range(len(w) - m + 1)]
        out[i] = {k + j for k, x in enumerate(own) if x in seen for j in range(m)}
        seen |= set(own)
    return out


def test_cuts_equal_brute_force(spark, docs, texts):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [[word() for _ in range(rng.randint(20, 120))] for _ in range(12)]
    rows = list(texts.items())
    for i in range(60):
        parts = [base[i]] if i < 12 else [p[a:a + rng.randint(10, 60)] for p in rng.choices(base, k=3) for a in [rng.randrange(len(p))]]
        rows.append((10 ** 6 + i, " ".join(w + rng.choice(["", "", ".", "\n"]) * (i < 12) for p in parts for w in p)))
    got = {r.doc_id: r for r in line_dedup.cut_lines(spark.createDataFrame(rows, "doc_id long, text string"), 25).collect()}
    for i, gone in plain_cuts(rows).items():
        words = (dict(rows)[i] or "").encode().split()
        assert got[i].text.encode().split() == [w for k, w in enumerate(words) if k not in gone] and got[i].cut_words == len(gone), i


def test_copy_whose_lines_stand_apart_in_earlier_texts(spark):
    """As 2440 and 1978 of sf0.1: every line of a copy has an earlier holder in another order; the copy still goes."""
    rng = random.Random(11)
    lines = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(10)) + "." for _ in range(15)]
    rows = [(1, "\n".join(reversed(lines))), *((2 + i, f"free {i}\n{line}") for i, line in enumerate(lines)), (30, "\n".join(lines)), (31, "\n".join(lines)), (32, "start\n" + "\n".join(lines))]
    got = {r.doc_id: r for r in line_dedup.cut_lines(spark.createDataFrame(rows, "doc_id long, text string"), 25).collect()}
    assert got[30].n_cut == 0 and got[31].text == "" and got[31].cut_words == 150 and got[31].earlier == [30] and got[32].text == "start\n"
    big = documents(spark, "/root/testdata/sf0.1")
    wide = {r.doc_id: r for r in line_dedup.cut_lines(big.filter("doc_id <= 2440"), 25).collect()}
    assert wide[2440].text == "" and wide[2440].cut_words == 150


def test_passages_within_sentences(spark):
    """Passages that start and end within a sentence, in lines of any length, go to the word."""
    rng = random.Random(12)
    some = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    shared, short, mine = some(55), some(24), [some(7) for _ in range(6)]
    rows = [(1, f"{some(9)} {shared} {some(9)}"), (2, f"{mine[0]} {shared}, {mine[1]}".replace(",", "")), (3, f"{mine[2]}. {mine[3]}\n{shared.replace(' ', chr(10), 3)} {mine[4]}"),
            (4, f"{some(3)} {short} {some(3)}"), (5, f"{mine[5]} {short}")]
    got = {r.doc_id: r for r in line_dedup.cut_lines(spark.createDataFrame(rows, "doc_id long, text string"), 25).collect()}
    assert got[2].text == f"{mine[0]} {mine[1]}" and got[2].cut_words == 55 and got[3].text == f"{mine[2]}. {mine[3]}\n{mine[4]}"
    assert got[1].n_cut == got[4].n_cut == got[5].n_cut == 0


def test_pieces_of_several_texts_are_no_block(spark):
    """As 4321 and 5332 of sf0.1: lines that several texts hold singly, or one text holds apart, stay."""
    rng = random.Random(13)
    some = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(10)) + "."
    lines = [some() for _ in range(4)]
    rows = [*((i, f"{line}\n{some()}") for i, line in enumerate(lines)), (8, "\n".join(x for line in lines for x in (line, some()))), (9, "\n".join(lines)),
            (10, "\n".join([lines[0], "one unit between", *lines[1:3]]))]
    got = {r.doc_id: r for r in line_dedup.cut_lines(spark.createDataFrame(rows, "doc_id long, text string"), 25).collect()}
    assert all(got[i].n_cut == 0 and got[i].text == t for i, t in rows)


# --- mixing -------------------------------------------------------------------------------------
def test_mixture_keeps_budget_and_limit(docs, odd):
    rows = mixing.mix_sources(docs, max_repeats=1.25).collect()
    total = {}
    for r in mixing.counted(docs).collect():
        total[r.source] = total.get(r.source, 0) + r.n_tokens
    used = collections.Counter()
    for r in rows:
        used[r.source] += r.n_tokens
    assert all(used[s] <= 1.25 * n + 1 for s, n in total.items()) and sum(used.values()) <= sum(total.values())
    assert max(collections.Counter((r.doc_id, r.epoch) for r in rows).values()) == 1
    assert mixing.mix_sources(odd).count() > 0 and mixing.mix_sources(empty(odd)).count() == 0


def test_exponent_meets_entropy(spark):
    sources = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10), ("d", 0)], "source string, tokens long")
    a = mixing.exponent(sources, 1000, 1000, None, 1.2)
    entropy = mixing.figures(sources, [a, a + 2.0 ** -mixing.STEPS], 1000, 1000)
    assert entropy[a][0] >= 1.2 > entropy[a + 2.0 ** -mixing.STEPS][0]
    assert mixing.exponent(sources, 1000, 1000, None, None) == 1.0 and mixing.exponent(sources, 1000, 1000, None, 9.0) == 0.0
    limit = mixing.exponent(sources, 1000, 1000, 3.0, None)
    seen = mixing.figures(sources, [limit, limit - 2.0 ** -mixing.STEPS], 1000, 1000)
    assert seen[limit][1] <= 3.0 < seen[limit - 2.0 ** -mixing.STEPS][1]


@pytest.mark.parametrize("name", ["op4_jaccard_join", "op7_personal_data", "op10_mixing"])
def test_query_equals_sql(spark, name):
    from check import compare, duck_connection

    from listforge.llm import queries

    message, _, good = compare(spark, duck_connection(FOLDER), name, queries.QUERIES[name], queries.ORACLES[name], FOLDER)
    assert good, message


# --- pipeline -----------------------------------------------------------------------------------
def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "mixing"]
    docs = documents(spark, FOLDER)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "mixing":
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = spark.createDataFrame(out.collect(), out.schema)
        odd_out = stage(spark, odd, FOLDER)
        assert odd_out.count() > 0 and (name == "mixing" or odd_out.columns == odd.columns)
        assert stage(spark, empty(odd), FOLDER).count() == 0
    found = {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert not found and all(i == c[1] for i, c in linked([(r.doc_id, r.text) for r in docs.collect()], 5, 80).items())
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def test_emptied_copies_go_and_repeated_ids_stay(spark):
    import corpus_pipeline

    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(4)]
    shape = "doc_id long, text string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], shape)
    copies = frame([(1, own[0]), (2, own[0]), (3, ""), (4, None), (5, "head " + own[0]), (1, own[0])])
    got = corpus_pipeline.cut_repeated_lines(spark, copies, FOLDER).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, own[0]), (1, own[0]), (3, ""), (4, ""), (5, "head ")]
    rows = [(1, own[0]), (2, own[0] + " tail"), (2, own[1]), (3, own[1] + " end"), (4, own[2]), (4, own[2] + " more"), (None, own[2]), (None, own[3]), (5, ""), (6, None), (1, own[0])]
    got = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(frame(rows), 5, 80).collect()]
    assert {x for x in got if x[0] != 4} == {(1, own[0]), (2, own[1]), (None, own[3]), (5, ""), (6, None)}
    assert got.count((1, own[0])) == 2 and sum(i == 4 for i, _ in got) == 1
