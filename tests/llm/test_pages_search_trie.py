"""Main text of pages, ranked search and the conversation trie against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from listforge.llm import embedding_dedup, html_consensus, lexical_search, line_dedup, prefix_trie
from listforge.llm.html_consensus import Page


def empty(df):
    return df.sparkSession.createDataFrame([], df.schema)


# --- main text of pages ----------------------------------------------------------------------------
def page(body, head="<title>T &amp; t</title><style>p{x:1}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body class='no-sidebar'>{body}</body></html>"


FRAME = ("<header class='site'><h2>Site</h2><a href=/>Home</a></header><nav><ul><li><a>A</a><li><a>B</a></ul></nav>{}<div class='sidebar'>Side words</div>"
         "<section id='comments'><article class='comment'><p>Reader says a lot of words, many more than the page has itself.</p></article></section>"
         "<form><p>Sign up</p></form><div role='dialog'>Cookies?</div><script>var t='</p>';</script><footer>&copy; us</footer>")


@pytest.mark.parametrize("body, want", [
    ("<article><h1>A</h1><p>One\n two&nbsp;three.</p><p>Four &lt;b&gt; &amp;amp; &#x41;&eacute;</p></article>", "A\nOne two three.\nFour <b> &amp; Aé"),
    ("<article><header><h1>A</h1><p>by me</p></header><p>One<br>two<p>three<b>four<p>five</article>", "A\nOne two\nthreefour\nfive"),
    ("<article><p>One</p><div class='ad'>Buy</div><aside>x</aside><p>Two <span class=ads>now</span>three</p><ul><li>k<li>l</ul></article>", "One\nTwo three\nk\nl"),
    ("<div class='wrap'><h1>A</h1><div class='post-content'><p>Some words of the text.</p><p>And some more, a bit longer.</p></div></div>",
     "A\nSome words of the text.\nAnd some more, a bit longer."),
    ("<main><p>x <a>y</a> z</p><table><tr><td>1<td>2</table><blockquote>q</blockquote><pre>a\n  b</pre></main>", "x y z\n1\n2\nq\na b"),
    ("<main class='has-menu'><p>Text 1 < 2 and 3 > 2</p><div hidden>no</div><div style='display: none'>no</div></main>", "Text 1 < 2 and 3 > 2"),
    ("<article><p title='a>b' data-x=\"it's\">quoted</p><p class=x/>bare<!-- c > --><!----></article>", "quoted\nbare"),
    ("<article><div>one<p>two</p>three</div></div><p>four</p></article>", "one\ntwo\nthree\nfour"),
])
def test_main_text_of_one_page(body, want):
    assert Page(page(body)).extract({}) == want
    assert Page(page(FRAME.format(body))).extract({}) == want


def test_pages_without_shape():
    assert Page("plain words &amp; more").extract({}) == "plain words & more"
    assert Page("<article><p>cut &am").extract({}) == "cut &am"
    assert Page("<article><p>cut <b").extract({}) == "cut"
    assert Page("<article><p>cut</p><script>var").extract({}) == "cut"
    assert Page("<nav>only</nav>").extract({}) == ""
    assert Page("<article>" + "<div>" * 3000 + "deep" + "<b>" * 3000).extract({}) == "deep"
    assert Page("<article>" + "<p>w " * 20_000).extract({}).count("\n") == 19_999
    assert Page("<article><p class='never closed>x</p></article>").extract({}) == "x"


def test_container_paths_win_by_host(spark):
    text = "<p>The words of the article, of some length, come here.</p>" * 3
    junk = "<div class='box'><p>" + "Long words about something else, longer than the article itself. " * 12 + "</p></div>"
    rows = [(i, f"https://H.example/{i}", page(f"<div class='c{i}'>{text}</div>"), "x") for i in range(12)]
    rows += [(20, "https://h.example/20", page(f"<div class='c7'>{text}</div>{junk}"), "x"), (21, "https://other.example/", page(f"<div class='c7'>{text}</div>{junk}"), "x"),
             (22, None, page(f"<div>{text}</div>"), None), (23, "no host", None, None), (24, "https://h.example", "", None), (None, "https://h.example", page(f"<div class=c2>{text}</div>"), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    pages = pages.unionByName(pages.filter("page_id = 0"))
    want = "\n".join(["The words of the article, of some length, come here."] * 3)
    got = [(r.page_id, r.text) for r in html_consensus.digest(pages).collect()]
    assert len(got) == 19 and got.count((0, want)) == 2 and (None, want) in got
    got = dict(got)
    assert got[20] == want and got[21].startswith("Long words") and got[22] == want and got[23] == got[24] == ""
    votes = html_consensus.vote(pages)
    assert sorted((r.host, r.votes) for r in votes.collect()) == [("h.example", 1), ("h.example", 14), ("other.example", 1)]
    assert html_consensus.digest(empty(pages)).count() == 0


# --- ranked search ---------------------------------------------------------------------------------
def ranked(docs, items, best):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    held = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = collections.Counter(x for _, t in held for x in set(t))
    out = {}
    for item, terms in items.items():
        scores = []
        for doc_id, words in held:
            tf, score = collections.Counter(words), 0
            for x in {x for t in terms for x in split(t)} & set(tf):
                m = 100 - 50 + (50 * len(words) * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 20 * m))
            if score:
                scores.append((-score, doc_id is None, doc_id or 0))
        out[item] = [(k + 1, None if gone else d, -s) for k, (s, gone, d) in enumerate(sorted(scores)[:best])]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("shard, group", [(16_384, 256), (16, 2)])
def test_search_equals_brute_force(spark, monkeypatch, shard, group):
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    monkeypatch.setattr(lexical_search, "GROUP", group)
    monkeypatch.setattr(lexical_search, "SHARES", (0.05, 0.2, 0.5))
    rng = random.Random(4)
    words = ["common", "Word"] * 6 + [f"w{i}" for i in range(60)] + ["été", "ÉTÉ", "x-y", "a_b", "日本"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(150)]
    docs += [docs[3], docs[3], (3, "common w1 w2"), (None, docs[5][1]), (None, "w1 w2 common"), (900, None), (901, ""), (902, " -_- "), (903, "word " * 30_000 + "w3")]
    items = {i: [" ".join(rng.choices(words, k=rng.randint(1, 12)))] for i in range(12)} | {50: ["nowhere"], 51: [""], 52: [None], None: ["w1 common"], 53: ["w1", "w2 w1"]}
    table = spark.createDataFrame([(d, t, "s", 1) for d, t in docs], "doc_id long, text string, item string, rank int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, ts in items.items() for t in ts], "item_id long, text string, row int")
    got = collections.defaultdict(list)
    for r in sorted(lexical_search.search(table, asked, best=7).collect(), key=lambda r: r.rank):
        got[r.item_id].append((r.rank, r.doc_id, r.score))
    assert got == ranked(docs, items, 7)
    assert lexical_search.search(empty(table), asked).count() == 0
    assert lexical_search.search(table, empty(asked)).count() == 0


# --- conversation trie -----------------------------------------------------------------------------
def test_parentheses_close_where_they_should():
    rng = random.Random(1)
    for n in (*range(1, 40), 700, 5000):
        for p in (0.1, 0.5, 0.95):
            bits, depth, count = [1], 1, 1
            while count < n:
                down = depth > 1 and rng.random() > p
                bits.append(0 if down else 1)
                depth, count = depth + (-1 if down else 1), count + (not down)
            bits += [0] * depth
            stack, want = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    want[stack.pop()] = i
            bits = np.array(bits, np.uint8)
            opens = np.flatnonzero(bits)
            for block in (4, 64):
                assert prefix_trie.Parens(bits, block).find_close(opens).tolist() == [want[i] for i in opens]


def nodes_of(rows):
    """The nodes by plain counting over all prefixes."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(turns.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    saving = {p: (len(m) - 1) * (len(p[-1][1].encode().split()) if p else 0) for p, m in members.items()}
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in below), sum(saving[q] for q in below),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(7)
    texts = ["hi", "hello there you", "", None, "a b  c\nd", "x " * 300]
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(texts)) for c in range(120) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", "same words here") for c in range(200, 260) for t in range(3)]
    rows += [(300, None, "user", "first"), (300, 1, "bot", "tie"), (300, 1, "bot", "other tie"), (300, 1, "bot", "tie"), (None, 1, "user", "lost"), (7, 3, None, None)]
    return rows + [(400, t, "user", f"turn {t}") for t in range(150)]


@pytest.mark.parametrize("shards", [None, 1, 3, 40])
def test_trie_equals_plain_counting(spark, talk, shards):
    table = spark.createDataFrame([(*r, "n", "p") for r in talk], "conv_id long, turn long, role string, text string, node string, parent string").repartition(4)
    paths = prefix_trie.with_shared_heads(prefix_trie.turns_of(table))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted((tuple(r) for r in prefix_trie.trie(paths, shards).select(*columns).collect()), key=str)
    assert got == nodes_of(talk)


def test_trie_of_little(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert prefix_trie.digest(spark.createDataFrame([], shape)).count() == 0
    assert prefix_trie.digest(spark.createDataFrame([(None, 1, "a", "b")], shape)).count() == 0
    lone = next(c for c in itertools.count(1) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0)
    only = prefix_trie.digest(spark.createDataFrame([(lone, 1, "a", "b")], shape)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in only] == [(lone, 0, 1, 0, 1, 0)]
    assert only[0].ends_sha256 == hashlib.sha256(str(lone).encode()).hexdigest()


# --- odd rows of two earlier operators -----------------------------------------------------------
def test_vectors_of_several_lengths_link_within_their_length(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for size, n in ((8, 60), (5, 40), (3, 1), (1, 4)):
        base = rng.standard_normal((max(1, n // 4), size))
        for i in range(n):
            rows.append((at, [float(x) for x in base[i % len(base)] + rng.standard_normal(size) * 0.03]))
            at += 1
    rows += [(at, None), (at + 1, []), (at + 2, [0.0] * 5), (at + 3, [None] * 8), (None, rows[0][1])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), 0.95).collect() if r.vec_id is not None}
    use = {i: np.array(v) for i, v in rows[:at]}
    links = {(i, j) for i in use for j in use if i < j and len(use[i]) == len(use[j]) and use[i] @ use[j] / np.sqrt((use[i] @ use[i]) * (use[j] @ use[j])) >= 0.95}
    root = {i: i for i, _ in rows if i is not None}
    for _ in rows:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    found = sum(n for n, _, _ in got.values()) / 2
    assert 0.9 * len(links) <= found <= len(links)
    assert sum(got[i][1] == root[i] for i in root) >= 0.9 * len(root) and {got[i] for i in range(at, at + 4)} == {(0, i, True) for i in range(at, at + 4)}


def test_a_null_id_is_the_latest_document(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(None, passage + " zz"), (5, passage), (9, "head " + passage)]
    got = {r.doc_id: (r.cut_words, r.text) for r in line_dedup.cut_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: (0, passage), 9: (60, "head"), None: (60, "zz")} or got == {5: (0, passage), 9: (60, "head "), None: (60, "zz")}
