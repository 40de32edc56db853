"""Main text of web pages by consensus on container paths within a host.

A page is read once for its elements and pieces of text.  Text in menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments is marked, by element name, role or class and id words.  The
text left over gives scores to the containers around it: all of it to ``article`` and ``main``, that of their own
paragraphs, and half that of their children's, to others.  The best container of a page is one vote for its path,
the generalised element names and classes from the root down (digits become #, words of state are left out).
Spark adds up the votes of each host; paths with ``SHARE`` of them win.  In the second pass a page gives the text
of the winning path that weighs most there, by score and votes, or of its own best container where no winner occurs.

Votes are added up in each task before they are shuffled, and a host keeps at most 1 / ``SHARE`` winners, so a host
with a third of all pages costs no more than another.  Pages meet the winners of their host in a join that Spark
broadcasts only while the table of winners is small.

Null and empty html give ''.  Pages without markup give their whole text.  Null urls, and urls without a host,
belong to no host and go by their own containers.  Elements cut off at the end of a page are read as far as they
go, a tag without its end is dropped.  Repeated rows are repeated.  An empty table gives none.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listforge.llm.common import byte_slices, stored

SHARE = 0.05
# Element names and words of class names with a meaning in HTML pages.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th
thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("""nav footer aside form script style noscript template iframe button select textarea dialog menu head object svg math canvas
audio video title noembed noframes search datalist map""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "head", "body", "html", "legend", "title"}
SCOPES = frozenset("html table td th caption object template".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"})}
MARKS = frozenset("""nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement
advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay
newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies
widget widgets toolbar pagination pager copyright""".split())
HEADER_MARKS = frozenset("header masthead topbar".split())
STATES = frozenset("has no not with without is hide show open closed enabled disabled".split())
CONTENT = frozenset("article articlebody body content entry main post story text".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*)?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Page:
    """Elements and text of one page.  Element 0 is the root; parents come before children."""

    def __init__(self, html: str) -> None:
        self.tag, self.up, self.path, self.marked, self.main = ["body"], [-1], [b""], [False], [False]
        self.good = [True]
        self.blocks: list[list[tuple[int, str, bool]]] = []
        self.block: list[tuple[int, str, bool]] = []
        self.open: list[tuple[str, int]] = []
        self.count: Counter[str] = Counter()
        self.read(html)
        self.flush()
        self.settle()

    # --- reading ----------------------------------------------------------------------------
    def read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            tag = html.find("<", at)
            if tag < 0:
                return self.text(html[at:])
            after = html[tag + 1:tag + 2]
            if not (after.isascii() and after.isalpha()) and after not in ("/", "!", "?"):
                stop = html.find("<", tag + 1)
                stop = end if stop < 0 else stop
                self.text(html[at:stop])
                at = stop
                continue
            if tag > at:
                self.text(html[at:tag])
            if html.startswith("<!--", tag):
                stop = html.find("-->", tag + 2)
                at = end if stop < 0 else stop + 3
            elif after.isalpha():
                at = self.start_tag(html, tag)
            elif after == "/" and (name := NAME.match(html, tag + 2)):
                stop = html.find(">", name.end())
                if stop < 0:
                    return
                self.close(name.group().lower())
                at = stop + 1
            else:
                stop = html.find(">", tag + 1)
                at = end if stop < 0 else stop + 1

    def start_tag(self, html: str, tag: int) -> int:
        """Read a start tag, and what a raw-text element holds; returns the place after it."""
        name = NAME.match(html, tag + 1)
        at, end, attributes = name.end(), len(html), {}
        while True:
            found = ATTRIBUTE.match(html, at)
            if not found:
                stop = html.find(">", at)
                if stop < 0:
                    return end
                break
            key, at = found.group(1).lower(), found.end()
            if html[at - 1] in "= \t\n\r\f" and "=" in found.group()[len(found.group(1)):]:
                quote = html[at:at + 1]
                close = html.find(quote, at + 1) if quote in ('"', "'") and quote else -1
                if close >= 0:
                    value, at = html[at + 1:close], close + 1
                else:
                    bare = re.compile(r"[^\s>]*").match(html, at)
                    value, at = bare.group(), bare.end()
            else:
                value = ""
            if key in ("class", "id", "role", "style", "hidden", "aria-hidden", "itemprop"):
                attributes.setdefault(key, value)
        name, at = name.group().lower(), stop + 1
        if name in RAW:
            stop = RAW_END[name].search(html, at)
            if stop is None:
                return end
            at = html.find(">", stop.end())
            return end if at < 0 else at + 1
        self.start(name, attributes)
        return at

    # --- building ---------------------------------------------------------------------------
    def node(self) -> int:
        return self.open[-1][1] if self.open else 0

    def flush(self) -> None:
        if self.block:
            self.blocks.append(self.block)
            self.block = []

    def text(self, raw: str) -> None:
        self.block.append((self.node(), unescape(raw) if "&" in raw else raw, self.count["a"] > 0))

    def pop_to(self, depth: int) -> None:
        for name, _ in self.open[depth:]:
            self.count[name] -= 1
        del self.open[depth:]

    def find(self, names: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> int:
        """Depth of the nearest open element of these names, or -1 if a bound lies before it."""
        if not any(self.count[n] for n in names):
            return -1
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] in names:
                return depth
            if self.open[depth][0] in bounds:
                return -1
        return -1

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name in ("html", "body"):
            return self.flush()
        if name == "br":
            self.block.append((self.node(), " ", False))
            return
        if name in BLOCKS:
            self.flush()
        if name in VOID:
            return
        if name in SIBLINGS:
            depth = self.find(*SIBLINGS[name])
            while depth >= 0:
                self.pop_to(depth)
                depth = self.find(*SIBLINGS[name])
        if name in CLOSED_BY_BLOCK:
            depth = self.find({"p"}, SCOPES)
            if depth >= 0:
                self.pop_to(depth)
        if name in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.pop_to(len(self.open) - 1)
        node = self.node()
        mark = name in SKIPPED or self.boilerplate(name, attributes)
        if name in BLOCKS or mark:
            classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split() if not STATES & set(words_of(c))})
            self.path.append(blake2b(self.path[node] + " ".join([name, *classes]).encode("utf-8", "replace"), digest_size=8).digest())
            self.up.append(node)
            self.tag.append(name)
            self.marked.append(mark)
            self.main.append(not mark and (name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or attributes.get("itemprop") == "articleBody"))
            self.good.append(bool(CONTENT & set(words_of(attributes.get("class", "") + " " + attributes.get("id", "")))))
            node = len(self.tag) - 1
        self.open.append((name, node))
        self.count[name] += 1

    @staticmethod
    def boilerplate(name: str, attributes: dict[str, str]) -> bool:
        if not attributes:
            return False
        if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            return True
        if "display:none" in attributes.get("style", "").lower().replace(" ", ""):
            return True
        for part in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
            words = words_of(part)
            if not STATES.intersection(words) and (MARKS.intersection(words) or name not in HEADINGS and HEADER_MARKS.intersection(words)):
                return True
        return False

    def close(self, name: str) -> None:
        if name in ("html", "body"):
            return self.flush()
        if name == "br":
            self.block.append((self.node(), " ", False))
            return
        if name in BLOCKS:
            self.flush()
            depth = self.find({name} if name not in HEADINGS else HEADINGS, SCOPES - {name})
            if depth >= 0:
                self.pop_to(depth)
            return
        depth = self.find({name}, BLOCKS)
        if depth >= 0:
            self.pop_to(depth)
        elif self.count[name]:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] == name:
                    self.count[name] -= 1
                    self.open[depth] = ("", self.open[depth][1])
                    break

    # --- deciding ---------------------------------------------------------------------------
    def settle(self) -> None:
        """Which elements are left out, and how much text each has."""
        n = len(self.tag)
        holds = self.main.copy()
        for i in range(n - 1, 0, -1):
            holds[self.up[i]] |= holds[i]
        inside, heading, self.out = self.main.copy(), [False] * n, [False] * n
        header = [False] * n
        for i in range(1, n):
            up, tag = self.up[i], self.tag[i]
            inside[i] |= inside[up]
            heading[i] = heading[up] or tag in HEADINGS
            header[i] = header[up] or tag == "header"
            marked = self.marked[i] and (tag in SKIPPED or not holds[i])
            self.out[i] = self.out[up] or marked or (tag == "header" and not inside[up] and not holds[i])
        self.drop = [self.out[i] or header[i] and inside[i] and not heading[i] and not self.main[i] for i in range(n)]
        own, links = [0] * n, [0] * n
        for block in self.blocks:
            for node, text, link in block:
                if not self.drop[node]:
                    size = len(text.strip())
                    own[node] += size
                    links[node] += size * link
        lists = [0] * n
        whole, linked = own.copy(), links.copy()
        for i in range(n - 1, 0, -1):
            whole[self.up[i]] += whole[i]
            linked[self.up[i]] += linked[i]
            if self.tag[i] == "li" and not self.drop[i]:
                lists[self.up[i]] += 1
        menu = [False] * n
        for i in range(1, n):
            menu[i] = menu[self.up[i]] or self.tag[i] in ("ul", "ol") and lists[i] >= 3 and whole[i] > 0 and linked[i] == whole[i]
            self.drop[i] |= menu[i]
        self.own, self.links, self.whole, self.linked, self.heading = own, links, whole, linked, heading

    def scores(self) -> dict[bytes, float]:
        """Score of every container path of the page."""
        n, score = len(self.tag), {}
        direct = [0.0] * n
        for i in range(n):
            if self.drop[i]:
                continue
            value = max(0, self.own[i] - 2 * self.links[i])
            at = self.up[i] if self.tag[i] in ("p", "pre", "li", "td", "th", "dd", "dt", "blockquote", "figcaption") or self.tag[i] in HEADINGS else i
            at = max(at, 0)
            direct[at] += value
            if at:
                direct[self.up[at]] += value / 2
        for i in range(n):
            if self.drop[i]:
                continue
            value = direct[i] * (1.5 if self.good[i] else 1.0)
            if self.main[i]:
                value = (3 if self.tag[i] == "article" else 2) * max(self.whole[i] - self.linked[i], self.whole[i] / 100)
            if value > 0:
                score[self.path[i]] = score.get(self.path[i], 0.0) + value
        return score

    def best(self) -> bytes | None:
        """Path of the best container, widened to a parent that adds nothing but headings."""
        score = self.scores()
        if not score:
            return None
        top = max(score.values())
        i = next(i for i, p in enumerate(self.path) if not self.drop[i] and score.get(p) == top)
        kept, titles = self.kept(False), self.kept(True)
        wide = i
        while i and not self.main[i]:
            up = self.up[i]
            extra = kept[up] - kept[i]
            if extra > titles[up] - titles[i]:
                break
            i = up
            wide = i if extra else wide
        return self.path[wide]

    def kept(self, titles: bool) -> list[int]:
        """Characters of every element without what is dropped in it; of its headings only on demand."""
        sizes = [o if not d and (h or not titles) else 0 for d, o, h in zip(self.drop, self.own, self.heading)]
        for i in range(len(sizes) - 1, 0, -1):
            sizes[self.up[i]] += sizes[i]
        return sizes

    def extract(self, winners: dict[bytes, float]) -> str:
        """Text of the winning path that weighs most in this page, else of the page's own best container."""
        score = self.scores()
        here = [(score[p] * votes, votes, p) for p, votes in winners.items() if p in score]
        path = max(here)[2] if here else self.best()
        if path is None:
            return ""
        inside = [p == path and not d for p, d in zip(self.path, self.drop)]
        for i in range(1, len(inside)):
            inside[i] |= inside[self.up[i]]
        lines = (" ".join("".join(t for node, t, _ in block if inside[node] and not self.drop[node]).split()) for block in self.blocks)
        return "\n".join(line for line in lines if line)


def words_of(name: str) -> list[str]:
    return [w.lower() for w in WORD.findall(name)]


def host_of(url: str | Column) -> Column:
    """Host of a url in lower case; '' without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def vote(pages: DataFrame) -> DataFrame:
    """``host, path, votes``: how many pages of a host have their best container at a path, of pages with a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: Counter[tuple[str, bytes]] = Counter()
            for part in byte_slices(batch, "html"):
                for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    path = Page(html).best()
                    if path is not None:
                        votes[host, path] += 1
            hosts, paths = zip(*votes) if votes else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.binary()), pa.array(votes.values(), pa.int64())], names=["host", "path", "votes"])

    rows = pages.select(host_of("url").alias("host"), "html").filter("host <> '' and html <> ''")
    return rows.mapInArrow(run, "host string, path binary, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winners_of(votes: DataFrame, share: float = SHARE) -> DataFrame:
    """``host, paths``: the paths with at least ``share`` of the votes of their host, each with its share."""
    total = votes.groupBy("host").agg(F.sum("votes").alias("of"))
    kept = votes.join(total, "host").select("host", F.struct("path", (F.col("votes") / F.col("of")).alias("share")).alias("p")).filter(F.col("p.share") >= share)
    return kept.groupBy("host").agg(F.collect_list("p").alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text``: the main text of every page."""
    winners = stored(winners_of(stored(vote(pages), "votes")), "winners")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "html"):
                texts = [Page(html).extract({p["path"]: p["share"] for p in paths or []}) if html else ""
                         for html, paths in zip(part.column("html").to_pylist(), part.column("paths").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select("page_id", "url", "html", host_of("url").alias("host")).join(winners, "host", "left").select("page_id", "url", "html", "paths")
    shape = pages.select("page_id", "url", F.col("html").alias("text")).schema
    return rows.mapInArrow(run, shape)


def digest(pages: DataFrame) -> DataFrame:
    """The main text and its number of code points."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
