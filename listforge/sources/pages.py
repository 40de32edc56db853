"""Page kernels: html column -> values.

A page is one row, and everything here stays inside that row (regexes and array functions),
so no kernel needs a shuffle, however many pages there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from listforge.functions import attributes as at, text as tx, urls

INVISIBLE = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"
ANCHOR_HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""
IMAGE_URL = r"""(?i)(https?://[^"'>\s]+\.(?:jpg|jpeg|png|webp)(?:\?[^"'>\s]+)?)"""


def page_title(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return tx.collapse(tx.unescape_html(F.regexp_replace(inner, "<[^>]+>", " ")))


def page_text(html: Column) -> Column:
    return tx.collapse(tx.unescape_html(F.regexp_replace(F.regexp_replace(html, INVISIBLE, " "), "<[^>]+>", " ")))


def page_lines(html: Column) -> Column:
    """Visible text, one array element per text node, trimmed, without empty ones."""
    broken = F.regexp_replace(F.regexp_replace(html, INVISIBLE, "\n"), "<[^>]+>", "\n")
    return tx.lines_of(tx.unescape_html(broken))


def page_links(html: Column, page_url: Column, href_pattern: str = ".") -> Column:
    """Absolute link targets that match, without query and fragment, first occurrence order."""
    hrefs = F.filter(F.regexp_extract_all(html, F.lit(ANCHOR_HREF), F.lit(1)),
                     lambda h: h.rlike(href_pattern) & ~h.rlike("(?i)^(?:javascript|mailto|tel):"))
    full = F.transform(hrefs, lambda h: F.regexp_replace(
        urls.absolute_url(F.replace(h, F.lit("&amp;"), F.lit("&")), page_url), "[?#].*$", ""))
    return F.array_distinct(F.filter(full, lambda u: u != ""))


def page_images(html: Column) -> Column:
    """Image addresses in page order; films, thumbnails, site assets and logos are left out."""
    found = F.transform(F.regexp_extract_all(html, F.lit(IMAGE_URL), F.lit(1)),
                        lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    kept = F.filter(found, lambda u: ~F.lower(u).rlike("/assets/|thumbs|logo|youtube|youtu\\.be|vimeo"))
    return F.array_distinct(kept)


def page_meta(html: Column, name: str) -> Column:
    """Content of a named or property meta tag, attributes in either order."""
    key = name.replace(":", "[:]").replace(".", "[.]")
    before = rf"""(?is)<meta\b[^>]*?\b(?:name|property)\s*=\s*["']{key}["'][^>]*?\bcontent\s*=\s*["']([^"']*)["']"""
    after = rf"""(?is)<meta\b[^>]*?\bcontent\s*=\s*["']([^"']*)["'][^>]*?\b(?:name|property)\s*=\s*["']{key}["']"""
    return tx.clean_text(tx.unescape_html(F.coalesce(tx.extract(html, before), tx.extract(html, after))))


def json_key(html: Column, key: str) -> Column:
    """First string value of a JSON key anywhere in the page, plain first, then backslash-escaped."""
    return F.trim(F.coalesce(tx.extract(html, rf'"{key}"\s*:\s*"([^"]+)"'),
                             tx.extract(html, rf'\\"{key}\\"\s*:\s*\\"([^"\\]+)\\"')))


def json_texts(html: Column, key: str, least: int) -> Column:
    """All string values of a JSON key with ``least`` characters or more, escapes decoded.

    Escaped quotes and backslashes are replaced by marks first, so that the pattern is a loop over one
    character class, which Java runs without recursion on a text of any length."""
    marked = F.replace(F.replace(html, F.lit("\\\\"), F.lit("\ue000")), F.lit('\\"'), F.lit("\ue001"))
    found = F.regexp_extract_all(marked, F.lit(rf'"{key}":"([^"]{{{least},}})"'), F.lit(1))

    def decoded(x: Column) -> Column:
        raw = F.replace(F.replace(x, F.lit("\ue001"), F.lit('\\"')), F.lit("\ue000"), F.lit("\\\\"))
        one_line = F.translate(raw, "\n\r\t", "   ")
        return F.coalesce(F.from_json(F.concat(F.lit('["'), one_line, F.lit('"]')), "array<string>")[0], raw)

    return F.transform(found, decoded)


def unescape_payload(html: Column) -> Column:
    """Payloads that stand inside a script's string have their quotes escaped once more: one level less."""
    inner = F.replace(html, F.lit('\\\\\\"'), F.lit("\ue002"))
    return F.when(html.contains('\\"'), F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\ue002"), F.lit('\\"')))


def json_number(html: Column, key: str) -> Column:
    number = r"(-?\d+(?:\.\d+)?)"
    return F.coalesce(tx.extract(html, rf'"{key}"\s*:\s*{number}'),
                      tx.extract(html, rf'\\"{key}\\"\s*:\s*{number}')).try_cast("double")


# --- embedded JSON ------------------------------------------------------------------------
JSONLD_BODY = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
NEXT_DATA_BODY = r"""(?is)<script\b[^>]*id\s*=\s*["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""


def jsonld(html: Column, wanted: str) -> Column:
    """First JSON-LD object (variant) of the wanted type; looks into arrays and @graph."""
    def nodes(body: Column) -> Column:
        return tx.let(F.try_parse_json(body), lambda v: F.coalesce(
            F.try_variant_get(v, "$", "array<variant>"),
            F.concat(F.array(v), F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"),
                                            F.array().cast("array<variant>")))))

    def has_type(v: Column) -> Column:
        types = F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"),
                           F.array(F.try_variant_get(v, "$['@type']", "string")))
        return F.exists(types, lambda t: F.lower(t) == wanted.lower())

    bodies = F.regexp_extract_all(html, F.lit(JSONLD_BODY), F.lit(1))
    found = F.filter(F.flatten(F.transform(bodies, nodes)), has_type)
    return F.try_element_at(found, F.lit(1))


def next_data(html: Column, path: str = "$") -> Column:
    """Part (variant) of the page's state script."""
    return F.try_variant_get(F.try_parse_json(tx.extract(html, NEXT_DATA_BODY)), path, "variant")


def next_data_query(html: Column, literal: str) -> Column:
    """Data of the cached query whose key holds a literal."""
    queries = F.try_variant_get(next_data(html), "$.props.pageProps.dehydratedState.queries", "array<variant>")
    hits = F.filter(queries, lambda q: F.array_contains(
        F.try_variant_get(q, "$.queryKey", "array<string>"), literal))
    return F.try_variant_get(F.try_element_at(hits, F.lit(1)), "$.state.data", "variant")


def hidden_json(html: Column, field: str, element_schema: str) -> Column:
    """Array held HTML-escaped in the value of an input."""
    raw = F.coalesce(
        tx.extract(html, rf"""(?is)<input\b[^>]*?\b(?:id|name)\s*=\s*["']{field}["'][^>]*?\bvalue\s*=\s*"([^"]*)\""""),
        tx.extract(html, rf"""(?is)<input\b[^>]*?\bvalue\s*=\s*"([^"]*)"[^>]*?\b(?:id|name)\s*=\s*["']{field}["']"""))
    return F.from_json(tx.unescape_html(raw), f"array<{element_schema}>")


# --- line based ---------------------------------------------------------------------------
def label_values(lines: Column, labels: list[str]) -> Column:
    """map<label, value>: the value is the next line unless that is a label too; the last one wins."""
    pairs = tx.let(lines, lambda ls: F.transform(ls, lambda x, i: F.struct(
        x.alias("key"), F.try_element_at(ls, i + 2).alias("value"))))
    kept = F.filter(pairs, lambda p: p["key"].isin(labels) & p["value"].isNotNull() & ~p["value"].isin(labels))
    return F.map_from_entries(at.last_entries(kept))


def label_prefix_values(lines: Column, labels: list[str]) -> Column:
    """map<label, value> from 'Label: value' lines; of two labels the earlier in the list counts."""
    canon = F.create_map(*[F.lit(x) for label in labels for x in (label.lower(), label)])
    pattern = "(?iU)^(" + "|".join(labels) + r")\s*[:\-]?\s*(.+)$"
    pairs = F.transform(F.array_distinct(lines), lambda x: F.struct(
        F.try_element_at(canon, F.lower(F.regexp_extract(x, pattern, 1))).alias("key"),
        F.trim(F.regexp_extract(x, pattern, 2)).alias("value")))
    return F.map_from_entries(at.last_entries(F.filter(pairs, lambda p: p["key"].isNotNull())))


def block_between(text: Column, start: str, end: str, noise: str = "(?i)^exibir todas") -> Column:
    """Distinct lines between two labels, noise lines left out."""
    body = tx.extract(text, rf"(?isU){start}(.*?){end}")
    return F.array_distinct(F.filter(tx.lines_of(body), lambda x: (F.length(x) > 1) & ~x.rlike(noise)))


def section_after(lines: Column, start: str, stop: str) -> Column:
    """Lines after the first line matching start, up to the first one matching stop."""
    def cut(ls: Column) -> Column:
        begin = F.array_position(F.transform(ls, lambda x: x.rlike(start)), True).cast("int")
        rest = F.when(begin > 0, F.slice(ls, begin + 1, F.size(ls)))
        return tx.let(rest, lambda r: tx.let(
            F.array_position(F.transform(r, lambda x: x.rlike(stop)), True).cast("int"),
            lambda end: F.when(end > 0, F.slice(r, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(r)))

    return tx.let(lines, cut)


def context_price(lines: Column, floor: float = 10_000.0) -> Column:
    """Price line judged by its neighbours: condo or tax words in the two lines before reject it,
    sale or rent words in the three lines after put it first; then any unrejected one; then any amount."""
    from listforge.functions import money as mo

    exact = r"^R\$\s*([\d\.]+(?:,\d{2})?)$"
    fees = ["condomínio", "condominio", "iptu"]

    def pick(ls: Column) -> Column:
        judged = F.filter(F.transform(ls, lambda x, i: F.struct(
            mo.parse_price_brl(tx.extract(x, exact)).alias("price"),
            F.lower(F.array_join(F.slice(ls, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), " ")).alias("before"),
            F.lower(F.array_join(F.slice(ls, i + 2, F.lit(3)), " ")).alias("after"))),
            lambda s: (s["price"] >= floor) & ~tx.contains_any(s["before"], fees))

        def choose(js: Column) -> Column:
            named = F.filter(js, lambda s: tx.contains_any(s["after"], ["venda", "aluguel", "temporada"] + fees))
            loose = F.filter(mo.page_amounts(F.array_join(ls, "\n")), lambda p: p >= floor)
            return F.coalesce(F.try_element_at(named, F.lit(1))["price"], F.try_element_at(js, F.lit(1))["price"],
                              F.try_element_at(loose, F.lit(1)))

        return tx.let(judged, choose)

    return tx.let(lines, pick)


def longest_text(candidates: Column) -> Column:
    """Longest cleaned text, the first one on ties."""
    ranked = F.transform(candidates, lambda x, i: F.struct(F.length(tx.collapse(x)).alias("n"), (-i).alias("p"),
                                                           tx.collapse(x).alias("t")))
    return tx.empty_to_null(F.array_max(ranked)["t"])


def best_images(found: Column, asset_pattern: str) -> Column:
    """Widest variant per asset; widths 1-199 are thumbnails; on equal width the later one."""
    ranked = F.filter(F.transform(found, lambda u, i: F.struct(
        F.coalesce(tx.extract(u, asset_pattern), u).alias("k"), i.alias("i"),
        F.coalesce(tx.extract(u, r"(?i)[?&]width=(\d+)").try_cast("int"), F.lit(0)).alias("width"), u.alias("url"))),
        lambda s: (s["width"] == 0) | (s["width"] >= 200))

    def pick(rs: Column) -> Column:
        # both orders list every asset once, by name: where it was found first, and its widest variant
        firsts = tx.first_of_key(rs)
        widest = tx.first_of_key(F.transform(rs, lambda s: F.struct(
            s["k"].alias("k"), F.struct((-s["width"]).alias("w"), (-s["i"]).alias("at")).alias("i"), s["url"].alias("url"))))
        both = F.zip_with(firsts, widest, lambda f, w: F.struct(f["i"].alias("p"), w["url"].alias("u")))
        return F.transform(F.array_sort(both), lambda s: s["u"])

    return F.array_distinct(tx.let(ranked, pick))


# --- selector-driven extraction -----------------------------------------------------------
def page_blocks(pages: DataFrame, mapping: list[dict]) -> DataFrame:
    """First match of each mapping row (field, tag, id or class, attr) on every page.

    Nested elements cannot be matched with regexes, so this is the one kernel that runs Python
    per Arrow batch.  The mapping is a handful of rows and travels inside the closure."""
    rules = [(m["field"], m.get("tag"), m.get("id"), m.get("class"), m.get("attr")) for m in mapping]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(page_id, field, value) for page_id, html in zip(batch["page_id"], batch["html"])
                    for field, value in _first_matches(html or "", rules).items()]
            yield pd.DataFrame(rows, columns=["page_id", "field", "value"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, field string, value string")


VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _first_matches(html: str, rules: list[tuple]) -> dict[str, str]:
    from html.parser import HTMLParser

    found: dict[str, str] = {}
    open_rules: list[tuple[str, str, int, list[str]]] = []

    class Reader(HTMLParser):
        depth = 0
        hidden = 0

        def handle_starttag(self, tag, attrs):
            values = dict(attrs)
            if tag not in VOID_TAGS:
                self.depth += 1
            self.hidden += tag in ("script", "style")
            for field, want, wid, wclass, attr in rules:
                if field in found or any(o[0] == field for o in open_rules):
                    continue
                if (want and want != tag) or (wid and values.get("id") != wid):
                    continue
                if wclass and wclass not in (values.get("class") or "").split():
                    continue
                if attr:
                    if values.get(attr):
                        found[field] = values[attr].strip()
                elif tag not in VOID_TAGS:
                    open_rules.append((field, tag, self.depth, []))

        def handle_endtag(self, tag):
            if tag in VOID_TAGS:
                return
            self.hidden -= tag in ("script", "style") and self.hidden > 0
            for rule in [o for o in open_rules if o[1] == tag and o[2] >= self.depth]:
                open_rules.remove(rule)
                text = " ".join(" ".join(rule[3]).split())
                if text:
                    found[rule[0]] = text
            self.depth -= 1

        def handle_data(self, data):
            if not self.hidden:
                for rule in open_rules:
                    rule[3].append(data)

    reader = Reader(convert_charrefs=True)
    reader.feed(html)
    reader.close()
    return found
