"""Text cleaning expressions.

Python regexes are Unicode by default and Java's are not, so every class such as
``\\s`` or ``\\w`` runs with the ``(?U)`` flag.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import wraps
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F, types as T

from listforge import fixed_values as fv

# Java asks the members of a class one after the other, for every character of a text: the range before && turns most
# characters away with the first question.
EXOTIC_SPACES = r"[\x{a0}-\x{3000}&&[\x{00a0}\x{1680}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
# White space as str.split() sees it, as characters and as an explicit class: the class is one table
# lookup per character, while (?U)\\s asks for the Unicode property every time.
SPACES = " \t\n\u000b\f\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE_RUN = (r"[\x{0}-\x{20}\x{80}-\x{3000}&&[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]+")
BLOCK_TAGS = (r"(?i)</?(?:p|div|li|ul|ol|strong|b|em|span|h[1-6]|section|article|header|footer"
              r"|table|tr|td)\b[^>]*>")


def _fold_table() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition is one ASCII character."""
    source, target = [], []
    for code in range(0xAA, 0x250):
        folded = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code))
                         if not unicodedata.combining(ch))
        if len(folded) == 1 and folded.isascii() and folded.isalnum():
            source.append(chr(code))
            target.append(folded)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()




def let(value: Column, body) -> Column:
    """Bind a value once and use it many times.

    Inside a lambda Catalyst repeats an expression at every use, and a filter that is pushed below
    a projection puts the whole expression in place of its column, so an array that is looked into
    from a lambda would be rebuilt for every element.  Every function that does so binds it here."""
    return F.transform(F.array(value), body)[0]


def bound(fn):
    """Decorator for a function of a column that looks at its input more than once."""
    @wraps(fn)
    def run(c: Column, *args, **kwargs) -> Column:
        return let(c, lambda value: fn(value, *args, **kwargs))

    return run


def empty_to_null(c: Column) -> Column:
    """Null for ''.  The column is named once and no lambda is called, so that what it is made from stays in generated code."""
    return F.get(F.array_remove(F.array(c), ""), F.lit(0))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` or null (regexp_extract alone gives '')."""
    return empty_to_null(F.regexp_extract(c, pattern, group))


def replace_all(c: Column, *rules: tuple[str, str]) -> Column:
    for pattern, value in rules:
        c = F.regexp_replace(c, pattern, value)
    return c


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE_RUN, " "))


def clean_text(c: Column) -> Column:
    return empty_to_null(collapse(c))


def strip_spaces(c: Column) -> Column:
    """Trim any Unicode white space, as str.strip() does."""
    return F.btrim(c, F.lit(SPACES))


def normalize_arg(c: Column) -> Column:
    """trim + lower + collapse, null as ''."""
    return F.lower(collapse(F.coalesce(c, F.lit(""))))


def replace_dashes(c: Column) -> Column:
    return F.translate(c, "—–", "--")


def clean_title(c: Column, capitalize: bool = False) -> Column:
    title = replace_dashes(clean_text(c))
    return upper_first(title) if capitalize else title


@bound
def upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


# the entities of HTML 4 and two more, by the rule of the standard library's table
NAMED_ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
NUMBERED = r"#(?:3[2-9]|[4-9][0-9]|1[01][0-9]|12[0-6]|1[6-9][0-9]|[2-9][0-9]{2}|[1-9][0-9]{3}|[1-4][0-9]{4})"


def _entity(part: Column) -> Column:
    """What follows an ampersand, with the entity it starts with decoded; null when it starts with none."""
    name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,10});", 1)
    number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).when(
        name.startswith("#"), F.substring(name, F.lit(2), F.length(name))).cast("int")
    usable = number.between(32, 126) | number.between(160, 0xD7FF) | number.between(0xE000, 0xFFFD) | number.between(0x10000, 0x10FFFF)
    numbered = F.when(usable, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    value = F.coalesce(F.try_element_at(lookup_table(NAMED_ENTITIES), F.when(name != "", name)), numbered)
    return F.concat(value, F.substring(part, F.length(name) + 2, F.length(part)))


def _unescape_native(c: Column) -> Column:
    """Decode every entity that ends in ';', in one pass from left to right, so that nothing is decoded twice."""
    parts = F.transform(F.split(c, "&"), lambda p, i: F.when(i == 0, p).otherwise(F.coalesce(let(p, _entity), F.concat(F.lit("&"), p))))
    return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)


@bound
def unescape_basic(c: Column) -> Column:
    return _unescape_native(c)


@F.pandas_udf(T.StringType())
def _unescape_full(values):
    import html

    return values.map(html.unescape, na_action="ignore")


def unescape_html(c: Column) -> Column:
    """Full entity decoding.  Text without '&' and text with only named and plain numbered entities never
    leaves the JVM: Python sees null for it and the answer is taken from the native branch."""
    common = "|".join(NAMED_ENTITIES)
    rare = F.when(c.contains("&"), F.regexp_replace(c, f"&(?:{common}|{NUMBERED});", "").rlike("&(?:#|[A-Za-z])"))
    return F.coalesce(_unescape_full(F.when(rare, c)), unescape_basic(c))


def _clean_description(c: Column, drop_marks: bool) -> Column:
    text = F.regexp_replace(unescape_html(c), EXOTIC_SPACES, " ")
    if drop_marks:
        text = F.replace(replace_dashes(text), F.lit("?"), F.lit(""))
    return empty_to_null(strip_spaces(replace_all(
        F.translate(text, "\t", " "),
        (r"\r\n?", "\n"), (r"(?iU)<\s*br\s*/?\s*>", "\n"), (BLOCK_TAGS, " "), (r"<[^>]+>", " "),
        (SPACE_RUN, " "),
    )))


def clean_description(c: Column) -> Column:
    """Description clean-up at extraction time: also unifies dashes and drops '?'."""
    return _clean_description(c, drop_marks=True)


def clean_description_ingest(c: Column) -> Column:
    return _clean_description(c, drop_marks=False)


def html_to_text(c: Column) -> Column:
    """Markup to paragraphs: </p> ends a paragraph, </li> a line, every other tag is a space."""
    return empty_to_null(strip_spaces(replace_all(
        unescape_html(c),
        (r"(?i)</p>", "\n\n"), (r"(?i)</li>", "\n"), (r"<[^>]+>", " "), (r"[ \t]+", " "),
        (r"(?U)\n\s*\n+", "\n\n"), (r"(?U)\s+\n", "\n"), (r"(?U)\n\s+", "\n"),
    )))


def ascii_fold(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"\p{M}+", "")


def norm_token(c: Column) -> Column:
    return F.trim(replace_all(F.lower(ascii_fold(c)), (r"[^a-z0-9\s]", " "), (r"\s{2,}", " ")))


def match_text(c: Column) -> Column:
    """Folded words with one blank on both sides, '' when there are no words."""
    body = F.trim(F.regexp_replace(F.lower(ascii_fold(F.coalesce(c, F.lit("")))), r"[^a-z0-9]+", " "))
    return let(body, lambda b: F.when(b == "", F.lit("")).otherwise(F.concat(F.lit(" "), b, F.lit(" "))))


def strip_emoji(c: Column) -> Column:
    plain = F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), fv.EMOJI_CLASS, " "), "\u00a0*", "  ")
    return strip_spaces(replace_all(plain, (fv.BULLET_CLASS, " "), (r"[ \t]{2,}", " ")))


def clean_line(c: Column) -> Column:
    line = replace_all(strip_emoji(c), (r"(?U)^[\s\-–—•*|]+", ""), (r"(?U)\s+", " "))
    return F.regexp_replace(line, r"^[ \-|:]+|[ \-|:]+$", "")


def multiline_clean(c: Column) -> Column:
    text = F.translate(strip_emoji(c), "\r\t", "\n ")
    return strip_spaces(replace_all(
        text, (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")))


def lines_of(c: Column) -> Column:
    """Trimmed non-empty lines, in order."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r"), strip_spaces),
                    lambda line: line != "")


def first_of_key(entries: Column) -> Column:
    """Of an array of struct<k, i, ...> the entries that come first, by i, among those of their key, ordered by key.
    The array is sorted once and each entry compared with the one before it."""
    return let(F.array_sort(entries), lambda es: F.filter(es, lambda e, at: e["k"].isNotNull() & (
        (at == 0) | F.coalesce(F.get(es, at - 1)["k"] != e["k"], F.lit(True)))))


def distinct_by_token(items: Column) -> Column:
    """Keep the first element for every norm_token, drop empty elements; order kept."""
    entries = F.transform(items, lambda v, i: F.struct(norm_token(v).alias("k"), i.alias("i"), v.alias("v")))
    back = F.array_sort(F.transform(first_of_key(entries), lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v"))))
    return F.filter(F.transform(back, lambda e: e["v"]), lambda v: F.coalesce(v, F.lit("")) != "")


def sanitize_page_line(c: Column) -> Column:
    """One line of a job page: emoji, bullets and dangling dashes removed."""
    text = collapse(F.regexp_replace(
        F.translate(unescape_basic(c), "\u00a0\u200b", "  "),
        r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{200d}\x{fe0f}]+", " "))
    return F.trim(replace_all(
        F.replace(text, F.lit("…"), F.lit("...")),
        (r"^[\-\|\x{2022}\x{2023}\x{2043}\x{2219}\x{25E6}\x{00B7}]+\s*", ""),
        (r"\s*[\-\|]+\s*$", ""), (r"^[ \-|]+|[ \-|]+$", "")))


NOISE_LINE = r"(?iU)^(?:" + "|".join(fv.NOISE_LINE_PATTERNS) + ")"


def useful_lines(c: Column) -> Column:
    """Lines without noise lines, hashtags and repeats."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r"), sanitize_page_line)
    kept = F.filter(lines, lambda x: (norm_token(x) != "") & ~x.startswith("#") & ~x.rlike(NOISE_LINE))
    return distinct_by_token(kept)


def drop_noise_lines(c: Column) -> Column:
    return empty_to_null(F.array_join(useful_lines(c), "\n"))


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, as Python's str.title() does.

    initcap only starts a word after white space, so every non-letter is first separated
    from the next letter by a zero-width mark that is removed again."""
    marked = F.regexp_replace(F.lower(c), r"(?<=\P{L})(?=\p{L})", "\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def slug_title(url: Column, from_end: int = 1) -> Column:
    """Words of the last (or an earlier) path segment in title case."""
    parts = F.split(F.regexp_replace(url, "/+$", ""), "/")
    segment = F.try_element_at(parts, F.lit(-from_end))
    return empty_to_null(F.trim(title_case(F.translate(segment, "-_", "  "))))


def title_split(c: Column) -> Column:
    """struct<company, title> cut at the first ':'; null when there is none."""
    return _split_at_colon(clean_text(c))


@bound
def _split_at_colon(c: Column) -> Column:
    text = c
    at = F.instr(text, ":")
    return F.when(at > 0, F.struct(
        F.trim(F.substring(text, F.lit(1), at - 1)).alias("company"),
        F.trim(F.substring(text, at + 1, F.length(text))).alias("title")))


TITLE_SUFFIXES = [
    fv.SITE_TITLE_SUFFIX,
    r"(?iU)(?:\s|[-|])*(?:NOVA|NOVO)\s*$",
    r"(?iU)\s*-\s*R\$\s*[\d\.,]+.*$",
    r"(?iU)\s*-\s*\d+\s*\|\s*\w+$",
]


def title_suffix_strip(c: Column, suffixes: Iterable[str] = TITLE_SUFFIXES) -> Column:
    return F.trim(replace_all(c, *[(pattern, "") for pattern in suffixes]))


def sentence(label: str, value: Column) -> Column:
    return let(empty_to_null(strip_spaces(value)), lambda text: F.concat(
        F.lit(label + ": "), text, F.when(text.rlike(r"[.!?]$"), "").otherwise(".")))


def sentence_join(*parts: tuple[str, Column]) -> Column:
    """'Label: value.' sentences in one line; parts without a value are skipped."""
    return empty_to_null(F.concat_ws(" ", *[sentence(label, value) for label, value in parts]))


def join_parts(*parts: Column, separator: str = "\n\n") -> Column:
    kept = F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != "")
    return empty_to_null(F.array_join(F.array_distinct(kept), separator))


def format_description(c: Column) -> Column:
    """Display form: one paragraph per block and per sentence."""
    plain = strip_spaces(replace_all(
        c, (r"\r\n?", "\n"), (r"\t+", "\n"), (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(?:p|div|section|article|header|footer|h[1-6]|ul|ol|table|tr)>", "\n"),
        (r"(?i)<(?:p|div|section|article|header|footer|h[1-6])[^>]*>", "\n"),
        (r"(?i)<li[^>]*>", "\n• "), (r"(?i)</li>", ""), (r"(?i)</?td[^>]*>", " "), (r"<[^>]+>", " "),
        (r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"), (r"(?i)&quot;", '"'), (r"(?i)&#39;", "'"),
        (r"(?i)&lt;", "<"), (r"(?i)&gt;", ">"), (r"\?", ""), (EXOTIC_SPACES, " "),
        (r"[ \t]*\n[ \t]*", "\n"), (r"[ \t]{2,}", " ")))
    parts = F.transform(F.split(plain, r"\n+|(?<=[.!?])\s+(?=[A-ZÀ-Ý0-9•\-])"), strip_spaces)
    joined = F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")
    return F.coalesce(empty_to_null(joined), F.lit("—"))


def word_table(words: Iterable[str]) -> Column:
    """Constant array of words (folded into a literal when the plan is optimized)."""
    return F.split(F.lit("\u0001".join(words)), "\u0001")


def lookup_table(pairs: dict[str, str]) -> Column:
    """Constant map of texts."""
    return F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in pairs.items())), F.lit("\u0001"), F.lit("\u0002"))


def one_of(text: Column, words: Iterable[str]) -> Column:
    return F.array_contains(word_table(words), text)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when any word is a substring: literal search, no regex engine.

    A short list is a plain OR.  A long one runs over a constant array, with the text bound once:
    an OR of dozens of arms would repeat lower(text) in every arm and outgrow generated code."""
    words = list(words)
    if len(words) > 4:
        table = word_table(words)
        return let(text, lambda t: F.exists(table, lambda w: F.contains(t, w)))
    result = text.contains(words[0])
    for word in words[1:]:
        result = result | text.contains(word)
    return result


def starts_with_any(text: Column, words: Iterable[str]) -> Column:
    table = word_table(words)
    return let(text, lambda t: F.exists(table, lambda w: F.startswith(t, w)))


def first_rule(text: Column, rules: Iterable[tuple[str, list[str]]], default: str | None = None) -> Column:
    """Label of the first rule one of whose words occurs in the text."""
    def label_of(t: Column) -> Column:
        chain = F
        for label, words in rules:
            chain = chain.when(contains_any(t, words), label)
        return chain.otherwise(F.lit(default))

    return let(text, label_of)


def first_pattern(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    def label_of(t: Column) -> Column:
        chain = F
        for label, pattern in rules:
            chain = chain.when(t.rlike(pattern), label)
        return chain

    return let(text, label_of)


def generated_title(kind: Column, bedrooms: Column, *place: Column) -> Column:
    """'Kind com N quartos à venda em A, B'; five or more and unknown counts share a label."""
    rooms = F.when((bedrooms > 0) & (bedrooms < 5), F.concat(bedrooms.cast("string"), F.lit(" quartos"))
                   ).otherwise("5 quartos ou +")
    where = F.array_join(F.filter(F.array(*place), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    return F.when(where != "", F.concat(kind, F.lit(" com "), rooms, F.lit(" à venda em "), where)
                  ).otherwise(F.concat(kind, F.lit(" à venda")))


def street_text(street: Column, number: Column, district: Column) -> Column:
    """'street, number - district' with all three parts, ' - ' between two."""
    values = F.filter(F.array(*[clean_text(x) for x in (street, number, district)]), lambda x: x.isNotNull())
    return empty_to_null(F.when(
        F.size(values) >= 3, F.concat(values[0], F.lit(", "), values[1], F.lit(" - "), values[2])
    ).otherwise(F.array_join(values, " - ")))


@bound
def brand_word(token: Column) -> Column:
    """One word in brand spelling: known acronyms and all-capitals stay upper case."""
    return let(F.regexp_replace(token, "[^A-Za-z0-9]", ""), lambda bare: _brand_word(token, bare))


def _brand_word(token: Column, bare: Column) -> Column:
    all_caps = (F.length(bare) > 1) & (bare == F.upper(bare)) & bare.rlike("[A-Z]")

    def part(p: Column) -> Column:
        raw = F.regexp_replace(p, "[^A-Za-z0-9]", "")
        caps = (F.length(raw) > 1) & (raw == F.upper(raw)) & raw.rlike("[A-Z]")
        return F.when(caps, F.upper(p)).otherwise(
            F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p)))))

    lower = (token == F.lower(token)) & token.rlike(r"\p{L}")
    return (F.when(bare == "", token)
            .when(one_of(F.upper(bare), fv.CHAT_UPPER_TOKENS), F.upper(token))
            .when(all_caps, F.upper(token))
            .when(token.contains("-"), F.array_join(F.transform(F.split(token, "-"), part), "-"))
            .when(lower, upper_first(token))
            .otherwise(token))


def brand_case(c: Column) -> Column:
    return F.trim(F.array_join(F.transform(F.split(c, " "), brand_word), " "))


def upper_ratio(c: Column) -> Column:
    """Share of upper-case letters among the letters, 0 without letters."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(r"\p{Lu}")) / letters).otherwise(F.lit(0.0))


@bound
def ends_sentence(c: Column) -> Column:
    return F.when(c.rlike(r"[.!?:]$"), c).otherwise(F.concat(c, F.lit(".")))


def about_text(lines: Column) -> Column:
    """Intro sentences, then 'O que você vai fazer: a; b.' for the lines after that marker."""
    return let(F.filter(lines, lambda x: norm_token(x) != "sobre a vaga"), lambda kept: let(
        F.array_position(F.transform(kept, norm_token), "o que voce vai fazer").cast("int"),
        lambda at: _about_parts(kept, at)))


def _about_parts(kept: Column, at: Column) -> Column:
    intro = F.when(at > 0, F.slice(kept, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(kept)
    tasks = F.when(at > 0, F.slice(kept, at + 1, F.size(kept))).otherwise(F.array().cast("array<string>"))
    intro_text = empty_to_null(F.array_join(F.transform(intro, ends_sentence), " "))
    task_text = F.array_join(F.transform(tasks, lambda x: F.regexp_replace(x, "^[ ;.]+|[ ;.]+$", "")), "; ")
    return empty_to_null(F.concat_ws(" ", intro_text, F.when(
        F.size(tasks) > 0, F.concat(F.lit("O que você vai fazer: "), task_text, F.lit(".")))))


def requirements_text(lines: Column) -> Column:
    """'Heading: a; b.' for list lines followed by the lines that read as sentences."""
    return let(F.filter(lines, lambda x: ~norm_token(x).rlike("^(?:nivel|contratacao|codigo) ")), _requirement_parts)


def _requirement_parts(kept: Column) -> Column:
    has_heading = norm_token(F.try_element_at(kept, F.lit(1))).isin(
        "conhecimentos esperados", "requisitos", "requisitos obrigatorios")
    heading = F.when(has_heading, F.try_element_at(kept, F.lit(1)))
    body = F.when(F.coalesce(has_heading, F.lit(False)), F.slice(kept, F.lit(2), F.size(kept))).otherwise(kept)

    def is_sentence(x: Column) -> Column:
        return x.rlike("[.!?]$") | (F.size(F.split(x, r"\s+")) >= 8)

    items = F.filter(body, lambda x: ~is_sentence(x))
    sentences = F.transform(F.filter(body, is_sentence), ends_sentence)
    listed = F.array_join(F.transform(items, lambda x: F.regexp_replace(x, "^[ ;.]+|[ ;.]+$", "")), "; ")
    first = F.when(F.size(items) > 0, F.concat(F.coalesce(heading, F.lit("Requisitos")), F.lit(": "), listed,
                                               F.lit("."))).otherwise(ends_sentence(heading))
    return F.when(F.size(body) > 0,
                  empty_to_null(F.concat_ws(" ", first, empty_to_null(F.array_join(sentences, " ")))))
