"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is a column expression.  A match is located by cutting the text at the pattern: what lies
between the matches gives their places.  Patterns keep to loops over one character class, which Java runs
without recursion, and start only where a run of such characters starts, so that a text of any length
takes linear time.  Where a separator may stand only between two characters of a class, it is first
replaced by a mark of the same length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, OTHER = "", ""
LOCAL = "A-Za-z0-9._%+\\-" + MARK
# Kinds in their order, and the words that speak for each within CONTEXT characters before it.
KINDS = ("email", "ip", "card", "phone", "iban")
WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile"),
    "iban": ("iban", "account", "bank"),
}
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9}
CONTEXT = 40
LIKELY = 0.8
SPANS = "array<struct<start:int,end:int,hit:string>>"

EMAIL = f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9\\-]++{MARK}[A-Za-z0-9\\-{MARK}]*+"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = f"(?<![0-9{MARK}])[0-9](?:{MARK}?[0-9]){{11,18}}(?![0-9{MARK}])"
PHONE = "\\+[0-9][ ().0-9\\-]+[0-9]"
IBAN = "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their places, end exclusive."""
    cut = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                     lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(F.filter(cut, lambda x: x["hit"].isNotNull()), start, add, lambda acc: acc["out"])


def marked(text: Column, separator: str, around: str) -> Column:
    """The text with every ``separator`` between two characters of ``around`` replaced by the mark."""
    return F.regexp_replace(F.translate(text, MARK, OTHER), f"(?<={around}){separator}(?={around})", MARK)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.length(number)

    def value(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code leaves 1 when divided by 97, its first four characters moved to the end."""
    bare = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55)
    step = lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def small_parts(address: Column) -> Column:
    """Whether all parts of a dotted number are at most 255."""
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(address, "\\."), lambda p: F.when(F.length(bare(p)) <= 3, F.concat(F.lit("0"), bare(p)).cast("int") <= 255).otherwise(False))


def found(text: Column) -> dict[str, Column]:
    """Confirmed spans of each kind.  A text without the characters a kind needs is not searched for it."""
    none = F.array().cast(SPANS)
    only = lambda needs, spans: F.when(needs, spans).otherwise(none)
    size = lambda x: F.length(digits(x["hit"]))
    return {
        "email": only(text.contains("@"), located(marked(text, "\\.", "[A-Za-z0-9\\-]"), EMAIL)),
        "ip": only(text.rlike("[0-9]\\.[0-9]"), F.filter(located(text, IP), lambda x: small_parts(x["hit"]))),
        "card": only(text.rlike("[0-9][0-9 \\-]{10}"), F.filter(located(marked(text, "[ \\-]", "[0-9]"), CARD), lambda x: luhn(digits(x["hit"])))),
        "phone": only(text.rlike("\\+[0-9]"), F.filter(located(text, PHONE), lambda x: size(x).between(9, 15))),
        "iban": only(text.rlike("[A-Z]{2}[0-9]{2}[ A-Z0-9]"), F.filter(located(text, IBAN), lambda x: mod97(x["hit"]))),
    }


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for every row: structs ``start, rank, end, kind, score`` by start, then kind.

    Places are code points, end exclusive.  Null reads as the empty text; kinds may overlap each other.
    The score starts from the kind's own and rises by 0.2, to 1 at most, when a word that speaks for the
    kind stands within 40 characters before the span.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = texts.select("doc_id", "text", *[c.alias(k) for k, c in found(F.col("text")).items()])

    def scored(kind: str) -> Column:
        def one(x: Column) -> Column:
            size = F.least(F.lit(CONTEXT), x["start"])
            before = F.lower(F.substring(F.col("text"), x["start"] - size + 1, size))
            speaks = before.rlike("|".join(WORDS[kind]))
            return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"),
                            F.when(speaks, F.lit(min(1.0, START[kind] + 0.2))).otherwise(F.lit(START[kind])).alias("score"))

        return F.transform(F.col(kind), one)

    return spans.select("doc_id", F.sort_array(F.concat(*[scored(k) for k in KINDS])).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts and a digest of the spans of every row, as one line of text; ``scores`` are those of the spans in
    the same order, in hundredths, and ``n_likely`` counts the spans with a score of at least ``LIKELY``."""
    rows = find_spans(docs)
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = F.filter("spans", lambda x: x["rank"] < 4)
    count = lambda rank: F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long")
    counts = [count(rank).alias(f"n_{k}") for rank, k in enumerate(KINDS[:4])]
    hundredths = F.transform("spans", lambda x: F.round(x["score"] * 100).cast("int").cast("string"))
    likely = F.size(F.filter("spans", lambda x: x["score"] >= LIKELY)).cast("long")
    return rows.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
                       F.concat_ws(",", hundredths).alias("scores"), likely.alias("n_likely"))
