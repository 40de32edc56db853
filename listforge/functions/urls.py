"""URL forms and identifiers held in URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listforge.functions import text as tx


def norm_url(c: Column) -> Column:
    """Page form: no fragment, no slash at the end."""
    return F.rtrim(norm_queue_url(c), F.lit("/"))


def norm_link(c: Column) -> Column:
    """Link form: no query, no fragment, no slash at the end."""
    return F.rtrim(F.substring_index(norm_queue_url(c), "?", 1), F.lit("/"))


def norm_queue_url(c: Column) -> Column:
    """Queue form: only the fragment is cut."""
    return F.substring_index(tx.strip_spaces(F.coalesce(c, F.lit(""))), "#", 1)


def is_chat_link(c: Column) -> Column:
    return c.contains("t.me/") | c.startswith("telegram://")


def external_links(links: Column) -> Column:
    """Normalized links of a listing that do not point back into a chat."""
    kept = F.filter(links, lambda x: x.isNotNull() & (tx.strip_spaces(x) != "") & ~is_chat_link(x))
    return F.transform(kept, norm_link)


def extract_urls(c: Column) -> Column:
    hits = F.regexp_extract_all(c, F.lit(r"(?iU)(https?://[^\s)\]>]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(hits, lambda u: F.regexp_replace(u, "[.,;]+$", "")), lambda u: u != ""))


def canonical_message_url(chat: Column, message: Column) -> Column:
    return F.concat(F.lit("telegram://"), chat.cast("string"), F.lit("/"), message.cast("string"))


def public_message_url(username: Column, message: Column) -> Column:
    return F.when(tx.empty_to_null(username).isNotNull(),
                  F.concat(F.lit("https://t.me/"), username, F.lit("/"), message.cast("string")))


def parse_message_url(c: Column) -> Column:
    pattern = r"^telegram://(-?\d+)/(\d+)$"
    return F.struct(tx.extract(c, pattern, 1).alias("chat_id"),
                    tx.extract(c, pattern, 2).try_cast("long").alias("message_id"))


CONTROL = r"(\d{14})-(\d)-(\d+)/(\d{4})"


@tx.bound
def control_number_url(c: Column) -> Column:
    """Public page of a control number 'CNPJ-x-seq/year'; other text is returned unchanged."""
    return F.when(c.rlike(CONTROL), F.concat(
        F.lit("https://pncp.gov.br/app/editais/"), F.regexp_extract(c, CONTROL, 1), F.lit("/"),
        F.regexp_extract(c, CONTROL, 4), F.lit("/"), F.regexp_extract(c, CONTROL, 3).try_cast("long").cast("string")
    )).otherwise(c)


@tx.bound
def control_number(c: Column) -> Column:
    """Control number held in a text, sequence padded to six digits."""
    seq = F.regexp_extract(c, CONTROL, 3).try_cast("long").cast("string")
    padded = F.when(F.length(seq) < 6, F.lpad(seq, 6, "0")).otherwise(seq)
    return F.when(c.rlike(CONTROL), F.concat(
        F.regexp_extract(c, CONTROL, 1), F.lit("-"), F.regexp_extract(c, CONTROL, 2), F.lit("-"), padded,
        F.lit("/"), F.regexp_extract(c, CONTROL, 4)))


def proposal_link(electronic: Column, origin: Column, public: Column) -> Column:
    """struct<url, kind> of the first link that exists."""
    kind = F.when(electronic.isNotNull(), "processo_eletronico").when(origin.isNotNull(), "sistema_origem").otherwise("pncp")
    return F.struct(F.coalesce(electronic, origin, public).alias("url"), kind.alias("kind"))


def with_scheme(c: Column) -> Column:
    return tx.let(tx.clean_text(c), lambda text: F.when(text.rlike("^https?://"), text).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(text, "^/+", ""))))


def primary_url(public_url: Column, url: Column) -> Column:
    return F.coalesce(tx.empty_to_null(tx.strip_spaces(public_url)), tx.empty_to_null(tx.strip_spaces(url)))


@tx.bound
def absolute_url(href: Column, page_url: Column) -> Column:
    """href made absolute against the page's scheme and host."""
    root = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(page_url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    folder = F.regexp_extract(F.regexp_replace(page_url, r"[?#].*$", ""), r"^(.*/)[^/]*$", 1)
    folder = F.when(F.length(folder) <= F.length(scheme) + 2, F.concat(root, F.lit("/"))).otherwise(folder)
    return (F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(root, href))
            .otherwise(F.concat(folder, href)))
