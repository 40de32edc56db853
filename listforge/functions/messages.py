"""Chat messages -> title, company, place, dedupe key and description text.

The line rules work on arrays of lines inside the row: one rule expression is applied to every
line and the first answer in line order wins.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from listforge import fixed_values as fv
from listforge.functions import classify as cl, geo, text as tx, urls

DASH_SPLIT = r"(?U)\s+[–—-]\s+"
REMOTE_MARK = r"(?iU)\b(?:100%\s*)?(?:remoto|remote|home office|híbrido|hibrido)\b"


def clean_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r"), tx.clean_line), lambda x: x != "")


def first_answer(lines: Column, rule) -> Column:
    """First non-null result of a rule over the lines."""
    return F.try_element_at(F.filter(F.transform(lines, rule), lambda x: x.isNotNull()), F.lit(1))


def message_shape(c: Column) -> Column:
    """struct<links, role_lines>: number of web links and of lines that hold a tech keyword."""
    lines = F.transform(F.split(c, r"\r\n|\n|\r"), lambda x: F.lower(tx.clean_line(x)))
    roles = F.filter(lines, lambda x: tx.contains_any(x, fv.TECH_KEYWORDS["chat"]))
    return F.struct(F.regexp_count(c, F.lit(r"(?i)https?://")).alias("links"), F.size(roles).alias("role_lines"))


def message_candidate(c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    return tx.contains_any(text, fv.TECH_KEYWORDS["chat"]) & tx.contains_any(text, fv.CHAT_REMOTE_WORDS)


def message_aggregate(c: Column) -> Column:
    """Posts that announce many jobs at once."""
    text = F.lower(c)
    shape = message_shape(c)
    return (tx.contains_any(text, fv.CHAT_GENERIC_HEADERS + fv.CHAT_AGGREGATE_PHRASES)
            | (shape["links"] >= 3) | (shape["role_lines"] >= 4))


def compose_text(body: Column, ocr: Column) -> Column:
    return F.trim(F.concat_ws("\n\n", tx.empty_to_null(tx.multiline_clean(body)), tx.empty_to_null(tx.multiline_clean(ocr))))


# --- title -----------------------------------------------------------------------------------
def format_title(c: Column) -> Column:
    """Brand spelling of a title; mostly upper-case titles are brought to title case first."""
    cleaned = F.regexp_replace(F.regexp_replace(tx.strip_emoji(c), r"(?U)\s{2,}", " "), r"^[ \-|:]+|[ \-|:]+$", "")
    return tx.let(cleaned, lambda t: F.when(t == "", fv.CHAT_DEFAULT_TITLE).otherwise(tx.brand_case(
        F.when(tx.upper_ratio(t) >= 0.7, tx.title_case(t)).otherwise(tx.upper_first(t)))))


def role_candidate(c: Column) -> Column:
    """Role phrase found by the first pattern that matches anywhere in the text."""
    found = tx.let(tx.clean_line(c), lambda t: F.coalesce(*[tx.extract(t, p) for p in fv.CHAT_ROLE_PATTERNS]))
    cut = F.regexp_replace(found, r"(?isU)\s+(?:requisitos?|must-haves?|must have|inicio|início|duração|duracao|link"
                                  r"|candidate-se|candidatar)\b.*$", "")
    return tx.empty_to_null(tx.clean_line(tx.replace_all(cut, (REMOTE_MARK, ""), (r"\b20\d{2}\b", ""))))


def _title_of_line(line: Column) -> Column:
    low = F.lower(line)
    role = tx.extract(line, r"(?iU)(?:atuação como|atuacao como|vaga abaixo[:\s-]*|posição para|position for)\s+(.+?)(?:[.!]|$)")
    prefix = r"(?iU)^(?:" + "|".join(fv.CHAT_TITLE_PREFIXES) + ")"
    after_colon = tx.empty_to_null(tx.clean_line(F.regexp_extract(line, prefix + r":(.*)$", 1)))
    after_blank = tx.empty_to_null(F.trim(F.split(tx.clean_line(F.regexp_extract(line, prefix + r" (.*)$", 1)), DASH_SPLIT)[0]))
    plain = F.when(~tx.starts_with_any(low, fv.CHAT_IGNORED_LINE_PREFIXES)
                   & tx.contains_any(low, fv.TECH_KEYWORDS["chat"]) & (F.length(line) >= 6), line)
    skipped = low.rlike("^https?://") | tx.contains_any(low, fv.CHAT_GENERIC_HEADERS)
    return F.when(~skipped, F.coalesce(role, after_colon, after_blank, plain))


def link_title(links: Column) -> Column:
    """Words of the last path segment of a job-portal link."""
    def words(link: Column) -> Column:
        slug = F.lower(tx.extract(F.regexp_replace(link, r"[?#].*$|/+$", ""), r"^https?://[^/]*vagasdeempregoce\.com/(?:.*/)?([^/]+)$"))
        tokens = F.filter(F.split(slug, "-"), lambda t: (t != "") & ~tx.one_of(t, fv.CHAT_TITLE_URL_STOPWORDS))
        return tx.empty_to_null(F.array_join(tokens, " "))

    return first_answer(links, words)


def message_title(c: Column, links: Column) -> Column:
    """Line rules, else role patterns, else a link slug, else the first line, else a default."""
    def pick(lines: Column) -> Column:
        first = F.try_element_at(lines, F.lit(1))
        fallback = F.when(F.lower(first).rlike("^https?://"), link_title(links)).otherwise(first)
        return F.coalesce(first_answer(lines, _title_of_line), role_candidate(c), link_title(links), fallback, F.lit(""))

    return format_title(tx.let(clean_lines(c), pick))


def refine_title(title: Column, c: Column, links: Column, company: Column) -> Column:
    """Final title: no link, no remote marks, no years, no company name."""
    role = role_candidate(c)

    def refine(s: Column) -> Column:
        t = F.when(F.lower(s["t"]).rlike("^https?://"), F.coalesce(s["role"], link_title(links), F.lit(fv.CHAT_DEFAULT_TITLE))).otherwise(s["t"])
        vague = (tx.starts_with_any(F.lower(t), fv.CHAT_GENERIC_TITLE_PREFIXES) | (F.length(t) > 110)
                 | F.lower(t).contains("linkedin")) & s["role"].isNotNull()
        t = tx.replace_all(F.when(vague, s["role"]).otherwise(t), (REMOTE_MARK, ""), (r"\b20\d{2}\b", ""))
        name = F.concat(F.lit(r"(?iU)(?:\bna\s+)?\b\Q"), s["company"], F.lit(r"\E\b"))
        t = F.when(s["company"].isNotNull(), F.regexp_replace(t, name, F.lit(""))).otherwise(t)
        t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s{2,}", " "), r"^[ \-|:/]+|[ \-|:/]+$", "")
        return format_title(t)

    return tx.let(F.struct(tx.strip_emoji(title).alias("t"), role.alias("role"), company.alias("company")), refine)


# --- place -----------------------------------------------------------------------------------
def place_text(c: Column) -> Column:
    parts = F.split(tx.clean_line(c), DASH_SPLIT)
    last = F.regexp_replace(F.element_at(parts, -1), r"(?iU)^(?:presencial\s+em|em|na|no|local(?:ização)?|cidade|atuação)\s*:?\s*", "")
    return F.regexp_replace(F.regexp_replace(last, r"(?U)\s{2,}", " "), r"^[ \-|:/]+|[ \-|:/]+$", "")


def plausible_city(c: Column) -> Column:
    """At most 45 characters and six words, none of them a noise word, not itself a state."""
    def judge(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit("([a-zà-ÿ']+)"), F.lit(1))
        return ((t != "") & ~tx.one_of(t, fv.CHAT_BAD_LOCATIONS) & (F.length(t) <= 45) & F.size(words).between(1, 6)
                & ~F.exists(words, lambda w: tx.one_of(w, fv.CHAT_LOCATION_NOISE))
                & ~tx.one_of(t, list(fv.STATE_NAMES)) & ~tx.one_of(F.upper(t), fv.UFS))

    return tx.let(F.lower(place_text(c)), judge)


def message_location(c: Column) -> Column:
    """struct<city, state> of the first line and pattern with a plausible city and a real state."""
    def of_line(line: Column) -> Column:
        def by(pattern: str) -> Column:
            found = F.struct(tx.title_case(place_text(F.regexp_extract(line, pattern, 1))).alias("city"),
                             F.upper(F.regexp_extract(line, pattern, 2)).alias("state"))
            return tx.let(found, lambda s: F.when(tx.one_of(s["state"], fv.UFS) & plausible_city(s["city"]), s))

        return F.coalesce(*[by(p) for p in fv.CHAT_LOCATION_PATTERNS])

    return first_answer(clean_lines(c), of_line)


# --- company ---------------------------------------------------------------------------------
def clean_company(c: Column) -> Column:
    """Company name without labels, mail domains, work-mode words and anything after a section word."""
    def tidy(t: Column) -> Column:
        domain = tx.extract(t, r"(?i)[A-Z0-9._%+-]+@([A-Z0-9-]+)\.[A-Z0-9.-]*[A-Z]{2,}")
        named = F.when(domain.isNotNull() & ~F.lower(domain).isin(fv.CHAT_MAIL_HOSTS), F.translate(domain, "-_", "  ")).otherwise(t)
        body = tx.replace_all(
            named,
            (r"(?isU)\b(?:atuação|atuacao|contratação|contratacao|requisitos?|responsabilidades|modelo|modalidade"
             r"|com\s+cliente|cliente|fuso|horário|horario)\b.*$", ""),
            (r"(?iU)\b(?:remoto|remote|presencial|hibrido|híbrido|clt|pj)\b", ""),
            (r"(?iU)\b(?:whatsapp|zap|bairro|email|cv|curr[íi]culo|enviar|mandar|link)\b.*$", ""),
            (r"(?U)\s{2,}", " "), (r"^[ \-|:]+|[ \-|:]+$", ""))
        return tx.let(body, accept)

    def accept(t: Column) -> Column:
        bare = tx.replace_all(t, (r"(?i)^www\.", ""), (r"(?i)\.(?:com|com\.br|io|ai|dev|tech|pt|net|org)$", ""))
        return tx.let(bare, lambda b: F.when(
            ~tx.one_of(F.lower(t), fv.CHAT_NON_COMPANY) & ~F.lower(b).contains("http") & ~b.contains("@")
            & (F.size(F.split(F.trim(b), r"\s+")) <= 6) & (F.length(F.trim(b)) >= 3), tx.brand_case(b)))

    line = F.regexp_replace(tx.clean_line(c), r"(?iU)^(?:empresa|cliente|company|contratante)\s*:?\s*", "")
    return tx.empty_to_null(tx.let(line, tidy))


def _company_of_line(line: Column) -> Column:
    labelled = tx.extract(line, r"(?iU)^(?:" + "|".join(fv.CHAT_COMPANY_PREFIXES) + r"):(.*)$")
    return F.coalesce(F.when(labelled.isNotNull(), tx.clean_line(labelled)),
                      *[clean_company(tx.extract(line, p)) for p in fv.CHAT_COMPANY_LINE_PATTERNS])


def _company_of_url(link: Column) -> Column:
    path = F.regexp_replace(tx.extract(link, r"^https?://[^/?#]+/([^?#]*)"), "/+$", "")
    host = F.lower(tx.extract(link, r"^https?://([^/?#]+)"))
    slug = F.lower(F.element_at(F.split(path, "/"), -1))
    group = F.regexp_replace(F.regexp_replace(slug, "-oferta.*$", ""), "^grupo-", "")

    def after_role(words: Column) -> Column:
        """Words of a slug after its last role word."""
        roles = F.reverse(F.transform(words, lambda w: tx.one_of(w, fv.CHAT_ROLE_WORDS)))
        last = F.array_position(roles, True).cast("int")
        return F.when(last > 0, F.slice(words, F.size(words) - last + 2, last)).otherwise(words)

    words = F.filter(F.split(slug, "-"), lambda w: (w != "") & ~tx.one_of(w, fv.CHAT_COMPANY_STOPWORDS))
    plain = F.array_join(tx.let(words, after_role), " ")
    return (F.when(host.contains("jobs.quickin.io"), clean_company(F.translate(F.split(path, "/")[0], "-_", "  ")))
            .when(host.contains("work.vetto.ai"), "Vetto")
            .when(host.contains("vagasdeempregoce.com"), clean_company(
                F.when(slug.startswith("grupo-"), F.translate(group, "-", " ")).otherwise(plain))))


def message_company(c: Column, links: Column, title: Column) -> Column:
    """Ordered rules: labelled or phrased line, first-line parts, verb phrase, mail domain, title, link host."""
    first_line = tx.clean_line(F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r")[0])

    def of_first(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(line, DASH_SPLIT), tx.clean_line), lambda p: p != "")
        last = F.try_element_at(parts, F.lit(-1))
        tail = F.when((F.size(parts) >= 2) & ~plausible_city(last),
                      F.when(last == F.upper(last), last).otherwise(tx.title_case(last)))
        return F.coalesce(tail, clean_company(tx.extract(line, fv.CHAT_COMPANY_FIRST_LINE_PATTERN)))

    domain = tx.extract(c, r"@([A-Za-z0-9-]+)\.[A-Za-z0-9.-]*[A-Za-z]{2,}")
    mail = F.when(~F.lower(domain).isin(fv.CHAT_MAIL_HOSTS), tx.brand_case(F.translate(domain, "-_", "  ")))
    return tx.empty_to_null(F.coalesce(
        first_answer(clean_lines(c), _company_of_line), tx.let(first_line, of_first),
        clean_company(tx.extract(c, fv.CHAT_COMPANY_VERB_PATTERN)), mail,
        clean_company(tx.extract(tx.clean_line(title), fv.CHAT_COMPANY_TITLE_PATTERN)),
        first_answer(links, _company_of_url)))


def header_fields(c: Column) -> Column:
    """struct<title, company, place> read from the first line 'Role - Company - City / UF'."""
    first = F.try_element_at(clean_lines(c), F.lit(1))

    def read(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(line, DASH_SPLIT), tx.clean_line), lambda p: p != "")
        head = F.regexp_replace(F.try_element_at(parts, F.lit(1)),
                                r"(?iU)^(?:vaga|cargo|posição|position|oportunidade|job)\s*:?[\s-]*", "")
        rest = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: message_location(p).isNull())
        return F.struct(F.when(head != "", format_title(head)).alias("title"),
                        clean_company(F.try_element_at(rest, F.lit(-1))).alias("company"),
                        message_location(line).alias("place"))

    return tx.let(first, read)


def message_dedupe_key(title: Column, company: Column, c: Column, links: Column) -> Column:
    """'link:' + first external link, else 'text:' + 24 hex digits of a fingerprint."""
    link = F.try_element_at(urls.external_links(links), F.lit(1))
    print_ = F.concat_ws("|", tx.norm_token(F.coalesce(title, F.lit(""))), tx.norm_token(F.coalesce(company, F.lit(""))),
                         tx.norm_token(F.substring(F.coalesce(c, F.lit("")), 1, 280)))
    return F.when(link.isNotNull(), F.concat(F.lit("link:"), link)).otherwise(
        F.concat(F.lit("text:"), F.substring(F.sha2(print_, 256), 1, 24)))


# --- description -----------------------------------------------------------------------------
def caption_sanitize(c: Column) -> Column:
    """Promotional lines go, but their e-mail address and links stay; distinct lines."""
    def of_line(line: Column) -> Column:
        mail = geo.find_email(line)
        kept = F.concat(F.when(mail.isNotNull(), F.array(F.concat(F.lit("Contato: "), mail))).otherwise(
            F.array().cast("array<string>")), urls.extract_urls(line))
        return F.when(tx.contains_any(F.lower(line), fv.CHAT_PROMO_PHRASES), kept).otherwise(F.array(line))

    return tx.empty_to_null(F.array_join(F.array_distinct(F.flatten(F.transform(clean_lines(c), of_line))), "\n"))


CARD_LABELS = [("Cidade", "cidade"), ("Nível", "n[ií]vel"), ("Duração", "dura(?:ção|cao)"), ("Idioma", "idioma"),
               ("Requisitos", "requisitos"), ("Observações", "obs(?:erva(?:ções|coes))?")]
CARD_LINE = r"(?iU)^(cidade|n[ií]vel|dura(?:ção|cao)|idioma|requisitos|obs|observa(?:ções|coes))(?:\s*:\s*(.*))?$"


def ocr_card_text(c: Column) -> Column:
    """Labelled text read from an image as a card: title, metadata, other lines, requirements,
    observations; null with fewer than two labels."""
    broken = F.regexp_replace(tx.multiline_clean(c), r"(?iU)\s+(?=(?:Cidade|N[ií]vel|Dura(?:ção|cao)|Idioma|Requisitos"
                                                     r"|OBS|Observa(?:ções|coes))\s*:)", "\n")

    def label(line: Column) -> Column:
        return tx.first_pattern(F.lower(F.regexp_extract(line, CARD_LINE, 1)), [(n, f"^{p}$") for n, p in CARD_LABELS])

    def read(lines: Column) -> Column:
        entries = F.transform(lines, lambda x, i: F.struct(
            i.alias("i"), x.alias("text"), F.when((i > 0) | label(x).isNotNull(), label(x)).alias("label"),
            tx.clean_line(F.regexp_extract(x, CARD_LINE, 2)).alias("value")))
        return tx.let(entries, arrange)

    def arrange(es: Column) -> Column:
        # a section is a label and the lines up to the next one; metadata labels close a section
        def sections(marks: Column) -> Column:
            named = lambda part, label: F.transform(part, lambda e: F.struct(
                e["i"].alias("i"), e["label"].alias("label"), label.alias("section"),
                F.when(e["label"].isNotNull(), e["value"]).otherwise(e["text"]).alias("text")))
            until = lambda at: F.coalesce(F.get(marks, at)["i"], F.size(es))
            head = named(F.slice(es, F.lit(1), until(F.lit(0))), F.lit(None).cast("string"))
            return F.concat(head, F.flatten(F.transform(marks, lambda m, at: named(F.slice(es, m["i"] + 1, until(at + 1) - m["i"]), m["label"]))))

        def bullet(t: Column) -> Column:
            return F.regexp_replace(F.regexp_replace(tx.clean_line(t), r"^[\-•·▪▫]+\s*", ""), "^[ ;]+|[ ;]+$", "")

        title = F.when(es[0]["label"].isNull(), es[0]["text"])
        body = F.filter(tx.let(F.filter(es, lambda e: e["label"].isNotNull()), sections), lambda e: (e["i"] > 0) | e["label"].isNotNull())
        meta = F.transform(F.filter(body, lambda e: e["label"].isin("Cidade", "Nível", "Duração", "Idioma")),
                           lambda e: F.when(e["text"] != "", F.concat(e["label"], F.lit(": "), e["text"])).otherwise(
                               F.concat(e["label"], F.lit(":"))))
        wants = F.filter(F.transform(F.filter(body, lambda e: e["section"] == "Requisitos"), lambda e: bullet(e["text"])), lambda t: t != "")
        notes = F.filter(F.transform(F.filter(body, lambda e: e["section"] == "Observações"), lambda e: e["text"]), lambda t: t != "")
        other = F.transform(F.filter(body, lambda e: e["label"].isNull() & ~F.coalesce(
            e["section"].isin("Requisitos", "Observações"), F.lit(False))), lambda e: e["text"])
        parts = F.concat(
            F.array(title), meta,
            F.when(F.size(other) > 0, F.concat(F.array(F.lit("")), other)).otherwise(F.array().cast("array<string>")),
            F.when(F.size(wants) > 0, F.concat(F.array(F.lit(""), F.lit("Requisitos:")), F.transform(
                wants, lambda t: F.concat(F.lit("- "), t)))).otherwise(F.array().cast("array<string>")),
            F.when(F.size(notes) > 0, F.concat(F.array(F.lit(""), F.lit("Observações:")), notes)).otherwise(
                F.array().cast("array<string>")))
        labels = F.size(F.filter(es, lambda e: e["label"].isNotNull()))
        return F.when(title.isNotNull() & (labels >= 2), F.array_join(parts, "\n"))

    return tx.let(clean_lines(broken), lambda ls: F.when(F.size(ls) >= 2, read(ls)))


def description_text(body: Column, ocr: Column, fallback: Column) -> Column:
    card = ocr_card_text(ocr)
    return F.when(card.isNotNull(), F.concat_ws("\n\n", card, caption_sanitize(body))).otherwise(fallback)


def classify_message(c: Column) -> Column:
    return F.struct(cl.seniority_substr(c).alias("seniority"), cl.contract_type_infer(c).alias("contract_type"),
                    cl.work_model_infer(c).alias("work_model"))
