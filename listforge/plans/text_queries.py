"""Text functions over documents, pages and listing texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from listforge.functions import messages as ms, text as tx
from listforge.plans.registry import query

DOC = "SELECT doc_id, {} AS v FROM documents"
ACCENTED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
FOLD = f"translate(text, '{ACCENTED}', '{PLAIN}')"
# white space as Unicode sees it; RE2's own class is ASCII only
WS = "[\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
COLLAPSED = f"trim(regexp_replace(text, '{WS}+', ' ', 'g'))"
TOKEN = f"trim(regexp_replace(regexp_replace(lower({FOLD}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
TOKEN_AS_IS = f"trim(regexp_replace(regexp_replace(lower({FOLD}), '[^a-z0-9\\s]', ' ', 'g'), '\\s{{2,}}', ' ', 'g'))"


def _doc(name, fn, sql):
    @query(name, DOC.format(sql))
    def run(t):
        return t.documents.select("doc_id", fn(F.col("text")).alias("v"))


_doc("clean_text", tx.clean_text, f"nullif({COLLAPSED}, '')")
_doc("clean_title", lambda c: tx.clean_title(c, True), f"upper({COLLAPSED}[1]) || translate({COLLAPSED}[2:], '—–', '--')")
_doc("ascii_fold", tx.ascii_fold, FOLD)
_doc("norm_token", tx.norm_token, TOKEN_AS_IS)
_doc("match_text", tx.match_text, f"CASE WHEN {TOKEN} = '' THEN '' ELSE ' ' || {TOKEN} || ' ' END")
_doc("upper_ratio", tx.upper_ratio, """CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 THEN 0.0
ELSE length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) END""")
_doc("multiline_clean", tx.multiline_clean, f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
regexp_replace(translate(translate(text, chr(160) || '*', '  '), chr(13) || chr(9), chr(10) || ' '), '[ \\t]{{2,}}', ' ', 'g'),
'[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'),
'^{WS}+|{WS}+$', '', 'g')""")

# the semicolon of &amp may be missing, as HTML allows
ENT = "regexp_replace(replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"


@query("unescape_html", f"SELECT page_id, {ENT.format('html')} AS v FROM pages")
def unescape_html(t):
    return t.pages.select("page_id", tx.unescape_html(F.col("html")).alias("v"))


SQUEEZE = f"nullif(trim(regexp_replace(regexp_replace(regexp_replace(@TEXT@, '(?is)<\\s*br\\s*/?\\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '{WS}+', ' ', 'g')), '')"
DECODED = ENT.format("html")


@query("clean_description", f"SELECT page_id, {SQUEEZE.replace('@TEXT@', f"replace(translate({DECODED}, '—–', '--'), '?', '')")} AS v FROM pages")
def clean_description(t):
    return t.pages.select("page_id", tx.clean_description(F.col("html")).alias("v"))


@query("clean_description_ingest", f"SELECT page_id, {SQUEEZE.replace('@TEXT@', DECODED)} AS v FROM pages")
def clean_description_ingest(t):
    return t.pages.select("page_id", tx.clean_description_ingest(F.col("html")).alias("v"))


@query("html_to_text", f"""SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
regexp_replace(regexp_replace({DECODED}, '(?i)</p>', chr(10) || chr(10), 'g'), '(?i)</li>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
'[ \\t]+', ' ', 'g'), '\\n{WS}*\\n+', chr(10) || chr(10), 'g'), '{WS}+\\n', chr(10), 'g'), '\\n{WS}+', chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g'), '') AS v FROM pages""")
def html_to_text(t):
    return t.pages.select("page_id", tx.html_to_text(F.col("html")).alias("v"))


# Texts with emoji, bullets and stars are made around the part names.

@query("strip_emoji", """SELECT p_partkey, trim(p_name || ' ' || '- ' || p_type || ' |') AS v FROM part""")
def strip_emoji(t):
    return t.part.select("p_partkey", tx.strip_emoji(F.expr("concat('🔥 ', p_name, '* ✅', chr(160), '• - ', p_type, ' | ')")).alias("v"))


@query("clean_line", "SELECT p_partkey, p_name || ' - ' || p_type AS v FROM part")
def clean_line(t):
    return t.part.select("p_partkey", tx.clean_line(F.expr("concat('• - 🔥', p_name, '** - ✅', p_type, ' | :')")).alias("v"))


@query("drop_noise_lines", """SELECT p_partkey, p_name || chr(10) || 'Ramo ' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'ok ' || p_size ELSE '' END AS v FROM part""")
def drop_noise_lines(t):
    text = F.expr("""concat('- ', p_name, '\\nQuero me Candidatar\\n#tag\\nPublicada hoje\\n', upper(p_name), '\\nRamo ', p_type, ' |\\n3 Vagas\\n\\n',
        CASE WHEN p_size % 2 = 0 THEN concat('ok ', p_size) ELSE 'Nível: ' || p_type END)""")
    return t.part.select("p_partkey", tx.drop_noise_lines(text).alias("v"))


@query("about_requirements_text", """SELECT p_partkey, p_name || '. O que você vai fazer: ' || p_type || '; tarefa ' || p_size || '.' AS about,
'Requisitos: ' || p_name || '; ' || p_type || '. Sabe mais.' AS wanted FROM part""")
def about_requirements_text(t):
    about = F.expr("concat('Sobre a vaga\\n', p_name, '\\nO que você vai fazer\\n', p_type, ';\\ntarefa ', p_size, '.')")
    wanted = F.expr("concat('Requisitos\\n', p_name, '\\nNível alto\\n', p_type, '\\nSabe mais.')")
    return t.part.select("p_partkey", tx.about_text(tx.lines_of(about)).alias("about"), tx.requirements_text(tx.lines_of(wanted)).alias("wanted"))


@query("brand_case", """SELECT p_partkey, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1])
|| split_part(p_name, ' ', 2)[2:] || ' ' || p_type || ' SAP Back-End QA' AS v FROM part""")
def brand_case(t):
    return t.part.select("p_partkey", tx.brand_case(F.expr("concat(p_name, ' ', p_type, ' sap back-end qa')")).alias("v"))


@query("slug_title", """SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')
|| ' ' || p_size AS v FROM part""")
def slug_title(t):
    url = F.expr("concat('https://x.example/vagas/', replace(p_name, ' ', '-'), '_', p_size, '/')")
    return t.part.select("p_partkey", tx.slug_title(url).alias("v"))


@query("title_case", """SELECT p_partkey, 'São-José D''Oeste ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] AS v FROM part""")
def title_case(t):
    return t.part.select("p_partkey", tx.title_case(F.expr("concat('SÃO-josé d\\'oeste ', split(p_name, ' ')[0])")).alias("v"))


@query("title_split", """SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_brand END AS company,
CASE WHEN p_size % 3 > 0 THEN p_name || ': ' || p_type END AS title FROM part""")
def title_split(t):
    text = F.expr("CASE WHEN p_size % 3 > 0 THEN concat(' ', p_brand, ':  ', p_name, ': ', p_type) ELSE p_name END")
    return t.part.select("p_partkey", tx.title_split(text).alias("s")).select("p_partkey", "s.company", "s.title")


@query("title_suffix_strip", "SELECT p_partkey, p_name AS v FROM part")
def title_suffix_strip(t):
    suffix = F.expr("CASE p_size % 4 WHEN 0 THEN ' - NOVA' WHEN 1 THEN concat(' - R$ ', p_size, '.000,00') WHEN 2 THEN concat(' - ', p_size, ' | XYZ') ELSE '' END")
    return t.part.select("p_partkey", tx.title_suffix_strip(F.concat(F.col("p_name"), suffix)).alias("v"))


@query("sentence_join", """SELECT p_partkey, 'Peça: ' || p_name || '.' || CASE WHEN p_size % 2 = 0 THEN ' Tipo: ' || p_type || '!' ELSE '' END
|| ' Marca: ' || p_brand || '.' AS v FROM part""")
def sentence_join(t):
    kind = F.expr("CASE WHEN p_size % 2 = 0 THEN concat(p_type, '!') ELSE '  ' END")
    return t.part.select("p_partkey", tx.sentence_join(("Peça", F.col("p_name")), ("Tipo", kind), ("Marca", F.concat(F.lit(" "), "p_brand"))).alias("v"))


@query("join_parts", """SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || p_type ELSE '' END AS v FROM part""")
def join_parts(t):
    return t.part.select("p_partkey", tx.join_parts(F.col("p_name"), F.lit(""), F.expr("CASE WHEN p_size % 2 = 0 THEN p_type END"), F.col("p_name")).alias("v"))


@query("generated_title", """SELECT p_partkey, p_type || CASE WHEN p_size % 5 = 0 THEN ' à venda' ELSE ' com ' || CASE WHEN p_size % 7 BETWEEN 1 AND 4
THEN (p_size % 7) || ' quartos' ELSE '5 quartos ou +' END || ' à venda em ' || p_name || ', ' || p_brand END AS v FROM part""")
def generated_title(t):
    place = [F.expr(f"CASE WHEN p_size % 5 > 0 THEN {c} END") for c in ("p_name", "p_brand")]
    return t.part.select("p_partkey", tx.generated_title(F.col("p_type"), F.expr("p_size % 7"), *place).alias("v"))


@query("street_text", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || ', ' || p_size || ' - ' || p_brand WHEN 1 THEN p_name || ' - ' || p_brand ELSE p_brand END AS v FROM part""")
def street_text(t):
    street = F.expr("CASE WHEN p_size % 3 < 2 THEN concat(' ', p_name) END")
    number = F.expr("CASE WHEN p_size % 3 = 0 THEN cast(p_size as string) END")
    return t.part.select("p_partkey", tx.street_text(street, number, F.col("p_brand")).alias("v"))


@query("format_description", """SELECT p_partkey, p_name || '.' || chr(10) || chr(10) || 'Tipo & ' || p_type || '!' || chr(10) || chr(10) || '• ' || p_brand AS v FROM part""")
def format_description(t):
    text = F.expr("concat('<p>', p_name, '?. Tipo &amp; ', p_type, '!</p><ul><li>', p_brand, '</li></ul>\\t')")
    return t.part.select("p_partkey", tx.format_description(text).alias("v"))


@query("message_shape", """SELECT message_id, CAST(0 AS INTEGER) AS links, CAST(len(list_filter(string_split(text, chr(10)), lambda x:
regexp_matches(lower(x), 'desenvolvedor|developer|engenheiro|engineer|software|backend|back-end|frontend|front-end|fullstack|full stack|mobile|ios|android|react|angular|vue|node|python|java|golang|go |php|laravel|django|flask|ruby|rails|devops|sre|cloud|dados|data engineer|data scientist|machine learning|consultor|sap|abap|pmo|qa|tester|tech lead|arquiteto de software|ti')))
AS INTEGER) AS role_lines FROM messages_v""", "messages_v")
def message_shape(t):
    return t.messages_v.select("message_id", ms.message_shape(F.col("text")).alias("s")).select("message_id", "s.links", "s.role_lines")


@query("caption_sanitize", """SELECT p_partkey, p_name || chr(10) || 'Contato: ' || replace(p_name, ' ', '.') || '@x.co' || chr(10) || 'https://a.example/' || p_partkey AS v FROM part""")
def caption_sanitize(t):
    text = F.expr("concat(p_name, '\\nEnvie seu CV para ', replace(p_name, ' ', '.'), '@x.co ou https://a.example/', p_partkey, '.\\n* ', p_name)")
    return t.dealt("part").select("p_partkey", ms.caption_sanitize(text).alias("v"))


@query("ocr_card_text", """SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_name || chr(10) || 'Cidade: ' || p_type || chr(10) || 'Nível: alto' || chr(10) || chr(10) ||
'turno ' || p_size || chr(10) || chr(10) || 'Requisitos:' || chr(10) || '- ' || p_brand || chr(10) || '- mais' || chr(10) || chr(10) || 'Observações:' || chr(10) || 'fim' END AS v FROM part""")
def ocr_card_text(t):
    text = F.expr("""CASE WHEN p_size % 4 > 0 THEN concat(p_name, '\\nCidade: ', p_type, ' Nivel: alto\\nturno ', p_size, '\\nRequisitos: ', p_brand, ';\\n• mais\\nOBS: fim')
        ELSE concat(p_name, '\\nCidade: ', p_type) END""")
    return t.dealt("part").select("p_partkey", ms.ocr_card_text(text).alias("v"))
