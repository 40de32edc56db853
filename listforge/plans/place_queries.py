"""Places, coordinates, contacts and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from listforge.functions import geo, urls
from listforge.operators import rollups as ro
from listforge.plans.registry import query

P = ("places_v",)
CITY = "CASE town WHEN 'campinas' THEN 'Campinas' WHEN 'são josé' THEN 'São José' WHEN 'belo vale' THEN 'Belo Vale' ELSE 'Ouro Preto' END"
NAME = "CASE uf WHEN 'SP' THEN 'São Paulo' WHEN 'RJ' THEN 'Rio de Janeiro' WHEN 'MG' THEN 'Minas  Gerais' WHEN 'BA' THEN 'BAHIA' ELSE 'Lisboa' END"


@query("state_uf", "SELECT id, CASE WHEN uf <> 'XX' THEN uf END AS a, CASE WHEN uf <> 'XX' THEN uf END AS b FROM places_v", P)
def state_uf(t):
    return t.places_v.select("id", geo.state_uf(F.expr("concat('zz ', lower(uf), '.')")).alias("a"), geo.state_uf(F.expr(f"concat('Estado: ', {NAME})")).alias("b"))


@query("city_state", f"SELECT id, CASE WHEN uf <> 'XX' THEN {CITY} END AS city, CASE WHEN uf <> 'XX' THEN uf END AS state FROM places_v", P)
def city_state(t):
    text = F.expr("concat('em ', town, CASE id % 3 WHEN 0 THEN ' - ' WHEN 1 THEN '/' ELSE ', ' END, uf)")
    return t.places_v.select("id", geo.city_state(text).alias("s")).select("id", "s.city", "s.state")


@query("fill_location", f"""SELECT id, CASE WHEN id % 2 = 0 THEN 'Natal' WHEN uf <> 'XX' THEN {CITY} END AS city,
CASE WHEN id % 3 = 0 THEN 'RN' WHEN uf <> 'XX' THEN uf END AS state FROM places_v""", P)
def fill_location(t):
    s = geo.fill_location(F.expr("CASE WHEN id % 2 = 0 THEN ' Natal ' ELSE ' ' END"), F.expr("CASE WHEN id % 3 = 0 THEN 'Rio Grande do Norte' END"),
                          F.expr("concat(town, ' - ', uf)"))
    return t.places_v.select("id", s.alias("s")).select("id", "s.city", "s.state")


@query("maps_coords", """SELECT id, CASE WHEN id % 6 < 5 AND deg + 5.25 <= 90 THEN -(deg + 5.25) END AS latitude,
CASE WHEN id % 6 < 5 AND deg + 5.25 <= 90 THEN mnt + 0.5 END AS longitude FROM places_v WHERE id >= 0""", P)
def maps_coords(t):
    pair = "concat('-', deg + 5, '.25,', mnt, '.5')"
    text = F.expr(f"""CASE id % 6 WHEN 0 THEN concat('https://maps/@', {pair}, ',17z') WHEN 1 THEN concat('x!3d-', deg + 5, '.25!4d', mnt, '.5')
        WHEN 2 THEN concat('y?a=1&amp;q=loc:', {pair}) WHEN 3 THEN concat('/maps\\\\/search/', {pair})
        WHEN 4 THEN concat('embed?x=1\\\\u0026q=', {pair}) ELSE 'none' END""")
    return t.places_v.select("id", geo.maps_coords(text).alias("s")).select("id", "s.latitude", "s.longitude")


@query("dms_to_decimal", """SELECT id, round((deg + mnt / 60.0 + 30.5 / 3600) * CASE WHEN id % 3 = 0 THEN 1 ELSE -1 END, 9) AS v FROM places_v""", P)
def dms_to_decimal(t):
    text = F.expr("concat(deg, '° ', mnt, \"' 30,5'' \", CASE id % 3 WHEN 0 THEN 'N' WHEN 1 THEN 's' ELSE 'O' END)")
    return t.places_v.select("id", F.round(geo.dms_to_decimal(text), 9).alias("v"))


@query("maps_link", """SELECT id, CASE WHEN id % 3 = 0 THEN 'https://www.google.com/maps?q=' || deg || '.5,' || mnt || '.25'
WHEN id % 3 = 1 THEN 'https://www.google.com/maps/search/?api=1&query=' || replace(replace(replace(replace(town, ' ', '%20'), 'ã', '%C3%A3'), 'é', '%C3%A9'), 'ô', '%C3%B4') || '%2C%20' || uf END AS v FROM places_v""", P)
def maps_link(t):
    lat, lon = F.expr("CASE WHEN id % 3 = 0 THEN deg + 0.5D END"), F.expr("mnt + 0.25D")
    town, uf = F.expr("CASE WHEN id % 3 = 1 THEN town END"), F.expr("CASE WHEN id % 3 = 1 THEN uf END")
    return t.places_v.select("id", geo.maps_link(lat, lon, F.lit(None).cast("string"), town, uf, F.lit("")).alias("v"))


@query("find_email", "SELECT id, CASE WHEN id % 2 = 0 THEN 'rh.' || id || '@firma-x.com.br' END AS v FROM places_v", P)
def find_email(t):
    return t.places_v.select("id", geo.find_email(F.expr("CASE WHEN id % 2 = 0 THEN concat('envie (rh.', id, '@firma-x.com.br) ja, a@b') ELSE '@x' END")).alias("v"))


@query("find_phone", "SELECT id, CASE WHEN id % 2 = 0 THEN '(11) 9' || lpad(CAST(id AS VARCHAR), 8, '7')[1:4] || '-' || lpad(CAST(id AS VARCHAR), 8, '7')[5:8] END AS v FROM places_v", P)
def find_phone(t):
    return t.places_v.select("id", geo.find_phone(F.expr("CASE WHEN id % 2 = 0 THEN concat('fone: (11) 9', substr(lpad(id, 8, '7'), 1, 4), '-', substr(lpad(id, 8, '7'), 5, 4), ' ok') ELSE 'tel 123' END")).alias("v"))


@query("format_phone_br", """SELECT id, CASE id % 4 WHEN 0 THEN '(11) 9' || p[1:4] || '-' || p[5:8] WHEN 1 THEN '(11) ' || p[1:4] || '-' || p[5:8] WHEN 2 THEN '123' ELSE '—' END AS phone,
CASE WHEN id % 2 = 0 THEN p[1:5] || '-' || p[6:8] ELSE '—' END AS zip FROM (SELECT id, lpad(CAST(id AS VARCHAR), 8, '7') AS p FROM places_v)""", P)
def format_phone_br(t):
    phone = F.expr("CASE id % 4 WHEN 0 THEN concat('11 9', lpad(id, 8, '7')) WHEN 1 THEN concat('(11)', lpad(id, 8, '7')) WHEN 2 THEN '123' END")
    code = F.expr("CASE WHEN id % 2 = 0 THEN lpad(id, 8, '7') ELSE '' END")
    return t.places_v.select("id", geo.format_phone_br(phone).alias("phone"), geo.format_zip(code).alias("zip"))


@query("format_zip", "SELECT id, CASE WHEN id % 2 = 0 THEN p[1:2] || p[3:5] || '-' || p[6:8] ELSE 'x1' END AS zip FROM (SELECT id, lpad(CAST(id AS VARCHAR), 8, '7') AS p FROM places_v)", P)
def format_zip(t):
    code = F.expr("CASE WHEN id % 2 = 0 THEN concat(substr(lpad(id, 8, '7'), 1, 2), '.', substr(lpad(id, 8, '7'), 3, 6)) ELSE 'x1' END")
    return t.places_v.select("id", geo.format_zip(code).alias("zip"))


# --- URLs ------------------------------------------------------------------------------------
@query("norm_url", """SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS page_form,
regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS link_form, regexp_replace(url, '#.*$', '') AS queue_form FROM pages""")
def norm_url(t):
    u = F.concat(F.lit("  "), F.col("url"))
    return t.pages.select("page_id", urls.norm_url(u).alias("page_form"), urls.norm_link(u).alias("link_form"), urls.norm_queue_url(u).alias("queue_form"))


@query("extract_urls", """SELECT id, 'https://a.example/' || id || '|http://b.example/?q=' || town[1] AS v FROM places_v""", P)
def extract_urls(t):
    text = F.expr("concat('veja https://a.example/', id, '. e (http://b.example/?q=', substr(town, 1, 1), ') ou https://a.example/', id, ';')")
    return t.places_v.select("id", F.array_join(urls.extract_urls(text), "|").alias("v"))


@query("canonical_message_url", """SELECT message_id, 'telegram://' || chat_id || '/' || message_id AS url, CAST(chat_id AS VARCHAR) AS chat, message_id AS message,
CASE WHEN chat_id % 2 = 0 THEN 'https://t.me/c' || chat_id || '/' || message_id END AS public FROM messages_v""", "messages_v")
def canonical_message_url(t):
    df = t.messages_v.withColumn("url", urls.canonical_message_url(F.col("chat_id"), F.col("message_id")))
    back = urls.parse_message_url(F.col("url"))
    public = urls.public_message_url(F.expr("CASE WHEN chat_id % 2 = 0 THEN concat('c', chat_id) ELSE '' END"), F.col("message_id"))
    return df.select("message_id", "url", back["chat_id"].alias("chat"), back["message_id"].alias("message"), public.alias("public"))


@query("control_number", """SELECT id, 'https://pncp.gov.br/app/editais/' || lpad(CAST(id AS VARCHAR), 14, '1') || '/' || year(d) || '/' || (mnt + 1) AS url,
lpad(CAST(id AS VARCHAR), 14, '1') || '-1-' || lpad(CAST(mnt + 1 AS VARCHAR), 6, '0') || '/' || year(d) AS number FROM places_v""", P)
def control_number(t):
    raw = F.expr("concat(lpad(id, 14, '1'), '-1-00', mnt + 1, '/', year(d))")
    return t.places_v.select("id", urls.control_number_url(raw).alias("url"), urls.control_number(raw).alias("number"))


@query("proposal_link", """SELECT id, CASE WHEN id % 3 = 0 THEN 'https://e/' || id WHEN id % 2 = 0 THEN 'https://o/' || id ELSE 'https://p/' || id END AS url,
CASE WHEN id % 3 = 0 THEN 'processo_eletronico' WHEN id % 2 = 0 THEN 'sistema_origem' ELSE 'pncp' END AS kind FROM places_v""", P)
def proposal_link(t):
    s = urls.proposal_link(urls.with_scheme(F.expr("CASE WHEN id % 3 = 0 THEN concat(' e/', id) END")), urls.with_scheme(F.expr("CASE WHEN id % 2 = 0 THEN concat('https://o/', id) END")),
                           F.expr("concat('https://p/', id)"))
    return t.places_v.select("id", s.alias("s")).select("id", "s.url", "s.kind")


@query("primary_url", """SELECT id, CASE WHEN id % 3 = 0 THEN 'https://t.me/x/' || id ELSE url END AS v FROM listings_v""", "listings_v")
def primary_url(t):
    public = F.expr("CASE id % 3 WHEN 0 THEN concat(' https://t.me/x/', id) WHEN 1 THEN ' ' END")
    return t.listings_v.select("id", urls.primary_url(public, F.col("url")).alias("v"))


@query("item_for_url", """SELECT p.page_id, q.page_id AS feed_id FROM pages p JOIN pages q
ON regexp_replace(regexp_replace(p.url, '#.*$', ''), '/+$', '') = regexp_replace(regexp_replace(q.url, '#.*$', ''), '/+$', '')""")
def item_for_url(t):
    wanted = t.pages.select("page_id", urls.norm_url(F.col("url")).alias("u"))
    feed = t.pages.select(F.col("page_id").alias("feed_id"), urls.norm_url(F.concat(F.col("url"), F.lit("#x"))).alias("u"))
    return wanted.join(feed, "u").select("page_id", "feed_id")


@query("union_candidates", """SELECT url, CAST(min(rank) AS INTEGER) AS rank FROM (SELECT url, 0 AS rank FROM pages WHERE contains(url, '#') UNION ALL SELECT url, 1 FROM pages WHERE contains(url, '?')
UNION ALL SELECT url, 2 FROM pages) GROUP BY 1""")
def union_candidates(t):
    def ranked(condition, rank):
        return t.pages.where(condition).select("url", F.lit(rank).alias("rank"), F.col("page_id").alias("pos"))

    union = ranked("url like '%#%'", 0).unionByName(ranked("url like '%?%'", 1)).unionByName(ranked("true", 2))
    return ro.first_seen(union, "url", ["rank", "pos"]).select("url", "rank")


