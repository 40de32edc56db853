"""Phrase rules over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from listforge.operators import rules as ru
from listforge.plans.registry import query
from listforge.plans.text_queries import TOKEN

# The documents are invented prose, so the rules use frequent words of their four languages.
RULES = [
    ("und", 10, "german", "a"), (" der ", 20, "german", "b"), (" und die ", 25, "german", "b"), (" the ", 20, "english", "a"),
    (" of the ", 30, "english", "c"), (" to ", 15, "english", "c"), (" le ", 20, "french", "a"), (" de la ", 30, "french", "b"),
    (" que ", 15, "spanish", "b"), ("cion", 15, "spanish", "c"), (" los ", 20, "spanish", "a"), ("mente", 10, "mixed", "a"),
]
ANTI = ["token", " a ", "ment", " que ", "000"]
RULE_ROWS = ", ".join(f"({i}, '{p}', {w}, '{s}', '{d}')" for i, (p, w, s, d) in enumerate(RULES))
ANTI_ROWS = ", ".join(f"('{p}')" for p in ANTI)
BASE = f"""WITH r(idx, phrase, weight, subtype, delivery) AS (VALUES {RULE_ROWS}), a(phrase) AS (VALUES {ANTI_ROWS}),
d AS (SELECT doc_id, CASE WHEN {TOKEN} = '' THEN '' ELSE ' ' || {TOKEN} || ' ' END AS text FROM documents),
hit AS (SELECT d.doc_id, r.* FROM d JOIN r ON contains(d.text, r.phrase)),
pos AS (SELECT doc_id, sum(weight) AS total, count(*) AS n FROM hit GROUP BY 1),
neg AS (SELECT d.doc_id, count(*) AS n FROM d JOIN a ON contains(d.text, a.phrase) GROUP BY 1),
s AS (SELECT d.doc_id, CAST(greatest(0, least(100, coalesce(pos.total, 0) - least(60, 20 * coalesce(neg.n, 0)))) AS INTEGER) AS score, coalesce(pos.n, 0) AS n
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN neg USING (doc_id)), f AS (SELECT doc_id, score, n > 0 AND score >= 40 AS focus FROM s)"""


def _scored(t):
    return ru.score_rules(t.documents.select("doc_id", "text"), F.col("text"), RULES, ANTI)


@query("rule_score", f"{BASE} SELECT doc_id, score, focus FROM f")
def rule_score(t):
    return _scored(t).select("doc_id", "score", "focus")


@query("rule_argmax", f"""{BASE}, g AS (SELECT doc_id, subtype AS label, sum(weight) AS w, min(idx) AS i FROM hit GROUP BY 1, 2),
h AS (SELECT doc_id, delivery AS label, sum(weight) AS w, min(idx) AS i FROM hit GROUP BY 1, 2)
SELECT f.doc_id, CASE WHEN focus THEN (SELECT arg_max(label, (w, -i)) FROM g WHERE g.doc_id = f.doc_id) END AS subtype,
CASE WHEN focus THEN (SELECT arg_max(label, (w, -i)) FROM h WHERE h.doc_id = f.doc_id) END AS delivery FROM f""")
def rule_argmax(t):
    return _scored(t).select("doc_id", "subtype", "delivery")


@query("matched_keywords", f"""{BASE} SELECT f.doc_id, CASE WHEN focus THEN coalesce((SELECT string_agg(trim(phrase), '|' ORDER BY idx) FROM hit WHERE hit.doc_id = f.doc_id), '') ELSE '' END AS keywords FROM f""")
def matched_keywords(t):
    return _scored(t).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


@query("classify_rules_join", f"{BASE} SELECT doc_id, idx AS rule_idx, trim(phrase) AS phrase, weight FROM hit")
def classify_rules_join(t):
    return ru.classify_rules_join(t.documents, "doc_id", F.col("text"), RULES)


# The fixed tender rules on phrases written around part names: noise words take points off.
@query("tender_rule_score", """SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN 95 WHEN 1 THEN 45 WHEN 2 THEN 0 ELSE 0 END AS INTEGER) AS score,
CASE p_size % 4 WHEN 0 THEN 'software_development' WHEN 1 THEN 'data_bi' END AS subtype, CASE p_size % 4 WHEN 0 THEN 'desenvolvimento' WHEN 1 THEN 'servico_continuado' END AS delivery,
CASE p_size % 4 WHEN 0 THEN 'desenvolvimento de software|software' WHEN 1 THEN 'banco de dados' ELSE '' END AS keywords FROM part""")
def tender_rule_score(t):
    text = F.expr("""concat(p_brand, CASE p_size % 4 WHEN 0 THEN ' Desenvolvimento de Software ' WHEN 1 THEN ': Banco de Dados!' WHEN 2 THEN ' software e Notebooks' ELSE ' papel ' END, p_type)""")
    return ru.score_rules(t.part.select("p_partkey", text.alias("x")), F.col("x")).select("p_partkey", "score", "subtype", "delivery", F.array_join("keywords", "|").alias("keywords"))
