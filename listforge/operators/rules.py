"""Phrase rules over texts: one pass of literal contains per text, no join.

A rule list is code, not data: it becomes one expression per phrase inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listforge import fixed_values as fv
from listforge.functions import text as tx

Rule = tuple[str, int, str, str]


def matched(text: Column, phrases: list[str]) -> Column:
    """Places in the list of the phrases a text contains, in order: every phrase is searched for once."""
    return F.array_compact(F.array(*[F.when(text.contains(p), F.lit(i)) for i, p in enumerate(phrases)]))


def weight_of(found: Column, rules: list[Rule]) -> Column:
    weights = F.array(*[F.lit(r[1]) for r in rules])
    return F.aggregate(found, F.lit(0), lambda total, i: total + F.get(weights, i))


def best_label(found: Column, rules: list[Rule], position: int) -> Column:
    """Label with the greatest summed weight; on a tie the one whose first matching rule comes first."""
    labels = list(dict.fromkeys(r[position] for r in rules))
    numbers = F.array(*[F.lit(labels.index(r[position])) for r in rules])
    own = F.transform(F.array(*[F.lit(k) for k in range(len(labels))]), lambda k: F.filter(found, lambda i: F.get(numbers, i) == k))
    scored = F.transform(own, lambda hits, k: F.struct(
        weight_of(hits, rules).alias("total"), (-F.get(hits, F.lit(0))).alias("first"), F.get(tx.word_table(labels), k).alias("label")))
    return F.array_max(F.filter(scored, lambda s: s["total"] > 0))["label"]


def score_rules(df: DataFrame, text: Column, rules: list[Rule] = fv.SIGNAL_RULES, anti: list[str] = fv.ANTI_PHRASES,
                min_score: int = fv.FOCUS_MIN_SCORE) -> DataFrame:
    """Adds score (0-100), focus, subtype, delivery and keywords, all from the short array of matching rules."""
    staged = df.withColumn("__text", tx.match_text(text))
    scored = staged.select("*", matched(F.col("__text"), [r[0] for r in rules]).alias("__found"), F.size(matched(F.col("__text"), anti)).alias("__noise"))
    names = tx.word_table([r[0].strip() for r in rules])
    score = F.greatest(F.lit(0), F.least(F.lit(100), weight_of(F.col("__found"), rules) - F.least(F.lit(60), F.col("__noise") * 20)))
    scored = scored.withColumn("score", score.cast("int")).withColumn(
        "focus", (F.size("__found") > 0) & (F.col("score") >= min_score))
    focus, found = F.col("focus"), F.col("__found")
    return scored.select(
        *df.columns, "score", "focus",
        F.when(focus, best_label(found, rules, 2)).alias("subtype"),
        F.when(focus, best_label(found, rules, 3)).alias("delivery"),
        F.when(focus, F.array_distinct(F.transform(found, lambda i: F.get(names, i)))).otherwise(F.array().cast("array<string>")).alias("keywords"))


def classify_rules_join(df: DataFrame, key: str, text: Column, rules: list[Rule] = fv.SIGNAL_RULES) -> DataFrame:
    """One row per (document, matched phrase): the relation a theta join would give, made by
    exploding the matches of each text instead of pairing every text with every rule."""
    staged = df.select(key, tx.match_text(text).alias("__text"))
    found = F.array_compact(F.array(*[F.when(F.col("__text").contains(p), F.struct(
        F.lit(i).alias("rule_idx"), F.lit(p.strip()).alias("phrase"), F.lit(w).alias("weight")))
        for i, (p, w, _, _) in enumerate(rules)]))
    return staged.select(key, F.inline(found))
