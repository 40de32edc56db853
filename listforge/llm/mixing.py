"""Mixing sources to target weights.

The share of a source in the mixture is its share of all tokens raised to an exponent between 0 (all sources
alike) and 1 (as they come), normalised.  The exponent is found by bisection: the least one that keeps
every source within a repetition limit, or the greatest that reaches a target entropy.  The weights are
then realised as block permutations: the documents of a source are dealt into blocks by hash, each epoch
goes through all blocks in an order of its own, and the last one stops when the budget is used up.

Everything is done with DataFrame operations.  Sources and blocks are aggregated before anything is
ordered.  Where the blocks of a source start is a sum in two levels: over ``RANGES`` ranges of their order, then
over the blocks of one range, so that no window holds all blocks of a source.  A block has at most about
``block_tokens`` documents, empty ones included.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listforge.llm.common import stored

STEPS, LEVELS = 12, 6
RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def hashed(*parts: Column | str) -> Column:
    """A number below 2 ** 60 from the parts' text, the same in any engine with MD5."""
    text = F.concat_ws(":", *[F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens`` of every row; a token is a word between ASCII white space."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))


def figures(sources: DataFrame, exponents: list[float], total: int, budget: int) -> dict[float, tuple[float, float]]:
    """(entropy in bits, highest number of repetitions) of the mixture at each exponent."""
    p = F.col("tokens") / F.lit(float(total))
    at = sources.filter("tokens > 0").select("tokens", p.alias("p"), F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a"))
    w = F.pow("p", "a")
    got = at.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log2(w)).alias("s"), F.max(w / F.col("tokens")).alias("r")).collect()
    return {r.a: (math.log2(r.z) - r.s / r.z, budget * r.r / r.z) for r in got}


def exponent(sources: DataFrame, total: int, budget: int, max_repeats: float | None, entropy: float | None) -> float:
    """Bisect the exponent to ``2 ** -STEPS``.  ``LEVELS`` halvings share one job: it takes all midpoints they may need.
    With neither target the exponent is 1; if even 1 repeats too often, or 0 has too little entropy, that end is taken."""
    if max_repeats is None and entropy is None:
        return 1.0
    lo, hi = 0, 1 << STEPS
    scale = float(1 << STEPS)
    fits = (lambda f: f[1] <= max_repeats + 1e-12) if max_repeats is not None else (lambda f: f[0] < entropy - 1e-12)
    ends = figures(sources, [0.0, 1.0], total, budget)
    if fits(ends[0.0]):
        return 0.0
    if not fits(ends[1.0]):
        return 1.0
    while hi - lo > 1:
        step = max(1, (hi - lo) >> LEVELS)
        seen = figures(sources, [k / scale for k in range(lo + step, hi, step)], total, budget)
        while hi - lo > step:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if fits(seen[mid / scale]) else (mid, hi)
    return (hi if max_repeats is not None else lo) / scale


def mix_sources(docs: DataFrame, max_repeats: float | None = 1.25, entropy: float | None = None, budget: int | None = None,
                block_tokens: int = 1 << 16, seed: int = 1) -> DataFrame:
    """``doc_id, source, n_tokens, epoch, block, block_start, place``: the documents of the mixture, once for each time they are used.

    ``budget`` is in tokens (default: as many as there are).  Of every source all blocks are used once an
    epoch; in the epoch the budget ends, documents are taken in order as long as they fit whole.  The
    order within a source is ``epoch, block_start, place``.

    Null sources are the source ''.  Documents without tokens are used once in every full epoch and cost
    nothing; a source that has no tokens at all is not used, and neither is anything when ``budget`` is 0.
    Rows that repeat an id are documents of their own.
    """
    rows = stored(counted(docs), "tokens")
    sources = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")), "sources")
    total = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budget = total if budget is None else budget
    a = exponent(sources, total, budget, max_repeats, entropy) if total else 1.0
    z = sources.filter("tokens > 0").agg(F.coalesce(F.sum(F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))), F.lit(1.0))).first()[0]
    share = F.round(F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a)) / F.lit(z), 12)
    plan = stored(sources.filter("tokens > 0").select("source", "tokens", "n_rows", F.floor(F.lit(budget) * share).alias("budget"))
                  .select("*", F.ceil(F.greatest("tokens", "n_rows") / F.lit(float(block_tokens))).alias("blocks"), F.expr("budget div tokens").alias("full")), "plan")
    dealt = rows.join(plan.select("source", "blocks"), "source").withColumn("block", hashed(str(seed), F.col("doc_id")) % F.col("blocks"))
    blocks = stored(dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size")), "blocks")
    epochs = blocks.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    ordered = (epochs.withColumn("key", hashed(str(seed), F.col("source"), F.col("epoch"), F.col("block")))
               .withColumn("range", F.floor(F.col("key") / F.lit(float((1 << 60) // RANGES)))))
    earlier = Window.unboundedPreceding, -1
    ranges = ordered.groupBy("source", "epoch", "range").agg(F.sum("size").alias("held")).withColumn(
        "base", F.coalesce(F.sum("held").over(Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(*earlier)), F.lit(0)))
    before = Window.partitionBy("source", "epoch", "range").orderBy("key", "block").rowsBetween(*earlier)
    started = (ordered.join(ranges.drop("held"), ["source", "epoch", "range"])
               .withColumn("block_start", F.col("base") + F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("epoch") * F.col("tokens"))
               .filter((F.col("epoch") < F.col("full")) | (F.col("block_start") < F.col("budget")))
               .select("source", "block", "epoch", "block_start", "budget"))
    place = hashed(str(seed), F.col("epoch"), F.col("doc_id"), F.lit("place"))
    inside = Window.partitionBy("source", "block", "epoch").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    used = dealt.select("doc_id", "source", "n_tokens", "block").join(stored(started, "started"), ["source", "block"]).withColumn("place", place)
    return (used.withColumn("upto", F.col("block_start") + F.sum("n_tokens").over(inside)).filter(F.col("upto") <= F.col("budget"))
            .select("doc_id", "source", "n_tokens", "epoch", "block", "block_start", "place"))
