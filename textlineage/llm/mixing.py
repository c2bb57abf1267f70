"""Mixing sources: temperature weights under a repetition limit, realised as block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlineage.llm.common import cut, scratch

#: A source's blocks are summed in 2 ** SLICE_BITS slices.
SLICE_BITS = 12


@dataclass(frozen=True)
class Mix:
    """max_repeats: most epochs of any source. target_entropy: nats of the weights to reach, as far as
    the limit on repetition lets them. budget: tokens of the result; None: the least that uses every document."""

    max_repeats: float = 2.0
    target_entropy: float | None = None
    budget: int | None = None
    block_docs: int = 1024
    seed: int = 17


def words(text: Column) -> Column:
    """Tokens of a text: runs of non-space characters; none in a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, p: Mix, ways: int = 32, rounds: int = 6) -> float:
    """The temperature exponent in [0, 1], by sections of the interval: each round is one aggregation over the sources.

    Weights are shares ** exponent. Repeats of a source are weight * budget / tokens; both they and the
    entropy fall as the exponent rises. The answer is the largest exponent that reaches the entropy, raised
    where needed to the smallest that keeps the repetition limit.
    """
    top = sources.agg(F.max("tokens").alias("t")).first().t

    def section(ok) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            grid = [lo + (hi - lo) * i / ways for i in range(ways + 1)]
            share = F.log(F.col("tokens") / F.lit(float(top)))
            rows = sources.select("tokens", share.alias("l"), F.explode(F.array(*map(F.lit, grid))).alias("a"))
            power = F.exp(F.col("a") * F.col("l"))
            sums = rows.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.col("l")).alias("zl"), F.max((F.col("a") - 1) * F.col("l")).alias("spread"))
            got = sorted((r.a, ok(r)) for r in sums.collect())
            lo = max((a for a, good in got if not good), default=lo)
            hi = min((a for a, good in got if good), default=hi)
            if hi <= lo:
                return hi
        return hi

    def repeats_ok(r) -> bool:
        if p.budget is None:  # the largest source is used once, others exp(spread) times
            return math.exp(min(r.spread, 700.0)) <= p.max_repeats * (1 + 1e-12)
        return math.exp(min(r.spread, 700.0)) * p.budget / (top * r.z) <= p.max_repeats * (1 + 1e-12)

    limit = section(repeats_ok)
    if p.target_entropy is None:
        return limit
    # Entropy is log z - a * zl / z. Sections look for the first exponent below the target.
    below = section(lambda r: math.log(r.z) - r.a * r.zl / r.z < p.target_entropy)
    return max(limit, below)


def quotas(rows: DataFrame, p: Mix) -> DataFrame:
    """One row per source: (_s, docs, tokens, weight, repeats, whole, blocks, cut_order, cut_hash).

    whole is the number of full epochs. Of the last, partial one a document belongs to it if its block's
    order is under cut_order, or equals it and the document's hash is at most cut_hash: the permutation's prefix
    that meets the source's budget. Small aggregations find them; no source is sorted as a whole, nor are its blocks.
    """
    sums = cut(rows.groupBy("_s").agg(F.count("*").alias("docs"), F.sum("_t").alias("tokens")), "mix-sources")
    live = sums.filter("tokens > 0")
    if live.isEmpty():
        alike = [F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats"), F.lit(1).alias("whole"), F.lit(1).cast("long").alias("blocks"), F.lit(None).cast("long").alias("cut_order"), F.lit(None).cast("long").alias("cut_hash")]
        return cut(sums.select("_s", "docs", "tokens", *alike), "mix-quotas")
    a = exponent(live, p)
    top = live.agg(F.max("tokens").alias("t")).first().t
    power = F.exp(F.lit(a) * F.log(F.col("tokens") / F.lit(float(top))))
    z = live.agg(F.sum(power).alias("z")).first().z
    budget = float(p.budget) if p.budget is not None else top * z
    share = F.when(F.col("tokens") > 0, power / F.lit(z)).otherwise(F.lit(0.0))
    # A source without tokens costs no budget: its documents are used once.
    repeats = F.when(F.col("tokens") > 0, F.least(share * budget / F.col("tokens"), F.lit(float(p.max_repeats)))).otherwise(F.lit(1.0))
    # Quotas that are a whole number of epochs but for rounding are that number.
    near = F.when(F.abs(repeats - F.round(repeats)) < 1e-9, F.round(repeats)).otherwise(repeats)
    plan = sums.withColumn("weight", share).withColumn("repeats", near).withColumn("whole", F.floor("repeats").cast("int")).withColumn("blocks", F.ceil(F.col("docs") / F.lit(p.block_docs)).cast("long"))
    plan = cut(plan.withColumn("rest", (F.col("repeats") - F.col("whole")) * F.col("tokens")), "mix-plan")
    # The block in which the last epoch ends. Blocks are of bounded size but grow in number with their source, so their sums
    # are ordered in slices of the permutation: first the slices, then the blocks of the one slice that holds the end.
    placed = rows.join(plan.filter("rest > 0").select("_s", "blocks", "rest"), "_s").withColumn("_o", block_order(p))
    per_block = placed.groupBy("_s", "rest", "_o").agg(F.sum("_t").alias("n")).withColumn("_c", F.shiftright("_o", 64 - SLICE_BITS))
    per_block = cut(per_block, "mix-blocks")
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends_here = "b < rest and rest <= b + n"
    slices = per_block.groupBy("_s", "rest", "_c").agg(F.sum("n").alias("n")).withColumn("b", ahead(Window.partitionBy("_s").orderBy("_c")))
    found = per_block.join(slices.filter(ends_here).select("_s", "_c", F.col("b").alias("s")), ["_s", "_c"])
    found = found.withColumn("b", F.col("s") + ahead(Window.partitionBy("_s", "_c").orderBy("_o")))
    edge = found.filter(ends_here).select("_s", F.col("_o").alias("cut_order"), (F.col("rest") - F.col("b")).alias("left"))
    edge = cut(edge, "mix-edge")
    inside = placed.join(edge, "_s").filter("_o = cut_order").withColumn("_h", doc_order(p))
    # Documents go in whole while the sum stays within the budget of the block.
    upto = F.sum("_t").over(Window.partitionBy("_s").orderBy("_h").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("c", upto).filter("c <= left").groupBy("_s").agg(F.max("_h").alias("cut_hash"))
    out = plan.join(edge.select("_s", "cut_order"), "_s", "left").join(last, "_s", "left").drop("rest")
    return cut(out.withColumn("cut_hash", F.when(F.col("cut_order").isNotNull(), F.coalesce("cut_hash", F.lit(-(1 << 63))))), "mix-quotas")


def block_order(p: Mix) -> Column:
    """Place of a document's block in its source's permutation."""
    block = F.pmod(F.xxhash64(F.lit(p.seed), F.lit("block"), "_id"), F.col("blocks"))
    return F.xxhash64(F.lit(p.seed), F.lit("order"), "_s", block)


def doc_order(p: Mix) -> Column:
    """Place of a document in its block; rows that repeat an id share it and go in or out together."""
    return F.xxhash64(F.lit(p.seed), F.lit("doc"), "_id")


def mix(docs: DataFrame, p: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, copies_only: bool = False) -> DataFrame:
    """docs, each row as often as its source's quota says, with source_weight, epoch (from 1) and mix_key.

    Sorting by mix_key (0 to 1) interleaves the sources in the target proportions: within an epoch blocks come in a
    hashed order, a block's documents near each other. A null source is the source ""; a text without words has no tokens, costs nothing and comes
    with its source's whole epochs; columns of docs named as the results give way to them. With budget None no document is dropped. Texts are not shuffled: the
    decision is a comparison with the source's row of quotas. Rows that repeat an id, null ids too, go in together if all fit or stay out; texts of any length
    count with all their words. An empty table gives an empty table. copies_only: only the columns of docs.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_s")
    with scratch(docs.sparkSession) as keep:
        q = keep(quotas(cut(docs.select(source, F.col(id_col).alias("_id"), (words(F.col("text")) if tokens is None else tokens).alias("_t")), "mix-rows"), p))
    # Rows travel as one struct, so that no column of docs can clash with those of the plan.
    out = docs.select(source, F.col(id_col).alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    out = out.join(q.select("_s", "weight", "repeats", "whole", "blocks", "cut_order", "cut_hash"), "_s")
    o, h = block_order(p), doc_order(p)
    extra = F.coalesce((o < F.col("cut_order")) | ((o == F.col("cut_order")) & (h <= F.col("cut_hash"))), F.lit(False))
    out = out.withColumn("_n", F.col("whole") + extra.cast("int")).filter("_n > 0").withColumn("_e", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    if copies_only:
        return out.select("_row.*")
    unit = lambda x: x.cast("double") / F.lit(2.0**64) + F.lit(0.5)
    place = unit(o) * (1 - 1 / F.col("blocks")) + unit(h) / F.col("blocks")
    new = ("source_weight", "source_repeats", "epoch", "mix_key")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in new]
    return out.select(*kept, F.col("weight").alias("source_weight"), F.col("repeats").alias("source_repeats"), F.col("_e").alias("epoch"), F.least(F.lit(1.0), (F.col("_e") - 1 + place) / F.greatest(F.lit(1.0), F.col("repeats"))).alias("mix_key"))
