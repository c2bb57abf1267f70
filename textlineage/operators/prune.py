"""Term pruning: stop columns, document-frequency columns, top k of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlineage.functions.joins import checked_small


def stop_columns(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """Vocabulary terms that are stop words."""
    return vocab.join(words.select("term").distinct(), "term", "left_semi").select("term", "term_id")


def drop_columns(vectors: DataFrame, columns: DataFrame, on: list[str]) -> DataFrame:
    """vectors without the listed columns and without zero weights; while the list is short, which is counted first, the vectors stay where they are."""
    return vectors.join(checked_small(columns.select(*on).distinct()), on, "left_anti").filter("w <> 0")


def ratio_columns(term_df: DataFrame, docs: DataFrame, vocab: DataFrame, threshold: float) -> DataFrame:
    """(yr, term, term_id, df): terms in at least that share of a year's non-empty documents."""
    rows = term_df.join(F.broadcast(docs), "yr").filter(F.col("df") / F.col("docs") >= threshold)
    return rows.join(vocab.select("term", "term_id"), "term").select("yr", "term", "term_id", "df")


def top_df_columns(term_df: DataFrame, vocab: DataFrame, removed: DataFrame, percent: float) -> DataFrame:
    """(yr, term, term_id, df): the floor(V * percent) most frequent vocabulary terms of a year that `removed` lacks.

    V counts all terms of the year. Ties go by term. Ranks are taken inside salted slices first,
    so one year's vocabulary is never sorted in one task: a term of the answer is in the top of its slice.
    """
    quota = term_df.groupBy("yr").agg(F.floor(F.count("*") * F.lit(float(percent))).alias("_quota"))
    rows = term_df.join(vocab.select("term", "term_id"), "term").join(removed.select("yr", "term"), ["yr", "term"], "left_anti")
    rows = rows.join(F.broadcast(quota), "yr").withColumn("_slice", F.pmod(F.xxhash64("term"), F.lit(64)))
    order = [F.col("df").desc(), F.col("term")]
    for keys in (["yr", "_slice"], ["yr"]):
        rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= F.col("_quota"))
    return rows.select("yr", "term", "term_id", "df")


def top_k_terms(vectors: DataFrame, k: int, keep_all_if_not_positive: bool = False) -> DataFrame:
    """The k largest signed weights of each document, zeros dropped; ties by term.

    k <= 0 keeps nothing, or everything for the statistics variant.
    """
    if k <= 0:
        return vectors if keep_all_if_not_positive else vectors.limit(0)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("w", 12).desc(), "term"))
    return vectors.withColumn("_rn", rank).filter(F.col("_rn") <= k).drop("_rn").filter("w <> 0")


def removed_columns(term_df: DataFrame, docs: DataFrame, vocab: DataFrame, words: DataFrame | None, threshold: float, percent: float) -> DataFrame:
    """(yr, term_id, step): columns that pruning removes from a year, and the first step that does: 1 listed words, 2 ratio, 3 most frequent."""
    ratio = ratio_columns(term_df, docs, vocab, threshold)
    top = top_df_columns(term_df, vocab, ratio, percent)
    out = ratio.select("yr", "term_id", F.lit(2).alias("step")).unionByName(top.select("yr", "term_id", F.lit(3).alias("step")))
    if words is not None:
        stop = stop_columns(vocab, words).select("term_id", F.lit(1).alias("step"))
        out = out.unionByName(stop.join(term_df.select("yr", "term").join(vocab.select("term", "term_id"), "term").select("yr", "term_id"), "term_id").select("yr", "term_id", "step"))
    return out.groupBy("yr", "term_id").agg(F.min("step").alias("step"))


def prune(vectors: DataFrame, removed: DataFrame, k: int) -> DataFrame:
    """Stop columns, then frequent columns by ratio, then the top of the rest, then top k. Not normalised again.

    The three lists, removed_columns, are one anti-join on integers; while they are short, which is counted first, it leaves the vectors where they are, by document.
    """
    return top_k_terms(vectors.join(checked_small(removed.select("yr", "term_id")), ["yr", "term_id"], "left_anti").filter("w <> 0"), k)


def prune_counts(vectors: DataFrame, removed: DataFrame, filtered: DataFrame) -> DataFrame:
    """(yr, nnz_before, nnz_stop, nnz_ratio, nnz_top, nnz_after): stored weights of a year at first and after each step of pruning."""
    rows = vectors.join(removed, ["yr", "term_id"], "left").withColumn("step", F.when(F.col("w") == 0, F.lit(0)).otherwise(F.coalesce("step", F.lit(9))))
    steps = rows.groupBy("yr").agg(F.count("*").alias("nnz_before"), *[F.count_if(F.col("step") > i).alias(c) for i, c in ((1, "nnz_stop"), (2, "nnz_ratio"), (3, "nnz_top"))])
    after = filtered.groupBy("yr").agg(F.count("*").alias("nnz_after"))
    return steps.join(after, "yr", "left").na.fill(0, ["nnz_after"])
