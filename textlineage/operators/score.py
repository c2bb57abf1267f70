"""Backward and forward similarity and their ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(bs: Column, fs: Column, epsilon: float) -> Column:
    return fs / (bs + F.lit(epsilon))


def quality(scores: DataFrame, epsilon: float) -> DataFrame:
    return scores.withColumn("q", ratio(F.col("bs"), F.col("fs"), epsilon))


def final_table(titles: DataFrame, scores: DataFrame, epsilon: float, names: tuple[str, str, str] = ("申请号", "申请年份", "专利名称"), extras: tuple[str, ...] = ()) -> DataFrame:
    """The delivered table, numbers as text with 8 decimals; a document without scores counts as 0."""
    rows = titles.join(scores.select("id", "bs", "fs"), "id", "left").na.fill(0.0, ["bs", "fs"])
    text = lambda c: F.printf(F.lit("%.8f"), c)
    return rows.select(
        F.col("id").alias(names[0]), F.col("yr").cast("string").alias(names[1]), F.col("title").alias(names[2]),
        text(F.col("bs")).alias("BS"), text(F.col("fs")).alias("FS"), text(ratio(F.col("bs"), F.col("fs"), epsilon)).alias("Quality_q"), *[F.col(f"`{c}`") for c in extras],
    )
