"""Extension: incremental yearly document and term frequencies over an arriving corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_term_df(docs: DataFrame, tokenize) -> DataFrame:
    """Streaming (yr, term, df): complete-mode counts of distinct terms per document."""
    terms = docs.select("yr", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    return terms.groupBy("yr", "term").agg(F.count("*").alias("df"))
