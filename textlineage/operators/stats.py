"""Descriptive statistics of vocabulary, vectors and year overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Histogram edges of row lengths; the last bin includes its upper edge.
EDGES = (0, 1, 5, 10, 20, 50, 100, 1000)


def row_lengths(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, yr, n): stored terms of every document, 0 where pruning left none."""
    counts = vectors.groupBy("id").agg(F.count("*").alias("n"))
    return docs.join(counts, "id", "left").select("id", "yr", F.coalesce("n", F.lit(0)).alias("n"))


def avg_vocab_usage(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("yr").agg(F.count("*").alias("docs"), F.avg("n").alias("avg_terms"))


def row_length_profile(lengths: DataFrame) -> DataFrame:
    p = lambda q: F.percentile("n", F.lit(q))
    return lengths.groupBy("yr").agg(F.count("*").alias("n_rows"), F.avg("n").alias("avg_len"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("n").alias("max_len"))


def row_length_histogram(lengths: DataFrame, edges: tuple[int, ...] = EDGES) -> DataFrame:
    """(yr, lo, hi, n, pct): every bin of every year; rows over the last edge count only in the total."""
    spark = lengths.sparkSession
    last = len(edges) - 2
    b = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        inside = (F.col("n") >= edges[i]) & ((F.col("n") <= edges[i + 1]) if i == last else (F.col("n") < edges[i + 1]))
        b = F.when(inside, F.lit(i)).otherwise(b)
    counts = lengths.withColumn("bin", b).groupBy("yr", "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy("yr").agg(F.sum("n").alias("total"))
    bins = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(last + 1)], "bin int, lo int, hi int")
    grid = totals.crossJoin(F.broadcast(bins))
    out = grid.join(counts, ["yr", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("yr", "lo", "hi", "n", (F.col("n") / F.col("total") * 100).alias("pct"))


def topk_weight_stats(top: DataFrame, docs: DataFrame) -> DataFrame:
    """(yr, docs, mean_sum, mean_sum_sq) over all documents of a year, those without a weight included."""
    per_doc = top.groupBy("id").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("s2"))
    rows = docs.join(per_doc, "id", "left").na.fill(0.0, ["s", "s2"])
    return rows.groupBy("yr").agg(F.count("*").alias("docs"), F.avg("s").alias("mean_sum"), F.avg("s2").alias("mean_sum_sq"))


def topk_df(top: DataFrame) -> DataFrame:
    return top.filter("w <> 0").groupBy("yr", "term_id").agg(F.count("*").alias("df"))


def df_pair_sum(term_df: DataFrame, years: DataFrame, band: int = 5, key: str = "term") -> DataFrame:
    """(yr_1, yr_2, s): sum of products of document frequencies, both orders and the diagonal; zero pairs kept.

    One exchange by term gathers its counts, at most one a year; their products are made in that row and added up before they leave the task.
    """
    each = term_df.groupBy(key).agg(F.collect_list(F.struct("yr", "df")).alias("c"))
    near = lambda a: F.filter("c", lambda b: F.abs(a["yr"] - b["yr"]) <= band)
    products = F.flatten(F.transform("c", lambda a: F.transform(near(a), lambda b: F.struct(a["yr"].alias("yr_1"), b["yr"].alias("yr_2"), (a["df"] * b["df"]).alias("p")))))
    sums = each.select(F.inline(products)).groupBy("yr_1", "yr_2").agg(F.sum("p").alias("s"))
    grid = years.select(F.col("yr").alias("yr_1"), F.explode(F.sequence(F.col("yr") - band, F.col("yr") + band)).alias("yr_2"))
    grid = grid.join(years.select(F.col("yr").alias("yr_2")), "yr_2").select("yr_1", "yr_2")
    return grid.join(sums, ["yr_1", "yr_2"], "left").na.fill(0, ["s"])


def df_pair_total(pair_sums: DataFrame) -> DataFrame:
    return pair_sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("total"))


def yearly_top_terms(term_df: DataFrame, docs: DataFrame, k: int = 50) -> DataFrame:
    """(yr, rank, term, df, pct): the k most frequent terms of a year, ties by term; pct of the year's documents.

    A salted first ranking keeps one year's vocabulary out of one task.
    """
    order = [F.col("df").desc(), F.col("term")]
    rows = term_df.withColumn("_slice", F.pmod(F.xxhash64("term"), F.lit(64)))
    for keys in (["yr", "_slice"], ["yr"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    pct = F.when(F.col("docs") > 0, F.col("df") / F.col("docs") * 100).otherwise(F.lit(0.0))
    return rows.join(F.broadcast(docs), "yr", "left").select("yr", "rank", "term", "df", pct.alias("pct"))


def yearly_vocab_size(term_df: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """(yr, terms); of the vocabulary alone where one is given."""
    rows = term_df if vocab is None else term_df.join(vocab.select("term"), "term", "left_semi")
    return rows.groupBy("yr").agg(F.count("*").alias("terms"))


def vocab_union(term_df: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    rows = term_df if vocab is None else term_df.join(vocab.select("term"), "term", "left_semi")
    return rows.select("term").distinct().agg(F.count("*").alias("terms"))


def report(df: DataFrame, widths: dict[str, int], most: int = 100_000) -> str:
    """Fixed-width text of a small result; of one with more rows than `most` it raises, as text isn't the place for it."""
    line = " | ".join(f"{c:<{w}}" for c, w in widths.items())
    rows = df.select(*widths).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows: write a table instead")
    return "\n".join([line, "-" * len(line), *(" | ".join(f"{r[c]!s:<{w}}" for c, w in widths.items()) for r in rows)])
