"""Stage tables and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlineage.functions.scalar import year_of_name


def write_table(df: DataFrame, path: str, by: str | None = "yr") -> None:
    """Parquet, one folder per value of `by`; folders that df has no rows for stay. Spark's commit protocol makes the write atomic per task."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(by) if by else w).parquet(path)


def read_table(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """A stage table, or one year of it, whose folder alone is read."""
    df = spark.read.parquet(path)
    return df if year is None else df.filter(F.col("yr") == year)


def write_bucketed(lists: DataFrame, table: str, path: str, buckets: int) -> None:
    """Inverted lists as a table of the session's catalog, its files below path, in buckets by term, sorted by term and year: joins by term read it without a shuffle.

    One file a bucket, as the lists are dealt by the same hash first. The number of buckets is to follow the data: some 100 MB each.
    """
    dealt = lists.repartition(buckets, "term_id")
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, "term_id").sortBy("term_id", "yr").option("path", path).saveAsTable(table)


def open_bucketed(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """The table that write_bucketed left at path, also in a session whose catalog doesn't know it yet."""
    columns = "yr int, term_id int, part int, n_docs bigint, docs array<struct<id: string, w: double>>, max_w double"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (term_id) SORTED BY (term_id, yr) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_scores_csv(scores: DataFrame, path: str) -> None:
    """id, BS and FS as CSV, a folder a year."""
    rows = scores.select("yr", "id", F.col("bs").alias("BS"), F.col("fs").alias("FS"))
    rows.repartition("yr", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("yr").option("header", True).csv(path)


def write_token_lines(tokens: DataFrame, path: str) -> None:
    """JSON lines with id, title, tokens and extras; one folder per year."""
    tokens.write.mode("overwrite").partitionBy("yr").json(path)


def read_token_lines(spark: SparkSession, path: str, extras: tuple[str, ...] = ()) -> DataFrame:
    schema = ", ".join(["id string", "title string", "tokens array<string>", *[f"`{c}` string" for c in extras], "yr int"])
    return spark.read.schema(schema).json(path)


def docs_per_year_csv(docs_per_year: DataFrame, path: str) -> None:
    write_csv(docs_per_year.select(F.col("yr").alias("year"), F.col("docs").alias("count")).orderBy("year"), path, single=True)


def export_json(term_df: DataFrame, global_df: DataFrame, docs_per_year: DataFrame, vocab: DataFrame, year_pairs: DataFrame, folder: str) -> None:
    """Exchange copies as JSON lines, a row each, whatever their size: term_df by year, global_df, docs_per_year (also as CSV), vocab and pair_list."""
    term_df.write.mode("overwrite").partitionBy("yr").json(f"{folder}/term_df")
    global_df.write.mode("overwrite").json(f"{folder}/global_df")
    docs_per_year.write.mode("overwrite").json(f"{folder}/docs_per_year")
    docs_per_year_csv(docs_per_year, f"{folder}/docs_per_year_csv")
    year_pairs.write.mode("overwrite").json(f"{folder}/pair_list")
    write_vocab_json(vocab, f"{folder}/vocab")


def write_vocab_json(vocab: DataFrame, path: str) -> None:
    """One JSON line per term: term and dense id."""
    vocab.select("term", "term_id").write.mode("overwrite").json(path)


def read_vocab_json(spark: SparkSession, path: str) -> DataFrame:
    """(term, term_id) from lines of this engine, or from one map {"vocab": {term: id}} or {term: id}."""
    first = spark.read.text(path).limit(1).collect()
    if first and '"term_id"' in first[0].value:
        return spark.read.schema("term string, term_id int").json(path)
    whole = spark.read.text(path, wholetext=True)
    inner = F.get_json_object("value", "$.vocab")
    return whole.select(F.explode(F.from_json(F.coalesce(inner, F.col("value")), "map<string,int>")).alias("term", "term_id"))


def read_term_df_json(spark: SparkSession, path: str) -> DataFrame:
    """(yr, term, df, docs) from files {"year": Y, "df": {term: n}, "docs": n}; the year may stand only in the file name."""
    raw = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "struct<year:int, df:map<string,bigint>, docs:bigint>").alias("x"), year_of_name(F.col("_metadata.file_path")).alias("named")
    )
    return raw.select(F.coalesce("x.year", "named").alias("yr"), F.col("x.docs").alias("docs"), F.explode("x.df").alias("term", "df"))


def years_of(df: DataFrame) -> DataFrame:
    """Distinct years; on a table that is partitioned by year only the partitions are read."""
    return df.select("yr").distinct()
