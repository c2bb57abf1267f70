"""Document frequencies and the vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlineage.functions.tokenize import drop_words


def tokenized(docs: DataFrame, tokenize) -> DataFrame:
    """docs with `tokens`; the text goes."""
    return docs.withColumn("tokens", tokenize(F.col("text"))).drop("text")


#: Words up to which a list is one array in the plan; longer lists are joined.
MOST_LISTED = 1_000


def without_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """tokens without the words of a list of any length; order and duplicates of the others stay, as do documents that lose all theirs.

    A long list is an anti join of the token rows, which are put together again by document.
    """
    listed = [r.term for r in words.select("term").distinct().limit(MOST_LISTED + 1).collect()]
    if len(listed) <= MOST_LISTED:
        return tokens.withColumn("tokens", drop_words(F.col("tokens"), F.array(*map(F.lit, listed)))) if listed else tokens
    rows = tokens.select("id", F.posexplode("tokens").alias("pos", "term")).join(words.select("term").distinct(), "term", "left_anti")
    kept = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("_kept"))
    return tokens.join(kept, "id", "left").withColumn("tokens", F.coalesce("_kept", F.array().cast("array<string>"))).select(*tokens.columns)


def repeats(tokens: DataFrame) -> bool:
    """Whether an id stands in more than one row: a job of its own over the ids alone."""
    return not tokens.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).isEmpty()


#: Tokens that a step counts.
STEP = 1 << 19


@F.arrow_udf(T.StructType().add("terms", T.ArrayType(T.StringType())).add("tfs", T.ArrayType(T.IntegerType())))
def counted(lists: pa.Array) -> pa.Array:
    """The distinct tokens of each list and how often it has them, some lists at a time."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, out, i = np.cumsum(lengths), [], 0
    while i < len(lists) or not out:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, side="right")))
        words = lists.slice(i, j - i).flatten().dictionary_encode(null_encoding="encode")
        n = max(1, len(words.dictionary))
        key, times = np.unique(np.repeat(np.arange(len(lengths[i:j])), lengths[i:j]) * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        cuts = pa.array(np.searchsorted(key, np.arange(len(lengths[i:j]) + 1) * n).astype(np.int32))
        columns = [words.dictionary.take(pa.array(key % n)), pa.array(times.astype(np.int32))]
        out.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, c) for c in columns], ["terms", "tfs"]))
        i = j
    return pa.concat_arrays(out)


#: Else the optimizer would compute it once more, to leave out empty lists.
counted = counted.asNondeterministic()


def term_counts(tokens: DataFrame, dealt: bool = False) -> DataFrame:
    """(id, yr, term, tf). While no id repeats, which is looked up first, a document is counted in its own row, with no shuffle and no
    aggregate that grows with a task's input; rows of one id are added up. dealt: by document, as norms and top lists need it."""
    if repeats(tokens):
        return tokens.select("id", "yr", F.explode("tokens").alias("term")).groupBy("id", "yr", "term").agg(F.count("*").alias("tf"))
    rows = tokens.select("id", "yr", counted("tokens").alias("c")).select("id", "yr", "c.terms", "c.tfs")
    rows = (rows.repartition("id") if dealt else rows).select("id", "yr", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    return rows.withColumn("tf", F.col("tf").cast("long"))


def document_counts(tokens: DataFrame, repeated: bool) -> DataFrame:
    """(id, yr, terms, tfs): a row a document. `repeated`, as `repeats` says, adds up rows of one id; documents without a token have then no row."""
    if not repeated:
        return tokens.select("id", "yr", counted("tokens").alias("c")).select("id", "yr", "c.terms", "c.tfs")
    rows = tokens.select("id", "yr", F.explode("tokens").alias("term")).groupBy("id", "yr", "term").agg(F.count("*").cast("int").alias("tf"))
    return rows.groupBy("id", "yr").agg(F.collect_list(F.struct("term", "tf")).alias("c")).select("id", "yr", F.col("c.term").alias("terms"), F.col("c.tf").alias("tfs"))


def steps(batches: Iterator[pa.RecordBatch], lists: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows, cut and put together so that each batch has about so many entries of a list column, a row at least."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(lists)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            before = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + most - size, side="right")))
            held.append(batch.slice(i, j - i))
            size += int(ends[j - 1]) - before
            if size >= most or j < batch.num_rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            i = j
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: Entries of documents that a step adds up by year and term.
ENTRIES = 1 << 21


def term_df(tokens: DataFrame, repeated: bool | None = None) -> DataFrame:
    """(yr, term, df) of tokens: term_df_year(term_counts(tokens)).

    Documents are added up some at a time, so that a task's memory doesn't grow with its terms, and dealt by term, as what reads the sums needs them.
    """
    counts = document_counts(tokens, repeats(tokens) if repeated is None else repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in steps(batches, "terms", ENTRIES):
            lengths = pc.fill_null(pc.list_value_length(rows.column("terms")), 0).to_numpy(zero_copy_only=False)
            years, words = rows.column("yr").dictionary_encode(null_encoding="encode"), rows.column("terms").flatten().dictionary_encode(null_encoding="encode")
            n = max(1, len(words.dictionary))
            key, df = np.unique(np.repeat(years.indices.to_numpy(zero_copy_only=False).astype(np.int64), lengths) * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([years.dictionary.take(pa.array(key // n)), words.dictionary.take(pa.array(key % n)), pa.array(df)], ["yr", "term", "df"])

    rows = counts.select("yr", "terms").mapInArrow(run, f"yr {counts.schema['yr'].dataType.simpleString()}, term string, df long")
    return rows.repartition("term").groupBy("yr", "term").agg(F.sum("df").alias("df"))


@F.arrow_udf(T.BooleanType())
def filled(lists: pa.Array) -> pa.Array:
    return pc.greater(pc.fill_null(pc.list_value_length(lists), 0), 0)


def docs_per_year(tokens: DataFrame, made: bool = False) -> DataFrame:
    """(yr, docs) over documents with a token; made: tokens that are made in Python as they are read are looked at there."""
    return tokens.filter(filled("tokens") if made else F.size("tokens") > 0).groupBy("yr").agg(F.count("*").alias("docs"))


def docs_per_year_all(tokens: DataFrame) -> DataFrame:
    """(yr, docs) over all documents, empty ones included."""
    return tokens.groupBy("yr").agg(F.count("*").alias("docs"))


def term_df_year(counts: DataFrame) -> DataFrame:
    """(yr, term, df) from rows that are unique by document and term."""
    return counts.groupBy("yr", "term").agg(F.count("*").alias("df"))


def global_df(term_df: DataFrame) -> DataFrame:
    """(term, df) over all years."""
    return term_df.groupBy("term").agg(F.sum("df").alias("df"))


def vocab_predicate(df: Column, total: Column, min_count: int, max_ratio: float) -> Column:
    return (df >= min_count) & (df / F.greatest(F.lit(1), total) <= max_ratio)


#: Terms that a task sorts about, terms of the sample for each range, and ranges at most.
SORTED, SAMPLED, RANGES = 100_000, 32, 512


def dense_ids(terms: DataFrame, column: str = "term", most: int = SORTED) -> DataFrame:
    """terms, each once, with term_id 0..V-1 in code-point order.

    Terms are counted first; up to `most` they are ranked in one task. More are cut into ranges by terms of a sample, those with the smallest hashes,
    so that the ranges hold about as many terms each whatever they begin with; a range's ids start at the count of those before it. The sample and
    the counts, a row a range, are bounded.
    """
    parts = min(RANGES, -(-terms.count() // most))
    if parts <= 1:
        return terms.withColumn("term_id", (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))
    sample = terms.select(column).orderBy(F.xxhash64(column), column).limit(SAMPLED * parts)
    # In Spark's order of strings, which is the order of their bytes.
    found = sample.select(column).orderBy(column).collect()
    bounds = [r[0] for r in found][SAMPLED - 1 :: SAMPLED][: parts - 1]
    keyed = terms.withColumn("_range", range_of(F.col(column), bounds))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    return keyed.join(F.broadcast(sizes), "_range").withColumn("term_id", (F.col("_before") + rank - 1).cast("int")).drop("_range", "_before")


def range_of(value: Column, bounds: list[str], first: int = 0) -> Column:
    """Number of bounds, in order, that are smaller than the value: a search by halves."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(value <= bounds[half], range_of(value, bounds[:half], first)).otherwise(range_of(value, bounds[half + 1 :], first + half + 1))


def vocabulary(term_df: DataFrame, docs: DataFrame, min_count: int, max_ratio: float) -> DataFrame:
    """(term, df, term_id): terms within the bounds (both inclusive); docs is docs_per_year."""
    total = docs.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("_total"))
    kept = global_df(term_df).crossJoin(F.broadcast(total)).filter(vocab_predicate(F.col("df"), F.col("_total"), min_count, max_ratio)).drop("_total")
    return dense_ids(kept)
