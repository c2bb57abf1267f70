"""Retrospective TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlineage.functions.joins import MOST_BROADCAST, checked_small
from textlineage.functions.scalar import retro_idf
from textlineage.operators.vocab import steps


def prior_docs(docs: DataFrame) -> DataFrame:
    """(yr, docs, n_prior): documents of strictly earlier years. One row per year goes through the window."""
    before = Window.orderBy("yr").rowsBetween(Window.unboundedPreceding, -1)
    return docs.select("yr", "docs", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("n_prior"))


def idf_by_year(term_df: DataFrame, docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(yr, term, term_id, df, df_prior, n_prior, idf) for vocabulary terms in the years that use them.

    The running sum needs rows only for years in which the term occurs, since no other year weights it.
    """
    before = Window.partitionBy("term").orderBy("yr").rowsBetween(Window.unboundedPreceding, -1)
    rows = term_df.join(vocab.select("term", "term_id"), "term").withColumn("df_prior", F.coalesce(F.sum("df").over(before), F.lit(0)))
    rows = rows.join(F.broadcast(prior_docs(docs).select("yr", "n_prior")), "yr")
    return rows.withColumn("idf", retro_idf(F.col("n_prior"), F.col("df_prior")))


#: Vocabulary terms up to which their idf, a row a term with all its years, is broadcast: some 200 bytes each.
MOST_TERMS = 2_000_000


def tfidf(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, yr, term, term_id, tf, idf, w): documents without a vocabulary term leave here.

    While the vocabulary is short, which is counted first, the counts stay where they are, by document, and so need no shuffle for norms and top lists.
    """
    terms = checked_small(idf.groupBy("term").agg(F.first("term_id").alias("term_id"), F.map_from_entries(F.collect_list(F.struct("yr", "idf"))).alias("_years")), MOST_TERMS)
    rows = counts.join(terms, "term").select("id", "yr", "term", "term_id", "tf", F.try_element_at("_years", F.col("yr")).alias("idf"))
    return rows.withColumn("w", F.col("tf") * F.col("idf"))


def l2_normalize(vectors: DataFrame) -> DataFrame:
    """w over the norm of its document; a zero vector stays zero, and zero weights stay as rows."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return vectors.withColumn("_norm", norm).withColumn("w", F.when(F.col("_norm") > 0, F.col("w") / F.col("_norm")).otherwise(F.lit(0.0))).drop("_norm")


#: Vocabulary terms times years up to which their idf is one array that every worker holds: 8 bytes each.
MOST_CELLS = 1 << 24
#: Entries of documents that a step weights.
ENTRIES = 1 << 20


@dataclass
class Weights:
    """The vocabulary, by term_id, and the idf of each term (row) and year (column); removed: what pruning takes from a year, if asked for."""

    terms: pa.Array
    years: np.ndarray
    idf: np.ndarray
    removed: np.ndarray | None = None


def weights(idf: DataFrame, vocab: DataFrame, docs: DataFrame, removed: DataFrame | None = None) -> Weights | None:
    """The idf as arrays, for `vectors_of` and `top_lists`; None where they would be too long, which is counted first, so that joins have to do."""
    years = np.sort(np.array([r.yr for r in docs.select("yr").collect()], np.int64))  # a row a year
    n = vocab.count()
    if n * max(1, len(years)) > MOST_CELLS or (removed is not None and removed.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST):
        return None
    words = vocab.select("term_id", "term").toArrow()
    words = words.take(pc.sort_indices(words["term_id"]))["term"].combine_chunks()
    rows = idf.select("term_id", "yr", "idf").toArrow()
    of = lambda t: (t["term_id"].to_numpy(), np.searchsorted(years, t["yr"].to_numpy()))
    out = Weights(words, years, np.zeros((n, len(years))))
    out.idf[of(rows)] = rows["idf"].to_numpy()
    if removed is not None:
        out.removed = np.zeros(out.idf.shape, bool)
        out.removed[of(removed.select("term_id", "yr").toArrow())] = True
    return out


def weighted(rows: pa.RecordBatch, t: Weights, normal: bool) -> tuple[np.ndarray, ...]:
    """Document, from 0, term_id, tf, idf and weight of each vocabulary entry of document_counts; normal: over the norm of its document."""
    doc = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(rows.column("terms")), 0).to_numpy(zero_copy_only=False))
    term = pc.fill_null(pc.index_in(rows.column("terms").flatten(), value_set=t.terms), -1).to_numpy(zero_copy_only=False)
    known = np.flatnonzero(term >= 0)
    doc, term, tf = doc[known], term[known], rows.column("tfs").flatten().to_numpy(zero_copy_only=False)[known].astype(np.int64)
    year = np.searchsorted(t.years, rows.column("yr").to_numpy(zero_copy_only=False))[doc]
    idf = t.idf[term, year]
    w = tf * idf
    if normal:
        norm = np.sqrt(np.bincount(doc, w * w, minlength=rows.num_rows))[doc]
        w = np.divide(w, norm, out=np.zeros(len(w)), where=norm > 0)
    return doc, term, tf, idf, w, year


def vectors_of(counts: DataFrame, known: Broadcast, normal: bool = True) -> DataFrame:
    """l2_normalize(tfidf(...)), or tfidf alone, of document_counts, each document in its own row, with no join, shuffle or sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = known.value
        for rows in steps(batches, "terms", ENTRIES):
            doc, term, tf, idf, w, _ = weighted(rows, t, normal)
            own = [rows.column(c).take(pa.array(doc)) for c in ("id", "yr")]
            yield pa.RecordBatch.from_arrays([*own, t.terms.take(pa.array(term)), pa.array(term), pa.array(tf), pa.array(idf), pa.array(w)], ["id", "yr", "term", "term_id", "tf", "idf", "w"])

    return counts.mapInArrow(run, f"{types(counts)}, term string, term_id int, tf long, idf double, w double")


def top_lists(counts: DataFrame, known: Broadcast, k: int) -> DataFrame:
    """(id, yr, terms, term_ids, ws): the k largest signed weights, of any that are left of every document with a vector, ties by term, zeros dropped.

    Zeros, and what pruning removes if the weights say so, go before ranks are given; else zeros go after them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = known.value
        for rows in steps(batches, "terms", ENTRIES):
            doc, term, _, _, w, year = weighted(rows, t, True)
            has = np.unique(doc)
            if t.removed is not None:
                stays = (w != 0) & ~t.removed[term, year]
                doc, term, w = doc[stays], term[stays], w[stays]
            order = np.lexsort((term, -np.round(w, 12), doc))
            doc, term, w = doc[order], term[order], w[order]
            first = np.searchsorted(doc, np.arange(rows.num_rows))
            stays = (np.arange(len(doc)) - first[doc] < k) & (w != 0)
            doc, term, w = doc[stays], term[stays], w[stays]
            cuts = pa.array(np.append(np.searchsorted(doc, has), len(doc)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, v) for v in (t.terms.take(pa.array(term)), pa.array(term), pa.array(w))]
            yield pa.RecordBatch.from_arrays([*[rows.column(c).take(pa.array(has)) for c in ("id", "yr")], *lists], ["id", "yr", "terms", "term_ids", "ws"])

    return counts.mapInArrow(run, f"{types(counts)}, terms array<string>, term_ids array<int>, ws array<double>")


def types(counts: DataFrame) -> str:
    return ", ".join(f"{c} {counts.schema[c].dataType.simpleString()}" for c in ("id", "yr"))


def listed_entries(lists: DataFrame) -> DataFrame:
    """(id, yr, term, term_id, w): a row an entry of top_lists."""
    return lists.select("id", "yr", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("term_ids").alias("term_id"), F.col("ws").alias("w"))))


def vector_docs(vectors: DataFrame) -> DataFrame:
    """(id, yr) of every document with a vector, whatever pruning takes from it later."""
    return vectors.select("id", "yr").distinct()
