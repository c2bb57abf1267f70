"""Registered queries over the driver's tables, with the settings of the oracle SQL in textlineage.oracles."""

from __future__ import annotations

import contextlib
import functools
import weakref
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlineage.config import Settings
from textlineage.functions.scalar import concat_text, parse_year
from textlineage.functions.tokenize import drop_words, regex_words
from textlineage.operators import blocks, pairs, prune, score, stats, vocab, weight
from textlineage.plans.lineage import Lineage, single_year
from textlineage.sources.documents import keep_first, table_corpus
from textlineage.sources.stopwords import clean_words

SETTINGS = Settings(tokenizer="regex", min_term_count=5, max_doc_freq_ratio=0.5, window_size=5, similarity_threshold=0.05, df_ratio_threshold=0.20, top_df_percent=0.002, topk_terms_per_doc=30, extra_cols=("lang",))
STOP = ["the", "of", "and", "to", "in"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


#: What the query that is being built keeps.
_plans: list[Lineage] = []


def release(plans: list[Lineage]) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        for plan in plans:
            plan.release()


def query(f: Query) -> Query:
    """Registers a query. What its lineage keeps is freed once its result is gone; a result derived from it is right after that too."""

    @functools.wraps(f)
    def built(spark: SparkSession, d: str) -> DataFrame:
        _plans.clear()
        out = f(spark, d).select("*")  # none that a lineage holds itself
        weakref.finalize(out, release, _plans[:]).atexit = False
        _plans.clear()
        return out

    QUERIES[f.__name__] = built
    return built


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table_corpus(table(spark, d, "documents"))


def lineage(spark: SparkSession, d: str) -> Lineage:
    words = spark.createDataFrame(pa.table({"term": STOP}))  # needs no Python worker
    _plans.append(Lineage(vocab.tokenized(corpus(spark, d), regex_words), SETTINGS, words, keep=True, wide=False))
    return _plans[-1]


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


@query
def q_scan(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", F.col("source").alias("title"), "n_chars")


@query
def q_clean_docs(spark, d):
    return corpus(spark, d).select("id", "yr", "text")


@query
def q_titled_docs(spark, d):
    return corpus(spark, d).select("id", "yr", "title", "text", "lang")


@query
def q_years(spark, d):
    return corpus(spark, d).select("yr").distinct()


@query
def q_stopwords(spark, d):
    """Sources and languages as lines of two lists, some blank, some with spaces around them."""
    docs = table(spark, d, "documents")
    lines = docs.select(F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "source", F.lit("  "))).alias("term"))
    return clean_words(lines.unionByName(docs.select(F.concat("lang", F.lit(" ")).alias("term"))))


@query
def q_filter_type(spark, d):
    return table(spark, d, "documents").filter(F.col("lang") == "en").select("doc_id", "source")


@query
def q_parse_year(spark, d):
    """Each order date in one of five forms, an unparsable one among them, by the order key."""
    date = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 6
    year = F.when(k == 0, date("yyyy")).when(k == 1, date("yyyyMM")).when(k == 2, F.lit("n.d."))
    text = F.when(k == 2, date("yyyy/MM/dd")).when(k == 3, date("yyyyMMdd")).when(k == 4, date("yyyy-MM-dd")).otherwise(F.lit("unknown"))
    rows = table(spark, d, "orders").select("o_orderkey", parse_year(year, text).alias("yr"))
    return rows.filter(F.col("yr").isNotNull())


@query
def q_concat_text(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", concat_text([F.nullif("p_name", F.lit("")), F.expr("nullif(p_brand, 'Brand#11')"), F.col("p_type")]).alias("text"))


@query
def q_tokenize(spark, d):
    return lineage(spark, d).tokens.select("id", F.posexplode("tokens").alias("pos", "token"))


@query
def q_tokens_json(spark, d):
    return lineage(spark, d).tokens.select("yr", F.to_json(F.struct("id", "title", "tokens", "lang")).alias("line"))


@query
def q_stop_antijoin(spark, d):
    return lineage(spark, d).tokens.select("id", F.posexplode(drop_words(F.col("tokens"), F.array(*map(F.lit, STOP)))).alias("pos", "token"))


@query
def q_dedup_first(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    return keep_first(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"])


@query
def q_docs_per_year(spark, d):
    return lineage(spark, d).docs


@query
def q_docs_per_year_all(spark, d):
    return vocab.docs_per_year_all(lineage(spark, d).tokens)


@query
def q_term_df_year(spark, d):
    return lineage(spark, d).term_df


@query
def q_global_df(spark, d):
    return vocab.global_df(lineage(spark, d).term_df)


@query
def q_vocab(spark, d):
    return lineage(spark, d).vocab


@query
def q_tf(spark, d):
    x = lineage(spark, d)
    return x.counts.join(x.vocab.select("term", "term_id"), "term").select("id", "yr", "term", "term_id", "tf")


@query
def q_prior_docs(spark, d):
    return weight.prior_docs(lineage(spark, d).docs)


@query
def q_retro_idf(spark, d):
    return lineage(spark, d).idf.select("yr", "term", "df_prior", "n_prior", *r6("idf"))


@query
def q_tfidf(spark, d):
    return lineage(spark, d).tfidf.select("id", "yr", "term", "tf", *r6("w"))


@query
def q_tfidf_l2(spark, d):
    return lineage(spark, d).vectors.select("id", "yr", "term", *r6("w"))


@query
def q_prune_stop(spark, d):
    x = lineage(spark, d)
    return prune.drop_columns(x.vectors, prune.stop_columns(x.vocab, x.stopwords), ["term"]).select("id", "term", *r6("w"))


@query
def q_df_ratio_cols(spark, d):
    x = lineage(spark, d)
    return prune.ratio_columns(x.term_df, x.docs, x.vocab, SETTINGS.df_ratio_threshold).select("yr", "term", "df")


@query
def q_top_df_cols(spark, d):
    x = lineage(spark, d)
    ratio = prune.ratio_columns(x.term_df, x.docs, x.vocab, SETTINGS.df_ratio_threshold)
    return prune.top_df_columns(x.term_df, x.vocab, ratio, SETTINGS.top_df_percent).select("yr", "term", "df")


@query
def q_topk_terms(spark, d):
    return lineage(spark, d).filtered.select("id", "yr", "term", *r6("w"))


@query
def q_postings(spark, d):
    rows = pairs.postings(lineage(spark, d).filtered)
    return rows.select("yr", "term_id", "part", "n_docs", F.array_join(F.transform("docs", lambda x: x["id"]), ",").alias("ids"), *r6("max_w"))


@query
def q_postings_scan(spark, d):
    return pairs.entries(pairs.postings(lineage(spark, d).filtered, most=8)).select("id", "yr", "term_id", *r6("w"))


@query
def q_prune_counts(spark, d):
    x = lineage(spark, d)
    return prune.prune_counts(x.vectors, x.removed, x.filtered)


@query
def q_posting_max(spark, d):
    return pairs.posting_max(lineage(spark, d).vectors).select("yr", "term_id", *r6("max_w"))


@query
def q_year_pairs(spark, d):
    return pairs.year_pairs(corpus(spark, d).select("yr").distinct(), SETTINGS.window_size)


@query
def q_pair_sim(spark, d):
    return lineage(spark, d).sims.select("yr_x", "yr_y", "id_x", "id_y", "n_terms", *r6("sim"))


@query
def q_pair_hits(spark, d):
    return lineage(spark, d).hits.select("yr_x", "yr_y", "id_x", "id_y", *r6("sim"))


@query
def q_pair_hits_prefix(spark, d):
    x = lineage(spark, d)
    found = blocks.similarity(x.lists, SETTINGS.window_size, SETTINGS.similarity_threshold, "prefix", hits=True)
    return found.select("yr_x", "yr_y", "id_x", "id_y", *r6("sim"))


@query
def q_pair_hits_bounded(spark, d):
    x = lineage(spark, d)
    found = blocks.similarity(x.lists, SETTINGS.window_size, SETTINGS.similarity_threshold, "bounded", hits=True)
    return found.select("yr_x", "yr_y", "id_x", "id_y", *r6("sim"))


@query
def q_contrib_x(spark, d):
    return lineage(spark, d).sides.filter("side = 'x' and hits > 0").select("yr_x", "yr_y", "id", *r6("contrib"))


@query
def q_contrib_y(spark, d):
    return lineage(spark, d).sides.filter("side = 'y' and hits > 0").select("yr_x", "yr_y", "id", *r6("contrib"))


@query
def q_pair_sides(spark, d):
    return lineage(spark, d).sides.select("yr_x", "yr_y", "side", "id", *r6("contrib"), "hits", "touched", "ops")


@query
def q_pair_meta(spark, d):
    x = lineage(spark, d)
    found = pairs.pair_meta(x.sides, x.vector_docs, x.year_pairs, thr=SETTINGS.similarity_threshold, window_size=SETTINGS.window_size, method_version=SETTINGS.method_version)
    return found.select("yr_x", "yr_y", "nx", "ny", *r6("avg_touched"), "max_touched", "hits", "thr", "window_size", "method_version")


@query
def q_pair_diag(spark, d):
    x = lineage(spark, d)
    return pairs.pair_diagnostics(x.sides, x.vector_docs, x.year_pairs).select("yr_x", "yr_y", *r6("touched_avg", "touched_p90"), "touched_max", "ops_total", *r6("ops_avg"))


@query
def q_bound_order(spark, d):
    x = lineage(spark, d)
    return pairs.bounded_terms(x.filtered, x.year_pairs).select("yr_x", "yr_y", "id", "term_id", "k", *r6("remain"))


@query
def q_pair_bounds(spark, d):
    x = lineage(spark, d)
    found = pairs.pair_bounds(blocks.bounds(x.filtered, SETTINGS.window_size, SETTINGS.similarity_threshold), x.vector_docs, x.year_pairs)
    return found.select("yr_x", "yr_y", *r6("pruned_avg", "pruned_p90", "remain_init", "remain_k1", "remain_k3", "remain_k5", "remain_k10"))


@query
def q_bs_fs(spark, d):
    return lineage(spark, d).scores.select("id", "yr", *r6("bs", "fs"))


@query
def q_bs_fs_year(spark, d):
    x = lineage(spark, d)
    return single_year(x.lists, x.vector_docs, 2014, SETTINGS).select("id", "yr", *r6("bs", "fs"))


@query
def q_quality(spark, d):
    """q rounded to 9 significant digits: with bs = 0 it is of the order of 1e7."""
    return lineage(spark, d).quality.select("id", "yr", *r6("bs", "fs"), F.when(F.col("bs") > 0, F.round("q", 4)).otherwise(F.round(F.col("q") / 1e8, 6)).alias("q"))


@query
def q_final(spark, d):
    x = lineage(spark, d)
    titles = x.tokens.select("id", "yr", "title", "lang").join(x.vector_docs, ["id", "yr"], "left_semi")
    rounded = x.scores.select("id", F.round("bs", 6).alias("bs"), F.round("fs", 6).alias("fs"))
    return score.final_table(titles, rounded, 1.0, ("id", "yr", "title"), ("lang",))


@query
def q_avg_vocab_usage(spark, d):
    x = lineage(spark, d)
    return stats.avg_vocab_usage(stats.row_lengths(x.vectors, x.vector_docs)).select("yr", "docs", *r6("avg_terms"))


@query
def q_row_len_profile(spark, d):
    x = lineage(spark, d)
    return stats.row_length_profile(stats.row_lengths(x.filtered, x.vector_docs)).select("yr", "n_rows", *r6("avg_len", "p50", "p90", "p99"), "max_len")


@query
def q_row_len_hist(spark, d):
    x = lineage(spark, d)
    return stats.row_length_histogram(stats.row_lengths(x.filtered, x.vector_docs)).select("yr", "lo", "hi", "n", *r6("pct"))


@query
def q_topk_weight_stats(spark, d):
    x = lineage(spark, d)
    return stats.topk_weight_stats(x.top, x.vector_docs).select("yr", "docs", *r6("mean_sum", "mean_sum_sq"))


@query
def q_topk_df(spark, d):
    return stats.topk_df(lineage(spark, d).top)


@query
def q_topk_df_pair_sum(spark, d):
    x = lineage(spark, d)
    return stats.df_pair_sum(stats.topk_df(x.top), x.vector_docs.select("yr").distinct(), key="term_id")


def in_vocab(x: Lineage) -> DataFrame:
    return x.term_df.join(x.vocab.select("term"), "term", "left_semi")


@query
def q_df_pair_sum(spark, d):
    x = lineage(spark, d)
    return stats.df_pair_sum(in_vocab(x), x.docs.select("yr"))


@query
def q_df_pair_total(spark, d):
    x = lineage(spark, d)
    return stats.df_pair_total(stats.df_pair_sum(in_vocab(x), x.docs.select("yr")))


@query
def q_yearly_top_vocab(spark, d):
    x = lineage(spark, d)
    return stats.yearly_top_terms(x.term_df, x.docs).select("yr", "rank", "term", "df", *r6("pct"))


@query
def q_yearly_vocab_size(spark, d):
    x = lineage(spark, d)
    return stats.yearly_vocab_size(x.term_df, x.vocab)


@query
def q_vocab_union(spark, d):
    return stats.vocab_union(lineage(spark, d).term_df)


@query
def q_row_count(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n_rows"))


@query
def q_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").limit(20)
