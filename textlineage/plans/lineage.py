"""The whole computation as one lazy plan, stage by stage."""

from __future__ import annotations

from functools import cached_property

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlineage.config import Settings
from textlineage.functions.joins import checked_small
from textlineage.operators import blocks, pairs, prune, score, vocab, weight


class Lineage:
    """Stages of one corpus. Each is a DataFrame; nothing runs until a result is read, but that the vocabulary, idf and the columns
    to remove are counted, to choose how they are ranked and joined, so are the entries of years before pairs, and with `keep` the documents of years are listed.

    tokens: (id, yr, title, tokens, extras...). Stages that later ones read are kept (memory, then disk) when `keep` is set, until `release`.
    Term counts and vectors, which have a row a document and term and are several times the input, are not with `wide` unset: they are made again from
    the tokens where they are read, each document in its own row by arrays of the idf that workers hold, while these are short.
    """

    def __init__(self, tokens: DataFrame, settings: Settings, stopwords: DataFrame | None = None, keep: bool = False, wide: bool = True):
        self.tokens, self.s, self.stopwords, self.keep, self.wide = tokens, settings, stopwords, keep, wide
        self._kept: list[DataFrame] = []
        self._sent: list[Broadcast] = []

    def kept(self, df: DataFrame, wide: bool = False) -> DataFrame:
        if self.keep and (self.wide or not wide):
            self._kept.append(df.persist())
        return df

    def listed(self, df: DataFrame) -> DataFrame:
        """A stage of a row a year or pair of years, made at once when stages are kept: plans that read it stay short."""
        return df.sparkSession.createDataFrame(df.toArrow()) if self.keep else df

    def release(self) -> None:
        """Frees what was kept, once the results are read."""
        for df in self._kept:
            df.unpersist()
        for known in self._sent:
            known.unpersist()
        self._kept.clear()
        self._sent.clear()

    @cached_property
    def counts(self) -> DataFrame:
        return self.kept(vocab.term_counts(self.tokens), wide=True)

    @cached_property
    def repeated(self) -> bool:
        return vocab.repeats(self.tokens)

    @cached_property
    def document_counts(self) -> DataFrame:
        return vocab.document_counts(self.tokens, self.repeated)

    @cached_property
    def docs(self) -> DataFrame:
        return self.listed(vocab.docs_per_year(self.tokens, made=not self.wide))

    @cached_property
    def term_df(self) -> DataFrame:
        return self.kept(vocab.term_df_year(self.counts) if self.keep and self.wide else vocab.term_df(self.tokens, self.repeated))

    @cached_property
    def vocab(self) -> DataFrame:
        return self.kept(vocab.vocabulary(self.term_df, self.docs, self.s.min_term_count, self.s.max_doc_freq_ratio))

    @cached_property
    def idf(self) -> DataFrame:
        return weight.idf_by_year(self.term_df, self.docs, self.vocab)

    def sent(self, removed: DataFrame | None = None) -> Broadcast | None:
        """The idf as arrays that workers hold; None with `wide`, and where they would be too long."""
        found = None if self.wide else weight.weights(self.idf, self.vocab, self.docs, removed)
        if found is None:
            return None
        self._sent.append(self.tokens.sparkSession.sparkContext.broadcast(found))
        return self._sent[-1]

    @cached_property
    def weights(self) -> Broadcast | None:
        return self.sent()

    @cached_property
    def tfidf(self) -> DataFrame:
        if self.weights:
            return weight.vectors_of(self.document_counts, self.weights, normal=False)
        return weight.tfidf(self.counts if self.keep and self.wide else vocab.term_counts(self.tokens, dealt=True), self.idf)

    @cached_property
    def vectors(self) -> DataFrame:
        if self.weights:
            return weight.vectors_of(self.document_counts, self.weights)
        return self.kept(weight.l2_normalize(self.tfidf), wide=True)

    @cached_property
    def pruned(self) -> DataFrame | None:
        """The pruned vectors, a row a document with a vector."""
        known = self.sent(self.removed) if self.s.topk_terms_per_doc > 0 and not self.wide else None
        return self.kept(weight.top_lists(self.document_counts, known, self.s.topk_terms_per_doc)) if known else None

    @cached_property
    def top_lists(self) -> DataFrame | None:
        """The top terms of vectors that nothing was pruned from, a row a document with a vector."""
        k = self.s.topk_terms_per_doc
        return self.kept(weight.top_lists(self.document_counts, self.weights, k)) if k > 0 and self.weights else None

    @cached_property
    def top(self) -> DataFrame:
        if self.top_lists is not None:
            return weight.listed_entries(self.top_lists)
        return prune.top_k_terms(self.vectors, self.s.topk_terms_per_doc, keep_all_if_not_positive=True)

    @cached_property
    def vector_docs(self) -> DataFrame:
        if self.wide:
            return self.kept(weight.vector_docs(self.vectors))
        for lists in ("top_lists", "pruned"):
            if self.__dict__.get(lists) is not None:  # made already
                return self.__dict__[lists].select("id", "yr")
        terms = vocab.term_counts(self.tokens).join(checked_small(self.vocab.select("term"), weight.MOST_TERMS), "term", "left_semi")
        return self.kept(weight.vector_docs(terms))  # without the vectors' shuffle

    @cached_property
    def removed(self) -> DataFrame:
        s = self.s
        return self.kept(prune.removed_columns(self.term_df, self.docs, self.vocab, self.stopwords, s.df_ratio_threshold, s.top_df_percent))

    @cached_property
    def filtered(self) -> DataFrame:
        if self.pruned is not None:
            return weight.listed_entries(self.pruned)
        return self.kept(prune.prune(self.vectors, self.removed, self.s.topk_terms_per_doc))

    @cached_property
    def lists(self) -> DataFrame:
        """`filtered` with a row a document where it is kept so, else as it is: what pairs are made from."""
        if self.pruned is None:
            return self.filtered
        return self.pruned.select("id", "yr", F.col("term_ids").alias("terms"), "ws").filter(F.size("terms") > 0)

    @cached_property
    def paired(self) -> DataFrame:
        return self.lists if self.s.use_filtered_vectors else self.vectors

    @cached_property
    def base(self) -> DataFrame:
        return self.filtered if self.s.use_filtered_vectors else self.vectors

    @cached_property
    def sims(self) -> DataFrame:
        """The pairs that the strategy looks at: native all that share a term, prefix and bounded those that their bounds leave."""
        return blocks.similarity(self.paired, self.s.window_size, self.s.similarity_threshold, self.strategy)

    @property
    def strategy(self) -> str:
        """A threshold that isn't above 0 leaves bounds nothing to rule out."""
        return self.s.pair_strategy if self.s.similarity_threshold > 0 else "native"

    @cached_property
    def hits(self) -> DataFrame:
        return blocks.similarity(self.paired, self.s.window_size, self.s.similarity_threshold, self.strategy, hits=True)

    @cached_property
    def year_pairs(self) -> DataFrame:
        return self.listed(pairs.year_pairs(self.vector_docs.select("yr").distinct(), self.s.window_size))

    @cached_property
    def sides(self) -> DataFrame:
        """What each document gets from each pair of years."""
        return blocks.sides(self.paired, self.s.window_size, self.s.similarity_threshold, self.strategy)

    @cached_property
    def scores(self) -> DataFrame:
        return pairs.side_scores(self.vector_docs, self.sides)

    @cached_property
    def quality(self) -> DataFrame:
        return score.quality(self.scores, self.s.epsilon)


def single_year(base: DataFrame, docs: DataFrame, year: int, settings: Settings) -> DataFrame:
    """bs and fs of one year's documents; on a table partitioned by year only 2 * window + 1 partitions are read."""
    w = settings.window_size
    near = base.filter(F.col("yr").between(year - w, year + w))
    # Only pairs with the target year on a side.
    sums = blocks.sides(near, w, settings.similarity_threshold, year=year)
    return pairs.side_scores(docs.filter(F.col("yr") == year), sums)
