"""A training corpus from `documents`: quality, toxicity, near duplicates, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlineage.llm import jaccard, mixing, packing, quality, toxicity
from textlineage.llm.common import cut, drop, scratch, table

#: Result columns inside a stage, apart from any that the documents may have.
NAMES = ("_stage_held_out", "_stage_score", "_stage_predicted")


def columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, accepts.

    A null text is judged as the empty one, a text of any length as a whole; a row with a null doc_id is judged like any other. Equal texts go or
    stay together, repeated rows stay repeated; a score at the threshold stays. An empty table stays empty; columns stay as they are, whatever their names.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, names=NAMES).filter(f"{NAMES[2]} = 1").select(*columns(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't flag.

    Nulls, empty and long texts, equal texts, repeated rows, empty tables and columns as in keep_quality; a score at the threshold goes. Without
    toxic labels none goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, names=NAMES).filter(f"{NAMES[2]} = 0").select(*columns(docs))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest doc_id and, if it stands at several texts of the class, of the least text hash.

    Texts that share a doc_id but are no near duplicates all stay, as do texts without words and rows with a null doc_id. A null text is empty; rows equal in doc_id
    and text are one. Texts of any length are compared whole. An empty table stays empty; columns stay as they are, whatever their names.
    """
    return jaccard.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once or, from smaller sources, twice, as the source weights say; none is dropped.

    A null source is the source ""; a null text is empty and, like any text without words, costs nothing. Rows that repeat an id, null ids too, are used
    equally often. An empty table stays empty; columns stay as they are, whatever their names.
    """
    return mixing.mix(docs, copies_only=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and places.

    A null or empty text is one token, a text of any length is packed whole. Repeated rows have pieces each, with their doc_id, which may be null. An empty
    table gives no pieces; other columns are ignored.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_each_class),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Classifiers, signatures and the packing program can't be written in SQL; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage leaves in the shared folder goes once the next one has been written, but for what the result reads."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            out = keep(cut(stage(spark, docs, sf_dir), f"pipeline-{i}"))
        if i:
            drop(docs)
        docs = out
    out = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are a table of their own
    drop(docs)
    return out
