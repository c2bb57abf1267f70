"""Runs the stages over files, writing each as a table and resuming by setting hashes, year by year."""

from __future__ import annotations

import hashlib
import json
import logging
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from textlineage.config import Settings
from textlineage.functions.tokenize import tokenizer
from textlineage.operators import pairs, prune, score, vocab
from textlineage.plans.lineage import Lineage
from textlineage.plans.stages import Stages
from textlineage.sources import artifacts
from textlineage.sources.documents import by_document, list_files, read_documents
from textlineage.sources.stopwords import read_stopwords

log = logging.getLogger(__name__)


def log_to(path: str, level: int = logging.INFO) -> None:
    """The console and, with a path, a file that begins anew."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.FileHandler(path, mode="w", encoding="utf-8"))
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(message)s", handlers=handlers, force=True)


def input_state(spark: SparkSession, s: Settings) -> str | None:
    """A hash of the input's files, their sizes and times; None if there is none, as where only its stages were kept."""
    try:
        paths = [r.path for r in list_files(spark, s.data_path).collect()]
    except FileNotFoundError:
        return None
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        f = path_of(p).getFileSystem(conf).getFileStatus(path_of(p))
        found.append((p, f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(found).encode()).hexdigest()[:16]


def run_all(spark: SparkSession, s: Settings, force: bool = False) -> DataFrame:
    """All stages to the final table, each made or resumed as textlineage.plans.stages.Stages says. An input without rows gives tables without rows."""
    out = s.artifacts_dir
    stages = Stages(spark, s)
    if force:
        stages.manifest.clear()
    def make_tokens() -> DataFrame:
        tokens = vocab.tokenized(by_document(read_documents(spark, s)), tokenizer(s.tokenizer, s.user_dict_path))
        if s.stopword_paths or s.tokenizer != "regex":
            tokens = vocab.without_words(tokens, read_stopwords(spark, s.stopword_paths))
        return tokens

    tokens = stages.source("tokens", make_tokens, input_state(spark, s))
    plan = Lineage(tokens, s)
    years = sorted(int(p.partition("=")[2]) for p in stages.manifest.parts("tokens"))
    by_year, w, base = partial(stages.stage, by="yr", years=years), s.window_size, "vectors_filtered" if s.use_filtered_vectors else "vectors"
    until = lambda y: range(min(years), y + 1)
    plan.docs = stages.stage("docs_per_year", lambda: Lineage(tokens, s).docs, lambda m, _: m.contents("tokens"), of="tokens")
    plan.term_df = by_year("term_df", lambda: Lineage(tokens, s).term_df, lambda m, y: m.contents("tokens", [y]), of="tokens")
    plan.vocab = stages.stage("vocab", lambda: Lineage.vocab.func(plan), lambda m, _: m.contents("term_df") + m.contents("docs_per_year"))
    plan.vectors = by_year("vectors", lambda: Lineage.vectors.func(plan), lambda m, y: m.contents("tokens", until(y)) + m.contents("vocab"))
    plan.stopwords = read_stopwords(spark, s.prune_word_paths, built_in=False) if s.prune_word_paths else None
    plan.filtered = by_year("vectors_filtered", lambda: Lineage.filtered.func(plan), lambda m, y: m.contents("vectors", [y]) + m.contents("tokens", [y]) + m.contents("vocab"))
    if log.isEnabledFor(logging.DEBUG):
        for r in prune.prune_counts(plan.vectors, plan.removed, plan.filtered).orderBy("yr").collect():  # a row a year
            log.debug("pruning: %s", r.asDict())
    by_year("postings", lambda: pairs.postings(plan.base), lambda m, y: m.contents(base, [y]))
    plan.sides = by_year("pairs", lambda: Lineage.sides.func(plan), lambda m, y: m.contents(base, range(y, y + w + 1)), by="yr_x")
    settings = {"thr": s.similarity_threshold, "window_size": w, "method_version": s.method_version, "vectors_dir": base}
    stages.stage("pair_meta", lambda: pairs.pair_meta(plan.sides, plan.vector_docs, plan.year_pairs, **settings), lambda m, _: m.contents("pairs") + m.contents("vectors"), of="pairs")
    plan.scores = by_year("bsfs", lambda: pairs.side_scores(plan.vector_docs, plan.sides), lambda m, y: m.contents("vectors", [y]) + m.contents("pairs", range(y - w, y + 1)))
    titles = tokens.select("id", "yr", "title", *s.extra_cols).join(plan.vector_docs, ["id", "yr"], "left_semi")
    final = stages.stage("final", lambda: score.final_table(titles, plan.scores, s.epsilon, (s.col_id, s.col_year, s.col_title), s.extra_cols), lambda m, _: m.contents("bsfs") + m.contents("tokens"))
    if s.export_json:
        artifacts.export_json(plan.term_df, vocab.global_df(plan.term_df), plan.docs, plan.vocab, plan.year_pairs, f"{out}/json")
    if s.export_csv:
        artifacts.write_scores_csv(plan.scores, f"{out}/bsfs_csv")
    if s.final_csv:
        artifacts.write_csv(final.orderBy(s.col_year, s.col_id), s.final_csv)
    return final
