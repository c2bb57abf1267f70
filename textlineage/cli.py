"""spark-submit entry points: `run` (all stages), `year` (one year's scores), `profile` (where its time goes), `stats` (reports), `sniff` (a file's format)."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession

from textlineage.config import Settings
from textlineage.operators import stats
from textlineage.operators.prune import top_k_terms
from textlineage.operators.weight import vector_docs
from textlineage.plans.lineage import single_year
from textlineage.plans.metrics import StageWatch
from textlineage.plans.runner import log_to, run_all
from textlineage.sources.artifacts import read_table, write_csv
from textlineage.sources.sniff import line_report


def load_settings(path: str) -> Settings:
    with open(path, encoding="utf-8") as f:
        values = json.load(f)
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def year_scores(spark: SparkSession, s: Settings, year: int) -> DataFrame:
    vectors = read_table(spark, f"{s.artifacts_dir}/vectors")
    base = read_table(spark, f"{s.artifacts_dir}/vectors_filtered") if s.use_filtered_vectors else vectors
    return single_year(base, vector_docs(vectors), year, s)


def profiled(df: DataFrame, path: str) -> str:
    """The formatted plan of a result, and Spark's figures of the stages that wrote it, the longest first."""
    with StageWatch(df.sparkSession) as watch:
        write_csv(df, path)
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return f"{plan}\n{watch.text()}\n"


def reports(spark: SparkSession, s: Settings, k: int) -> dict[str, str]:
    """The texts of all reports, by name, from the stage tables."""
    vectors, tokens = read_table(spark, f"{s.artifacts_dir}/vectors"), read_table(spark, f"{s.artifacts_dir}/tokens")
    term_df, words, per_year = (read_table(spark, f"{s.artifacts_dir}/{t}") for t in ("term_df", "vocab", "docs_per_year"))
    docs = vector_docs(vectors)
    top = top_k_terms(vectors, k, keep_all_if_not_positive=True)
    lengths = stats.row_lengths(vectors, docs)
    years, raw = docs.select("yr").distinct(), term_df.select("yr", "term", "df")
    return {
        "average vocabulary use": stats.report(stats.avg_vocab_usage(lengths).orderBy("yr"), {"yr": 10, "docs": 10, "avg_terms": 22}),
        "words of each year": stats.report(stats.yearly_top_terms(raw, per_year).orderBy("yr", "rank"), {"yr": 10, "rank": 6, "term": 24, "df": 12, "pct": 22}),
        "vocabulary size": stats.report(stats.yearly_vocab_size(raw, words).orderBy("yr"), {"yr": 10, "terms": 12}),
        "vocabulary size, all terms": stats.report(stats.yearly_vocab_size(raw).orderBy("yr"), {"yr": 10, "terms": 12}),
        "DF pair sums of all terms": stats.report(stats.df_pair_sum(raw, tokens.select("yr").distinct()).orderBy("yr_1", "yr_2"), {"yr_1": 10, "yr_2": 10, "s": 20}),
        "weights of the top terms": stats.report(stats.topk_weight_stats(top, docs).orderBy("yr"), {"yr": 10, "docs": 10, "mean_sum": 22, "mean_sum_sq": 22}),
        "DF pair sums of the top terms": stats.report(stats.df_pair_sum(stats.topk_df(top), years, key="term_id").orderBy("yr_1", "yr_2"), {"yr_1": 10, "yr_2": 10, "s": 20}),
        "row lengths": stats.report(stats.row_length_profile(lengths).orderBy("yr"), {"yr": 10, "n_rows": 10, "avg_len": 22, "p50": 10, "p90": 10, "p99": 10, "max_len": 10}),
        "row length histogram": stats.report(stats.row_length_histogram(lengths).orderBy("yr", "lo"), {"yr": 10, "lo": 6, "hi": 6, "n": 10, "pct": 22}),
    }


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textlineage")
    p.add_argument("command", choices=["run", "year", "profile", "stats", "sniff"])
    p.add_argument("settings", help="JSON file of Settings fields; a delimited file for sniff")
    p.add_argument("--year", type=int, default=2008)
    p.add_argument("--k", type=int, default=30)
    p.add_argument("--out")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("textlineage").getOrCreate()
    if a.command == "sniff":
        line_report(spark, a.settings).show(truncate=False)
        return 0
    s = load_settings(a.settings)
    log_to(s.log_file)
    logging.info("settings: %s", s)
    out = a.out or f"{s.artifacts_dir}/year={a.year}"
    if a.command == "run":
        run_all(spark, s, a.force).limit(20).show()
    elif a.command == "year":
        write_csv(year_scores(spark, s, a.year), out)
    elif a.command == "profile":
        print(profiled(year_scores(spark, s, a.year), out))
    else:
        for name, text in reports(spark, s, a.k).items():
            print(f"{name}\n{text}\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
