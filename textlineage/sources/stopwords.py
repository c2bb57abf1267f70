"""Stop words: built-in list and text files."""

from __future__ import annotations

import logging

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The built-in stop words.
BUILT_IN = [
    "本发明", "实用新型", "外观设计", "权利要求", "特征", "涉及", "公开", "提供", "实施例", "所述", "其中", "及其",
    "用于", "一种", "方法", "装置", "系统", "组件", "结构", "步骤", "属于", "技术领域", "背景技术", "优选", "位于",
    "连接", "附图", "示意图", "包含", "包括", "使得", "能够", "相比", "现有技术", "其特征在于",
]


def gb18030(lines: Column) -> Column:
    """Text of lines in that encoding, which Spark itself decodes only under a setting of the session."""

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: bytes(b).decode("gb18030", "replace"))

    return decode(lines)


def clean_words(words: DataFrame, column: str = "term") -> DataFrame:
    """Trimmed, non-empty, distinct words of one column, as `term`."""
    return words.select(F.trim(F.col(column)).alias("term")).filter("term <> ''").distinct()


def read_stopwords(spark: SparkSession, paths: list[str] | tuple[str, ...] = (), built_in: bool = True) -> DataFrame:
    """Built-in words with the lines of files or of *.txt under folders; utf-8, else gb18030.

    A path that can't be read is logged and skipped.
    """
    out = spark.createDataFrame([(w,) for w in (BUILT_IN if built_in else [])], "term string")
    for p in paths:
        try:
            reader = spark.read.option("recursiveFileLookup", True)
            lines = (reader.option("pathGlobFilter", "*.[tT][xX][tT]") if not p.lower().endswith(".txt") else reader).text(p)
            lines = lines.select("value", F.col("_metadata.file_path").alias("path"))
            good = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("ok"))
            text = F.when(F.col("ok"), F.col("value")).otherwise(gb18030(F.col("value").cast("binary")))
            words = lines.join(good, "path").select(F.regexp_replace(text, "^\\s+|\\s+$", "").alias("term"))
            words.isEmpty()
            out = out.unionByName(words)
        except Exception as e:  # noqa: BLE001
            logging.getLogger(__name__).warning("stop words at %s skipped: %s", p, str(e).splitlines()[0])
    return clean_words(out)
