"""Document sources: delimited files with mixed encodings, and tables."""

from __future__ import annotations

import csv
import io
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlineage.config import Settings
from textlineage.functions.joins import checked_small
from textlineage.functions.scalar import concat_text, missing_to_null, parse_year
from textlineage.sources.records import records
from textlineage.sources.sniff import head


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the *.csv files in a folder (any case, not its subfolders), sorted; a file itself as it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(at).isDirectory():
        found = [path]
    else:
        found = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.isFile() and s.getPath().getName().lower().endswith(".csv"))
    return spark.createDataFrame([(p,) for p in found], "path string")


def plain_path(path: str, encoded: bool = False) -> str:
    """A path without its scheme and host, to compare those of listings with those of file metadata, which are percent-encoded."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "", unquote(path) if encoded else path)


def formats(spark: SparkSession, paths: list[str], encoding: str | None = None) -> dict[tuple[str, bool], list[str]]:
    """Files by (encoding, whether a record may span lines), from one pass over their lines as bytes.

    The encoding is the given one, or utf-8 where all lines are valid, else gb18030. A record spans lines only if a line has an odd number of
    quotes. Files of any size are checked in splits, never loaded whole.
    """
    if not paths:
        return {}
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("ok"), (F.regexp_count("value", F.lit('"')) % 2 == 1).alias("odd"))
    found = {plain_path(r.path, True): r for r in lines.groupBy("path").agg(F.bool_and("ok").alias("ok"), F.bool_or("odd").alias("odd")).filter("not ok or odd").collect()}
    out: dict[tuple[str, bool], list[str]] = {}
    for p in paths:
        r = found.get(plain_path(p))
        out.setdefault((encoding or ("gb18030" if r and not r.ok else "utf-8"), bool(r and r.odd) or (encoding or "").lower().startswith(("utf-16", "utf-32"))), []).append(p)
    return out


def header_of(spark: SparkSession, path: str, encoding: str, sep: str) -> list[str]:
    """Names in the first record of a file, of whose beginning the driver reads a bounded part."""
    text = head(spark, path, 1 << 16).decode(encoding, "replace").lstrip("\ufeff")
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])


def scan_csv(spark: SparkSession, path: str, columns: list[str], encoding: str | None = None, sep: str = ",") -> DataFrame:
    """The named columns as strings, with `_path` and `_line` (order in the file).

    A missing column raises RuntimeError, as do files that can't be read. Files with records over several lines, and those in encodings that Spark has no
    reader for, are cut into records in splits (textlineage.sources.records); of those in utf-16 or utf-32 each is one task's.
    """
    paths = [r.path for r in list_files(spark, path).collect()]
    parts = []
    for (enc, spans), group in formats(spark, paths, encoding).items():
        wide = enc.lower().startswith(("utf-16", "utf-32"))
        by_records = not wide and (spans or enc.lower() not in ("utf-8", "us-ascii", "iso-8859-1"))
        by_header: dict[tuple[str, ...], list[str]] = {}
        for p in group:
            header = header_of(spark, p, enc, sep)
            if lost := [c for c in columns if c not in header]:
                raise RuntimeError(f"failed to read {p}: no column {', '.join(lost)}")
            by_header.setdefault(tuple(header), []).append(p)
        for header, same in by_header.items():
            # A name that stands twice would be ambiguous; only the first is meant.
            schema = T.StructType([T.StructField(c if c not in header[:i] else f"_again_{i}", T.StringType()) for i, c in enumerate(header)])
            if by_records:
                ddl = ", ".join(f"`{f.name}` string" for f in schema)
                df = records(spark, same, sep, enc).filter("line > 0").select(F.from_csv("record", ddl, {"sep": sep, "escape": '"', "multiLine": "true"}).alias("r"), F.col("path").alias("_path"), F.col("line").alias("_line")).select("r.*", "_path", "_line")
            else:
                df = spark.read.schema(schema).option("encoding", enc).option("sep", sep).option("header", True).option("multiLine", spans).option("escape", '"').option("enforceSchema", True).csv(same)
                df = df.select("*", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_line"))
            parts.append(df.select(*[missing_to_null(F.col(f"`{c}`")).alias(c) for c in columns], "_path", "_line"))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_path", T.StringType()), T.StructField("_line", T.LongType())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    Implemented as min over a struct, which combines on the map side, so a key that holds a
    large part of the rows costs one row per task in the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_first")[c].alias(c) for c in [*order, *rest]]).select(*df.columns)


def documents(raw: DataFrame, s: Settings) -> DataFrame:
    """Raw rows -> (id, yr, title, text, extras...): type filter, year, text; one row per id.

    Rows without a year are dropped before ids are made unique, so that the result doesn't depend
    on how the input is cut. A missing id is the string "nan".
    """
    rows = raw if s.keep_type is None else raw.filter(F.col(s.col_type) == s.keep_type)
    col = lambda c: F.col(f"`{c}`")
    rows = rows.select(
        F.coalesce(col(s.col_id), F.lit("nan")).alias("id"),
        parse_year(col(s.col_year), col(s.col_fallback_date)).alias("yr"),
        F.coalesce(col(s.col_title), F.lit("")).alias("title"),
        concat_text([col(c) for c in s.text_parts]).alias("text"),
        *[F.coalesce(col(c), F.lit("")).alias(c) for c in s.extra_cols],
        "_path",
        "_line",
    ).filter(F.col("yr").isNotNull())
    return rows.join(checked_small(later_rows(rows)), ["_path", "_line"], "left_anti").drop("_path", "_line")


def later_rows(rows: DataFrame) -> DataFrame:
    """(_path, _line) of rows whose id stands before, found on keys alone, so that texts are in no aggregate; while such rows are few, which is
    counted, texts are in no shuffle either."""
    keys = rows.select("id", "_path", "_line")
    first = keys.groupBy("id").agg(F.min(F.struct("_path", "_line")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    return keys.join(first, "id").filter(F.struct("_path", "_line") != F.col("_first")).select("_path", "_line")


def read_documents(spark: SparkSession, s: Settings) -> DataFrame:
    columns = list(dict.fromkeys([s.col_id, s.col_year, s.col_type, s.col_title, *s.text_parts, s.col_fallback_date, *s.extra_cols]))
    return documents(scan_csv(spark, s.data_path, columns, s.encoding), s)


def by_document(df: DataFrame) -> DataFrame:
    """df dealt by document id before its texts become tokens.

    Term counts, norms and top-k lists group by document; dealt once as text, which is several times smaller than its
    token rows, they need no further shuffle. It also spreads scans of few splits.
    """
    return df.repartition("id")


def table_corpus(docs: DataFrame, keep_type: str | None = None) -> DataFrame:
    """The documented view of a `documents` table: synthetic year 2010 + doc_id % 8, type = lang, title = source."""
    rows = docs if keep_type is None else docs.filter(F.col("lang") == keep_type)
    return rows.select(
        F.col("doc_id").cast("string").alias("id"),
        (F.lit(2010) + F.col("doc_id") % 8).cast("int").alias("yr"),
        F.col("source").alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
        "lang",
    )
