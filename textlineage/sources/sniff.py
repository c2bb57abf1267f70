"""Format of a delimited file: encoding, delimiter, header; looks at a bounded prefix on the driver."""

from __future__ import annotations

import csv
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = ",\t;|"


def head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def detect_encoding(data: bytes) -> str:
    """utf-8-sig, utf-8 or gb18030, the first that decodes; a character cut at the end doesn't count."""
    if data.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    for enc in ("utf-8", "gb18030"):
        for cut in range(4):
            try:
                data[: len(data) - cut].decode(enc)
                return enc
            except UnicodeDecodeError:
                pass
    return "utf-8"


def detect_delimiter(text: str) -> str:
    """The delimiter that splits most lines into the same number (over 1) of fields; a comma if none does."""
    lines = [x for x in text.splitlines() if x]
    best = (0, ",")
    for d in DELIMITERS:
        if counts := Counter(n for x in lines if (n := len(next(csv.reader([x], delimiter=d)))) > 1):
            best = max(best, (counts.most_common(1)[0][1], d), key=lambda x: x[0])
    return best[1]


def has_header(text: str) -> bool:
    """True unless the csv module sees none."""
    try:
        return csv.Sniffer().has_header(text)
    except csv.Error:
        return True


def sniff(spark: SparkSession, path: str) -> dict:
    raw = head(spark, path, 1 << 20)
    enc = detect_encoding(raw[: 1 << 18])
    text = raw.decode(enc, errors="ignore")
    return {"encoding": enc, "delimiter": detect_delimiter(text), "has_header": has_header(text)}


def line_report(spark: SparkSession, path: str) -> DataFrame:
    """Format, physical lines, and data rows without the header line."""
    found = sniff(spark, path)
    lines = spark.read.text(path).agg(F.count("*").alias("physical_lines"))
    return lines.select(
        F.lit(path).alias("file"), *[F.lit(v).alias(k) for k, v in found.items()], "physical_lines",
        F.greatest(F.lit(0), F.col("physical_lines") - int(found["has_header"])).alias("data_rows_estimate"),
    )
