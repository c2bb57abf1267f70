"""Records of delimited files that may span lines, found in splits of files of any size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlineage.functions.joins import checked_small


def open_pattern(sep: str) -> re.Pattern[bytes]:
    """Matches a line, read from the beginning of a record, whose last field is quoted and still open. A field is quoted if it begins with a quote; a
    quote within it stands twice; what follows its end belongs to it up to the next separator. Quotes inside other fields are text."""
    s = re.escape(sep.encode())
    opened = rb'"[^"]*+(?:""[^"]*+)*+'
    field = rb'(?:' + opened + rb'"(?:[^"' + s + rb"][^" + s + rb"]*+)?|[^\"" + s + rb"][^" + s + rb"]*+)?"
    return re.compile(rb"(?:" + field + s + rb")*+" + opened + rb"\Z")


class Scan:
    """Whether the next line begins inside quotes."""

    def __init__(self, sep: str, encoding: str):
        self.pattern, self.encoding = open_pattern(sep), None if encoding.lower() in ("utf-8", "us-ascii") else encoding

    def text(self, line: bytes) -> bytes:
        """The line in UTF-8. In none of the encodings that are read by lines is a line feed part of another character."""
        return line if self.encoding is None else line.decode(self.encoding, "replace").encode()

    def after(self, line: bytes, inside: bool) -> bool:
        if b'"' not in line:
            return inside
        return self.pattern.match(b'"' + line if inside else line) is not None


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, block, value): lines as bytes, in order within a split; block is the split's first byte. A line is its split's in which it begins."""
    rows = spark.read.option("lineSep", "\n").text(paths)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Parts of batches that lie in one split each; splits come one after the other."""
    for b in batches:
        path, block = b.column("path").to_pylist(), b.column("block").to_pylist()
        i = 0
        while i < b.num_rows:
            j = i + 1
            while j < b.num_rows and block[j] == block[i] and path[j] == path[i]:
                j += 1
            yield (path[i], block[i]), b.slice(i, j - i)
            i = j


def starts(lines: DataFrame, scan: Scan) -> DataFrame:
    """(path, block, inside): whether a split begins inside quotes.

    A split takes either state to a state; that is found for each split apart. The states are then run through a file's splits, of which each is a
    row: from the last split before that ends in one state whatever it began with, an odd number of splits that exchange the states exchanges them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out, ins = None, False, True
        row = lambda: pa.RecordBatch.from_pydict({"path": [at[0]], "block": [at[1]], "a": [out], "b": [ins]})
        for key, part in in_blocks(batches):
            if key != at:
                if at is not None:
                    yield row()
                at, out, ins = key, False, True
            for line in part.column("value").to_pylist():
                if b'"' in line:
                    line = scan.text(line)
                    out, ins = scan.after(line, out), scan.after(line, ins)
        if at is not None:
            yield row()

    each = lines.mapInArrow(run, "path string, block long, a boolean, b boolean")
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("swaps", F.sum((F.col("a") & ~F.col("b")).cast("int")).over(order))
    fixed = F.col("a") == F.col("b")
    state = F.coalesce(F.last(F.when(fixed, F.col("a")), True).over(before), F.lit(False))
    since = F.coalesce(F.lag("swaps").over(order), F.lit(0)) - F.coalesce(F.last(F.when(fixed, F.col("swaps")), True).over(before), F.lit(0))
    return each.select("path", "block", (state != (since % 2 == 1)).alias("inside"))


def records(spark: SparkSession, paths: list[str], sep: str, encoding: str) -> DataFrame:
    """(path, line, record): the records of files, headers too, in UTF-8, with line feeds alone between their lines; line orders those of a file.

    Files are read twice, in splits: once for the state at each split's end, once to put lines together. A record that goes on in the next splits is put
    together from a piece of each. The list of splits, a row for maxPartitionBytes of input, is broadcast while it is short.
    """
    scan = Scan(sep, encoding)
    lines = lines_of(spark, paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, n, held = None, False, 0, []
        for key, part in in_blocks(batches):
            out: list[tuple] = []
            if key != at:
                if held:
                    out.append((*at, n, True, b"\n".join(held)))
                at, inside, held = key, part.column("inside")[0].as_py(), []
                n = -1 if inside else 0  # what begins before the split is its piece -1
            for line in part.column("value").to_pylist():
                line = scan.text(line)
                held.append(line)
                inside = scan.after(line, inside)
                if not inside:
                    out.append((*at, n, False, b"\n".join(held)))
                    n, held = n + 1, []
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([(*at, n, True, b"\n".join(held))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "block", "n", "goes_on", "record"])

    placed = lines.join(checked_small(starts(lines, scan)), ["path", "block"])
    found = placed.mapInArrow(run, "path string, block long, n long, goes_on boolean, record binary").withColumn("record", F.col("record").cast("string"))
    piece = (F.col("n") < 0) | F.col("goes_on")
    order = Window.partitionBy("path").orderBy("block", "n")
    pieces = found.filter(piece).withColumn("whole", F.sum((F.col("n") >= 0).cast("int")).over(order))
    joined = pieces.groupBy("path", "whole").agg(F.array_sort(F.collect_list(F.struct("block", "n", "record"))).alias("p"))
    joined = joined.select("path", (F.col("p")[0]["block"] + F.col("p")[0]["n"]).alias("line"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    rows = found.filter(~piece).select("path", (F.col("block") + F.col("n")).alias("line"), "record").unionByName(joined)
    return rows.withColumn("record", F.regexp_replace("record", r"\r(\n|\z)", "$1")).filter(F.trim("record") != "")
