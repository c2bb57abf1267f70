"""Source divergence audit: terms counted and pairs of sources summed by DuckDB in shards of (lang, term); Spark merges sums and rankings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlineage.llm.common import cut, partitions, scratch, steps

#: Documents of a language that a kept term stands in at least, and ranks of terms that are given.
LEAST_DOCS, TOP_TERMS = 10, 10
SCALE, SMOOTH = 1_000_000_000, 2
#: Bytes of text that a task counts at once, and bytes of text a shard.
CHUNK_BYTES, SHARD_BYTES = 1 << 24, 1 << 25
#: Partial counts after which a shard adds them up.
HELD_ROWS = 1 << 20
MEMORY = "500MB"

UPPER = "".join(map(chr, range(65, 91)))
#: ASCII characters that end a term.
APART = "".join(chr(i) for i in range(128) if not chr(i).isalpha() and i != 32)

COUNTED = "lang string, source string, term string, n long, df long"
KEPT = "lang string, source string, term string, n long, lead int"
FOUND = "part string, lang string, source string, item string, value long"

COUNT = """
WITH words AS (SELECT r, lang, source, unnest(string_split(translate(text, $1, $2), ' ')) AS term FROM chunk),
docs AS (SELECT r, lang, source, term, count(*) AS n FROM words WHERE term <> '' GROUP BY ALL)
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS df FROM docs GROUP BY lang, source, term
UNION ALL SELECT DISTINCT lang, source, NULL, 0, 0 FROM chunk
"""
ADD = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(df) AS BIGINT) AS df FROM {} GROUP BY lang, source, term"
KEEP = """
SELECT lang, source, term, n, CAST(row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS INTEGER) AS lead
FROM counts WHERE term IS NOT NULL QUALIFY sum(df) OVER (PARTITION BY lang, term) >= $1
UNION ALL SELECT lang, source, NULL, 0, 0 FROM counts WHERE term IS NULL
"""
#: p of a count, and f of two of them, exact: p * SCALE is a HUGEINT, squares of differences up to SCALE are BIGINTs.
MACROS = (
    f"CREATE MACRO share(n, total, v) AS CAST(1 + {SCALE}::HUGEINT * (n + {SMOOTH}) // (total + {SMOOTH} * v) AS BIGINT)",
    "CREATE MACRO apart(p, q) AS (p - q) * (p - q) // (p + q)",
)
SHARES = """
CREATE TABLE shares AS SELECT k.lang, k.source, k.term, share(k.n, g.total, g.v) AS p, share(0, g.total, g.v) AS z,
    share(CAST(sum(k.n) OVER (PARTITION BY k.lang, k.term) AS BIGINT), g.lang_total, g.v) AS q
FROM kept k JOIN groups g ON g.lang = k.lang AND g.source = k.source
"""
#: What the terms that stand in both of two sources, in one of them, and most in a source against its language add.
PARTIAL = """
SELECT 'pair' AS part, a.lang, a.source, b.source AS item, CAST(sum(apart(a.p, b.p) - apart(a.p, b.z) - apart(a.z, b.p) + apart(a.z, b.z)) AS BIGINT) AS value
FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source > a.source GROUP BY a.lang, a.source, b.source
UNION ALL
SELECT 'pair', h.lang, least(h.source, o.source), greatest(h.source, o.source), CAST(sum(h.m * (apart(h.p, share(0, o.total, o.v)) - apart(h.z, share(0, o.total, o.v)))) AS BIGINT)
FROM (SELECT lang, source, p, z, count(*) AS m FROM shares GROUP BY ALL) h JOIN groups o ON o.lang = h.lang AND o.source <> h.source GROUP BY ALL
UNION ALL
SELECT 'term', lang, source, term, apart(p, q) FROM shares WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY apart(p, q) DESC, term) <= $1
"""


@contextmanager
def engine() -> Iterator[duckdb.DuckDBPyConnection]:
    """A database in this task's memory, of one thread and without a folder to spill to."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})
    try:
        yield con
    finally:
        con.close()


def batches_of(con: duckdb.DuckDBPyConnection, sql: str, layout: str, values: list | None = None) -> Iterator[pa.RecordBatch]:
    """A result's batches, with the types of a layout."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(c, kinds[k]) for c, k in (f.split() for f in layout.split(", "))])
    yield from con.sql(sql, params=values or []).to_arrow_table().cast(schema).to_batches(max_chunksize=1 << 16)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): partial counts of the texts of a task, and a row without a term for each of its sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with engine() as con:
            for batch in batches:
                for b in steps(batch, "text", CHUNK_BYTES):
                    con.register("chunk", pa.Table.from_batches([b]).append_column("r", pa.array(np.arange(b.num_rows))))
                    yield from batches_of(con, COUNT, COUNTED, [UPPER + APART, UPPER.lower() + " " * len(APART)])
                    con.unregister("chunk")

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, COUNTED)


def kept_terms(counts: DataFrame, shards: int) -> DataFrame:
    """(lang, source, term, n, lead): counts of the terms in LEAST_DOCS documents of their language, lead 1 in one row a term, and the rows without a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with engine() as con:
            con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, df BIGINT)")
            rows = 0
            for batch in batches:
                con.register("part", pa.Table.from_batches([batch]))
                con.execute("INSERT INTO counts " + ADD.format("part"))
                con.unregister("part")
                rows += batch.num_rows
                if rows > HELD_ROWS:
                    con.execute("CREATE TABLE less AS " + ADD.format("counts"))
                    con.execute("DROP TABLE counts; ALTER TABLE less RENAME TO counts")
                    rows = 0
            con.execute("CREATE TABLE less AS " + ADD.format("counts"))
            con.execute("DROP TABLE counts; ALTER TABLE less RENAME TO counts")
            yield from batches_of(con, KEEP, KEPT, [LEAST_DOCS])

    shard = F.pmod(F.xxhash64("lang", F.coalesce("term", "source")), F.lit(shards)).cast("int")
    return counts.repartitionById(shards, shard).mapInArrow(run, KEPT)


def partial_sums(kept: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """(part, lang, source, item, value) of each shard: what its terms add to pairs of sources (source < item), and its first terms of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with engine() as con:
            con.execute("CREATE TABLE kept (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT)")
            con.execute("CREATE TABLE groups (lang VARCHAR, source VARCHAR, total BIGINT, v BIGINT, lang_total BIGINT)")
            for sql in MACROS:
                con.execute(sql)
            for batch in batches:
                con.register("part", pa.Table.from_batches([batch]))
                con.execute("INSERT INTO kept SELECT lang, source, term, n FROM part WHERE term IS NOT NULL")
                con.execute("INSERT INTO groups SELECT lang, source, n, v, lang_total FROM part WHERE term IS NULL")
                con.unregister("part")
            con.execute(SHARES)
            con.execute("DROP TABLE kept")
            yield from batches_of(con, PARTIAL, FOUND, [TOP_TERMS])

    none = F.lit(None).cast("long")
    rows = kept.filter("term is not null").select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), "lang", "source", "term", "n", none.alias("v"), none.alias("lang_total"))
    # Each shard gets all groups: as many rows as there are sources of all languages.
    every = groups.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "v", "lang_total")
    return rows.unionByName(every).repartitionById(shards, F.col("shard")).drop("shard").mapInArrow(run, FOUND)


def share(total: Column, v: Column) -> Column:
    """p of a term that a group doesn't have; v is above 0 wherever it is used."""
    return 1 + F.call_function("div", F.lit(SMOOTH * SCALE), F.greatest(total + SMOOTH * v, F.lit(1)))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language stands from the others (`pair`, all ranks) and the terms that tell it from
    its language (`term`, ranks to TOP_TERMS).

    Tasks count the terms of their texts; counts are dealt by (lang, term) to shards, which add them up and keep the terms in LEAST_DOCS documents. With
    the sums of all groups each shard then adds up its terms' part of every pair: what terms in both sources add, and what a term in one adds
    against the share of a missing term, by how many terms have the same count. Terms in neither add a constant, put in by Spark with the number of
    terms. So pairs of sources meet on common terms alone, and no shard writes out terms that a source lacks. All arithmetic is in whole numbers.

    Each row of the table is a document, repeated ids and rows too. Null lang, source and text are empty strings; an empty or blank text has no
    terms, yet its source is a group; texts of any length are read whole. Equal values are ranked by item in UTF-8 order. A language
    without kept terms gives pairs of value 0 and no terms, one with a single source no pairs. An empty table gives an empty table. Other columns are ignored.
    """
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first().b or 0
    shards = max(partitions(docs), -(-size // SHARD_BYTES))
    with scratch(docs.sparkSession) as keep:
        kept = cut(kept_terms(counted(docs), shards), "divergence-terms")
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("lead").alias("lead"))
        own = Window.partitionBy("lang")
        groups = keep(cut(sums.select("lang", "source", "total", F.sum("lead").over(own).alias("v"), F.sum("total").over(own).alias("lang_total")), "divergence-groups"))
        found = keep(cut(partial_sums(kept, groups, shards), "divergence-sums"))
    a = groups.select("lang", "source", F.col("v"), share(F.col("total"), F.col("v")).alias("z"))
    b = groups.select("lang", F.col("source").alias("item"), share(F.col("total"), F.col("v")).alias("z2"))
    pairs = a.join(b, "lang").filter("source <> item").select("lang", F.least("source", "item").alias("_a"), F.greatest("source", "item").alias("_b"), "source", "item", (F.col("v") * apart(F.col("z"), F.col("z2"))).alias("base"))
    added = found.filter("part = 'pair'").groupBy("lang", F.col("source").alias("_a"), F.col("item").alias("_b")).agg(F.sum("value").alias("s"))
    pairs = pairs.join(added, ["lang", "_a", "_b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("base") + F.coalesce("s", F.lit(0))).alias("value"))
    rows = pairs.unionByName(found.filter("part = 'term'").select("lang", "source", "part", "item", "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))
