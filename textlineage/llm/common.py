"""What several operators share: shared-folder tables, folds, vectorised words of Arrow text, components."""

from __future__ import annotations

import gc
import tempfile
import threading
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text and rows that one vectorised step takes; longer texts are one step of their own.
STEP_BYTES, STEP_ROWS = 1 << 20, 1 << 15


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local master (tests) gets one below the temporary folder; a cluster is refused, as a machine's own folder would
    scatter tables over the executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to and read from the shared folder: computed once, and executors that go lose nothing of it.

    Operators `drop` the tables that their result doesn't read. Those that it reads, as it is lazy, stay until the caller has read it and
    calls `remove_tables`.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_scratch, "made", None) is not None:
        _scratch.made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes, at its end, the tables that were cut within it, but those that the function it gives was called with."""
    outer, _scratch.made, kept = getattr(_scratch, "made", None), [], []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._cut_path)
        return df

    try:
        yield keep
    finally:
        made, _scratch.made = _scratch.made, outer
        for path in made:
            if path not in kept:
                remove(spark, path)
        if outer is not None:
            outer += kept


def drop(*tables: DataFrame) -> None:
    """Removes tables that `cut` returned and nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._cut_path)


def remove_tables(spark: SparkSession) -> None:
    """Removes every table that this application's operators left: for the caller, once their results are read."""
    remove(spark, run_folder(spark))


def free_shuffles(spark: SparkSession) -> None:
    """Spark removes the files of shuffles that nothing can read any more once the driver's JVM collects their plans: asks it to, before a step that needs the disk."""
    gc.collect()
    spark._jvm.System.gc()


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; 1 (never held out) for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(1))


def fetch(df: DataFrame) -> pa.Table:
    """A result of proven size at the driver, without a pandas copy."""
    return df.toArrow()


# --- vectorised text -----------------------------------------------------------------------------


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null is the empty string."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    if not len(col) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, one row at least, and STEP_ROWS rows."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    i = 0
    while i < batch.num_rows:
        base = ends[i - 1] if i else 0
        j = min(max(i + 1, int(np.searchsorted(ends, base + most, side="right"))), i + STEP_ROWS)
        yield batch.slice(i, j - i)
        i = j


def byte_class(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Letters, digits and all bytes of non-ASCII characters.
ALNUM = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
ASCII_ALNUM = byte_class(lambda b: b < 0x80 and chr(b).isalnum())
#: All bytes but space and tab to carriage return.
VISIBLE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse mod 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 4096)
        for k, b in enumerate((BASE, BASE_INVERSE)):
            x = np.full(size, b, U64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of kept bytes inside each text, and each text's first run (n + 1)."""
    return runs(keep[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true places inside each text, and each text's first run (n + 1); a run ends where `apart` is true."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    if apart is not None:
        before[apart] = False
        after[:-1][apart[1:]] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Scripts written without spaces between words: each of their letters is a word. First and last code points.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_kinds: list[np.ndarray] = []


def character_kinds() -> np.ndarray:
    """By code point: 0 ends a word, 1 belongs to one (letters, digits, marks), 2 is one."""
    if not _kinds:
        kind = np.zeros(0x110000, np.uint8)
        for i in range(0x20000):
            kind[i] = chr(i).isalnum() or unicodedata.category(chr(i))[0] == "M"
        for lo, hi in UNSPACED:
            part = kind[lo : hi + 1]
            part[:] = 2 if lo >= 0x20000 else 2 * part
        _kinds.append(kind)
    return _kinds[0]


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 texts, and each text's first word: runs of letters, digits and marks of any script, and
    single letters of scripts that are written without spaces."""
    inside = ASCII_ALNUM[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return runs(inside, offsets)
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    a, b, c, d = (wide[lead + i] for i in range(4))
    size = 2 + (a >= 0xE0) + (a >= 0xF0)
    two, three = (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63
    four = (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63
    kind = character_kinds()[np.minimum(np.choose(size - 2, (two, three, four)), 0x10FFFF)]
    for i in range(4):
        inside[lead[size > i] + i] = kind[size > i] > 0
    apart = np.zeros(len(data) + 1, bool)
    alone = kind == 2
    apart[lead[alone]] = True
    apart[(lead + size)[alone]] = True
    return runs(inside, offsets, apart[:-1])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of byte spans (ascending starts), and of their first p bytes for each p.

    Differences of a running polynomial sum; a step at a time, so memory follows the longest span, not the text.
    """
    out = [np.empty(len(starts), U64) for _ in range(1 + len(prefixes))]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + STEP_BYTES)))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = powers(hi - lo + 1)
        sums = np.empty(hi - lo + 1, U64)
        sums[0] = 0
        np.cumsum(BYTE_VALUE[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        shift, first = down[s], sums[s]
        out[0][i:j] = mix((sums[e] - first) * shift)
        for k, p in enumerate(prefixes):
            out[k + 1][i:j] = mix((sums[np.minimum(s + p, e)] - first) * shift + U64(p))
        i = j
    return out


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive items, at each place that has them."""
    x = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        x *= U64(BASE)
        x += h[j : len(h) - k + 1 + j]
    return mix(x)


def group_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups, empty ones included."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


# --- joins with hot keys and components ------------------------------------------------------------

#: Keys that a split join may broadcast.
MOST_HOT = 10_000


def join_split(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join where a key may hold any share of left. right has one row per key and, as `weight`, at most how many rows of left the key has;
    weights add up to at most total.

    Keys of more than total / MOST_HOT rows are at most MOST_HOT, so they are broadcast and left's rows of them stay where they
    are; the others are no task's burden. left is read twice: a table.
    """
    hot = F.col(weight) > max(100, total // MOST_HOT)
    heavy = F.broadcast(right.filter(hot))
    cold = left.join(F.broadcast(right.filter(hot).select(*keys)), keys, "left_anti").join(right.filter(~hot), keys)
    return left.join(heavy, keys).unionByName(cold)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of an edge reaches.

    Alternates large stars and small stars; minima combine on the map side, nodes with many edges are joined apart, and each round
    is cut, so a node with any number of edges costs no task more than its share of them. Only counts reach the driver.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    n = e.count()
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # Large star: larger neighbours go to the smallest of the neighbourhood.
        up = join_split(both.filter("v > u"), low, ["u"], "n", 2 * n)
        large = cut(up.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct(), "large")
        # Small star: every node and its smaller neighbours go to the smallest of those.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        down = join_split(large, low, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        new = cut(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        drop(e, large)
        # Done when every node has one edge and no root has one.
        sums = new.agg(F.count("*").alias("n"), F.count_distinct("u").alias("k")).first()
        if sums.n == sums.k and new.select(F.col("v").alias("u")).distinct().join(new.select("u"), "u", "left_semi").isEmpty():
            break
        e, n = new, sums.n
    else:
        raise RuntimeError("components did not converge")
    return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# --- sums ------------------------------------------------------------------------------------------


def task_sums(rows: DataFrame, n: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """n counters that `add` fills from the batches of every task, added up.

    A task sends its counters in slices, and a task a slice adds them up, so none holds more than its slice of each and the driver gets 8 n bytes.
    """
    slices = max(1, min(partitions(rows), n >> 12))
    cuts = np.linspace(0, n, slices + 1).astype(int)

    def sent(sums: np.ndarray) -> pa.RecordBatch:
        some = [i for i in range(slices) if sums[cuts[i] : cuts[i + 1]].any()]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([sums[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())], ["slice", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n, np.int64)
        for b in batches:
            add(b, sums)
        yield sent(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n, np.int64)
        for b in batches:
            for i, x in zip(b.column("slice").to_pylist(), b.column("sums"), strict=True):
                sums[cuts[i] : cuts[i + 1]] += np.frombuffer(x.as_py(), np.int64)
        yield sent(sums)

    layout = "slice int, sums binary"
    out = np.zeros(n, np.int64)
    for r in rows.mapInArrow(run, layout).repartitionById(slices, F.col("slice")).mapInArrow(total, layout).collect():
        out[cuts[r.slice] : cuts[r.slice + 1]] += np.frombuffer(r.sums, np.int64)
    return out


# --- groups that stream ----------------------------------------------------------------------------


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First rows of the runs of equal keys, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    if table.num_rows:
        new[0] = True
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a sorted partition, with group_starts: memory is that of a batch and one group."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        at = group_starts(t, keys)
        last = int(at[-2])
        if last:
            yield t.slice(0, last).combine_chunks(), at[:-1]
        held = t.slice(last)
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield held, group_starts(held, keys)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n items reaches over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_pairs(rows: DataFrame, blocks: Column, key: str) -> DataFrame:
    """rows once for each pair of blocks (_i <= _j) that their block _block belongs to: that many blocks of their group by a hash of the key,
    so that every two rows of a group meet in one pair, and no pair is larger than two blocks."""
    out = rows.withColumn("_n", blocks.cast("int")).withColumn("_block", F.pmod(F.xxhash64(F.lit("block"), key), F.col("_n")).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return out.withColumns({"_i": F.least("_block", "_o"), "_j": F.greatest("_block", "_o")}).drop("_n", "_o")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
