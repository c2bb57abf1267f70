"""Click throttling: a token bucket for each client over a stream of batches with late rows, on a calendar queue of event hours."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textlineage.llm.common import partitions, remove, run_folder

HOUR = 3_600_000_000
#: Microseconds that a click takes, and how many clicks a full credit admits.
COST, BURST = 900_000_000, 5
#: Batches, hours that clicks are waited for, and the share of clicks (1 in DELAYED, by crc32 of their id) that come one batch later.
BATCHES, WAIT_HOURS, DELAYED = 8, 168, 7
#: Rows and clients of a state key on average.
BUCKET_ROWS, BUCKET_CLIENTS = 150_000, 4_096
#: Rows that a key holds beside its state, and rows of a list that it gives.
HELD, GIVEN = 50_000, 8_192

#: Many small stores: no space taken ahead for each, those of an ended start soon let go, changes written instead of whole stores.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    "spark.sql.session.timeZone": "UTC",
}

FED = "bucket int, hour long, click_id long, ts long, client_id long"
PACKED = "bucket int, hour long, ids array<long>, ts array<long>, clients array<long>"
SETTLED = "ids array<long>, outcomes array<string>, batches array<int>, credits array<long>, starts array<long>, ends array<long>"
RESULT = "click_id long, outcome string, batch int, credit_after long, penalty_start_us long, penalty_end_us long"


def micros(name: str, kind: T.DataType) -> Column:
    """Epoch microseconds of a timestamp; one without a zone is UTC, whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")
    return F.unix_micros(name)


def floored(x: Column, n: int) -> Column:
    """x / n rounded down, in whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


class Throttle(StatefulProcessor):
    """One tick of the clients of a bucket: its rows wait in a calendar queue, event hour to click list; hours that are complete are drained in
    order, the hour that the watermark falls into is split, and what is drained is sorted and settled.

    No hour before the watermark's is in the queue after a tick. Memory is that of an hour of the bucket, its clients' credits and HELD rows.
    """

    def __init__(self, batch: int, watermark: int | None, final: bool):
        self.batch, self.watermark, self.final = batch, watermark, final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getMapState("queue", "hour long", "ids array<long>, ts array<long>, clients array<long>")
        self.ledger = handle.getValueState("ledger", "clients array<long>, credits array<long>, settled array<long>, penalties array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, tuple[list, list, list]] = {}
        held = 0
        late: list[int | None] = []
        w = self.watermark
        for r in rows:
            if not r.ids:  # a tick without clicks
                continue
            lists = new.setdefault(r.hour, ([], [], []))
            if w is not None and r.hour * HOUR < w:
                for i, t, c in zip(r.ids, r.ts, r.clients, strict=True):
                    if t < w:
                        late.append(i)
                    else:
                        for into, x in zip(lists, (i, t, c), strict=True):
                            into.append(x)
            else:
                for into, x in zip(lists, (r.ids, r.ts, r.clients), strict=True):
                    into += x
            held += len(r.ids)
            if held >= HELD:
                self.wait(new)
                new, held = {}, 0
            while len(late) >= GIVEN:
                yield self.given([(i, "late", None, None, None) for i in late[:GIVEN]])
                late = late[GIVEN:]
        self.wait(new)
        if late:
            yield self.given([(i, "late", None, None, None) for i in late])
        yield from self.settle()

    def wait(self, new: dict[int, tuple[list, list, list]]) -> None:
        for hour, (ids, ts, clients) in new.items():
            if ids:
                old = self.queue.getValue((hour,))
                self.queue.updateValue((hour,), (list(old[0]) + ids, list(old[1]) + ts, list(old[2]) + clients) if old else (ids, ts, clients))

    def settle(self) -> Iterator[Row]:
        w = self.watermark
        if not self.final and w is None:
            return
        due = sorted(h for (h,) in self.queue.keys() if self.final or h * HOUR < w)
        if not due:
            return
        known = self.ledger.get()
        state = {c: (k, t, p) for c, k, t, p in zip(*known, strict=True)} if known else {}
        out: list[tuple] = []
        for hour in due:
            rows = list(zip(*self.queue.getValue((hour,)), strict=True))
            if not self.final and (hour + 1) * HOUR > w:  # the hour of the watermark
                rest = [r for r in rows if r[1] >= w]
                rows = [r for r in rows if r[1] < w]
            else:
                rest = []
            if rest:
                self.queue.updateValue((hour,), tuple(map(list, zip(*rest, strict=True))))
            else:
                self.queue.removeKey((hour,))
            rows.sort(key=lambda r: (r[1], r[0] is not None, r[0] or 0))
            for i, t, c in rows:
                credit, last, penalty = state.get(c, (BURST * COST, t, None))
                credit = min(BURST * COST, credit + t - last)
                if credit >= COST:
                    credit -= COST
                    state[c] = credit, t, None
                    out.append((i, "admitted", credit, None, None))
                else:
                    penalty = t if penalty is None else penalty
                    state[c] = credit, t, penalty
                    out.append((i, "throttled", credit, penalty, t + COST - credit))
            while len(out) >= GIVEN:
                yield self.given(out[:GIVEN])
                out = out[GIVEN:]
        self.ledger.update((list(state), *map(list, zip(*state.values(), strict=True))))
        if out:
            yield self.given(out)

    def given(self, rows: list[tuple]) -> Row:
        ids, outcomes, credits, starts, ends = map(list, zip(*rows, strict=True))
        return Row(ids=ids, outcomes=outcomes, batches=[self.batch] * len(ids), credits=credits, starts=starts, ends=ends)

    def close(self) -> None:
        pass


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a run of equal buckets and hours, its clicks as lists; rows without an hour are ticks."""
    for b in batches:
        if not b.num_rows:
            continue
        hour = b.column("hour").fill_null(np.iinfo(np.int64).min).to_numpy()
        bucket = b.column("bucket").to_numpy()
        at = np.flatnonzero(np.concatenate([[True], (hour[1:] != hour[:-1]) | (bucket[1:] != bucket[:-1])]))
        tick = hour[at] == np.iinfo(np.int64).min
        ends = pa.array(np.append(at, b.num_rows).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, b.column(c)) for c in ("click_id", "ts", "client_id")]
        empty = pa.array([[]] * len(at), pa.list_(pa.int64()))
        lists = [pc.if_else(pa.array(tick), empty, x) for x in lists] if tick.any() else lists
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(hour[at]), *lists], ["bucket", "hour", "ids", "ts", "clients"])


def staged(clicks: DataFrame, path: str) -> tuple[list[int | None], int]:
    """Writes the clicks, equal rows once, to a folder a batch below `path`, with a tick for each bucket; the watermark of each batch and the number
    of buckets.

    Rows are dealt by bucket and event hour, and made unique where they land. Only the bounds of the hours, counts and a maximum a batch reach the driver.
    """
    spark = clicks.sparkSession
    at = {c: i for i, c in enumerate(clicks.columns)}
    kinds = [f.dataType for f in clicks.schema.fields]
    rows = clicks.toDF(*[f"c{i}" for i in range(len(kinds))])  # names of other columns clash with none of these
    col = lambda name: f"c{at[name]}"
    rows = rows.filter(F.col(col("ts")).isNotNull() & F.col(col("client_id")).isNotNull())
    time = micros(col("ts"), kinds[at["ts"]])
    came = floored(micros(col("arrived_at"), kinds[at["arrived_at"]]), HOUR)
    known = rows.select(F.min(came).alias("lo"), F.max(came).alias("hi"), F.count("*").alias("n"), F.approx_count_distinct(col("client_id")).alias("clients")).first()
    lo, hi = known.lo or 0, known.hi or 0
    buckets = max(1, -(-known.n // BUCKET_ROWS), -(-known.clients // BUCKET_CLIENTS))
    late = F.coalesce((F.crc32(F.col(col("click_id")).cast("string").cast("binary")) % DELAYED == 0).cast("int"), F.lit(0))
    of = F.coalesce(floored((came - lo) * BATCHES, hi - lo + 1), F.lit(0))
    rows = rows.withColumns({"ts": time, "batch": F.least(F.lit(BATCHES - 1), of + late).cast("int")})
    top = {r.batch: r.top for r in rows.groupBy("batch").agg(F.max("ts").alias("top")).collect()}
    marks: list[int | None] = []
    for b in range(BATCHES):
        before = [top[i] for i in range(b) if i in top]
        marks.append(max(before) - WAIT_HOURS * HOUR if before else None)
    rows = rows.withColumns({"hour": floored(F.col("ts"), HOUR), "bucket": F.pmod(F.xxhash64(col("client_id")), F.lit(buckets)).cast("int")})
    once = rows.repartition("bucket", "hour").distinct()
    fed = once.select("batch", "bucket", "hour", F.col(col("click_id")).cast("long").alias("click_id"), "ts", F.col(col("client_id")).cast("long").alias("client_id"))
    ticks = spark.range(buckets * BATCHES).select((F.col("id") % BATCHES).cast("int").alias("batch"), F.floor(F.col("id") / BATCHES).cast("int").alias("bucket"), *[F.lit(None).cast("long").alias(c) for c in ("hour", "click_id", "ts", "client_id")])
    fed.sortWithinPartitions("batch", "bucket", "hour").unionByName(ticks.sortWithinPartitions("batch")).write.partitionBy("batch").parquet(path)
    return marks, buckets


def throttle(clicks: DataFrame) -> DataFrame:
    """One row per click: click_id, outcome (admitted, throttled, late), batch, credit_after, penalty_start_us, penalty_end_us.

    The clicks are written by batch below the shared folder and fed, batch by batch, to a streaming query that is started anew for each on one
    checkpoint in a new folder: row-based transformWithState, keyed by buckets of clients, whose MapState is the calendar queue. A tick row a bucket goes
    with each batch, so that those without clicks settle too. Rows are packed by bucket and event hour before they are dealt, so state is read
    and written by the hour, not by the click. Of a client all clicks pass one key, in order, as its credit needs; an hour at a time is in memory.

    Equal rows count once, rows without ts or client_id not at all. A null click_id is not delayed and settles first among equal ts; a null arrived_at
    counts as the first hour. Equal ts and click_ids in unlike rows settle in any order, which the result doesn't show. An empty table
    passes all batches and gives an empty table. Other columns only tell rows apart.
    """
    spark = clicks.sparkSession
    base = f"{run_folder(spark)}/throttle-{uuid.uuid4().hex}"
    marks, buckets = staged(clicks, f"{base}/staged")
    own = spark.newSession()  # the state store is this query's setting, not the caller's
    for k, v in STORE.items():
        own.conf.set(k, v)
    own.conf.set("spark.sql.shuffle.partitions", str(max(1, min(buckets, partitions(clicks)))))
    for b, w in enumerate(marks):
        move(spark, f"{base}/staged/batch={b}", f"{base}/fed/{b}")
        tick(own, base, Throttle(b, w, b == BATCHES - 1))
    for part in ("staged", "fed", "state"):
        remove(spark, f"{base}/{part}")
    return spark.read.schema(RESULT).parquet(f"{base}/settled")


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames a folder of the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(new).getParent())
    if not fs.rename(path(old), path(new)):
        raise OSError(f"can't rename {old}")


def tick(spark: SparkSession, base: str, processor: Throttle) -> None:
    """Feeds what came since the last start and waits for the end."""
    fed = spark.readStream.schema(FED).parquet(f"{base}/fed/*")
    out = fed.mapInArrow(pack, PACKED).groupBy("bucket").transformWithState(processor, SETTLED, "append", "none")
    flat = out.select(F.inline(F.arrays_zip("ids", "outcomes", "batches", "credits", "starts", "ends"))).toDF(*T.StructType.fromDDL(RESULT).names)
    flat.writeStream.format("parquet").option("path", f"{base}/settled").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
