"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 1 << 60


def position(*parts: Column) -> Column:
    """Place on the ring, 0 to 2**60 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 4)


def ring(spark, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, ascending: shards * vnodes rows, a parameter's size."""
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("v"))
    rows = nodes.select(position(F.lit("node"), "shard", "v").alias("at"), "shard").collect()
    return sorted({at: s for at, s in sorted(((r["at"], r["shard"]) for r in rows), reverse=True)}.items())


def fill(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, from rank, to rank, shard): keys of an arc in rank order to its owner, then clockwise past full shards.

    Arcs are taken once around; each first fills its own owner, what remains moves on to the next arc's owner.
    Only counts per arc enter, so the work is that of the ring, not of the keys.
    """
    room, arcs = list(capacity), len(counts)
    out: list[tuple[int, int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []  # (arc, from, to) of keys at this node that no earlier shard took
    for i in range(arcs):  # the owners first, so that a key moves only if its own shard is full
        take = min(counts[i], room[owners[i]])
        if take:
            out.append((i, 0, take, owners[i]))
            room[owners[i]] -= take
        if take < counts[i]:
            waiting.append((i, take, counts[i]))
    for i, lo, hi in waiting:
        j = i
        while lo < hi:
            j += 1
            if j > i + arcs:
                raise ValueError("the shards' capacity is less than the keys")
            s = owners[j % arcs]
            if take := min(hi - lo, room[s]):
                out.append((i, lo, lo + take, s))
                room[s] -= take
                lo += take
    return out


def assign(keys: DataFrame, key: str, shards: int = 8, vnodes: int = 256, slices: int = 8) -> DataFrame:
    """keys with shard (0 to shards - 1) and slot (0 to the shard's rows - 1): counts of shards differ by one at most.

    Every key has a place on the ring by the hash of `key` and belongs to the next virtual node clockwise.
    A shard takes floor(n / shards) keys, the first n % shards one more; keys past that go on clockwise. Rows are
    ranked within slices of arcs (place order), so a task ranks about n / (shards * vnodes * slices) rows. Rows
    that repeat a key, and rows of a null key, stand at one place and are told apart by the other columns.
    Extra columns stay; names that begin with `_` are reserved. An empty table gives an empty table.
    """
    spark = keys.sparkSession
    nodes = ring(spark, shards, vnodes)
    # Equal slices of the whole ring and the nodes' places cut it into segments that lie in one arc each.
    step = RING // (len(nodes) * slices)
    at = F.when(F.col(key).isNull(), position(F.lit("null"), *[F.col(c).cast("string") for c in keys.columns if c != key])).otherwise(position(F.lit("key"), F.col(key)))
    # The arc of a place: a lookup by the slice of the ring, then a comparison with the few nodes in it.
    per_cell: dict[int, list[int]] = {}
    for i, (p, _) in enumerate(nodes):
        per_cell.setdefault(min(p // step, RING // step), []).append(i)
    cells, nxt = [], 0
    for c in range(RING // step + 1):
        own = per_cell.get(c, [])
        cells.append((c, nxt % len(nodes), [nodes[i][0] for i in own]))
        nxt += len(own)
    cell_table = spark.createDataFrame(cells, "_cell long, _first int, _ends array<long>")
    places = keys.withColumn("_at", at).withColumn("_cell", F.floor(F.col("_at") / F.lit(step)).cast("long"))
    # A node's place belongs to it: the first node at or after the key.
    placed = places.join(F.broadcast(cell_table), "_cell").withColumn("_arc", F.expr(f"cast((_first + size(filter(_ends, e -> e < _at))) % {len(nodes)} as int)"))
    placed = placed.drop("_first", "_ends")
    counts = placed.groupBy("_arc", "_cell").agg(F.count("*").alias("n")).collect()  # at most nodes * (slices + 1) rows
    by_arc: dict[int, list[tuple[int, int, int]]] = {}
    for r in counts:
        # In an arc that wraps around, cells past the last node come first.
        end = nodes[r["_arc"]][0]
        turn = 1 if r["_cell"] * step <= end else 0
        by_arc.setdefault(r["_arc"], []).append((turn, r["_cell"], r["n"]))
    arc_counts, before = [0] * len(nodes), {}
    for a, found in by_arc.items():
        for _, c, n in sorted(found):
            before[a, c] = arc_counts[a]
            arc_counts[a] += n
    total = sum(arc_counts)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    used = [0] * shards
    for a, lo, hi, s in fill(arc_counts, [s for _, s in nodes], capacity):
        spans.setdefault(a, []).append((lo, hi, s, used[s]))
        used[s] += hi - lo
    plan = [(a, c, n, sorted(spans[a])) for (a, c), n in before.items()]
    plan_table = spark.createDataFrame(plan, "_arc int, _cell long, _before long, _spans array<struct<lo: long, hi: long, s: int, base: long>>")
    others = [F.col(c).cast("string") for c in keys.columns if c != key]
    in_cell = F.row_number().over(Window.partitionBy("_arc", "_cell").orderBy("_at", F.col(key), *others)) - 1
    ranked = placed.withColumn("_rn", in_cell).join(F.broadcast(plan_table), ["_arc", "_cell"], "left").withColumn("_rank", F.col("_before") + F.col("_rn"))
    # The span that holds the rank (a few per arc): its shard, and the place in it.
    span = F.filter("_spans", lambda x: (x["lo"] <= F.col("_rank")) & (F.col("_rank") < x["hi"]))[0]
    return ranked.withColumn("_span", span).withColumn("shard", F.col("_span.s")).withColumn("slot", F.col("_span.base") + F.col("_rank") - F.col("_span.lo")).drop("_at", "_cell", "_arc", "_rn", "_before", "_spans", "_rank", "_span")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Digest of documents (doc_id, size, text_crc32) with law, shard, slot and grown_shard.

    A null text has no bytes: size 1, crc32 0; a text of any length is one key's. Rows that repeat a doc_id stand at one place, and those equal in size and
    text too are interchangeable; a null doc_id has a place by the text. An empty table gives an empty table; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign(rows, "doc_id", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
