"""Exact top-k by inner product: vectors in descending length, SVD-rotated partial sums, pairs dropped by Cauchy-Schwarz bounds of what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlineage.llm.common import cut, fetch, group_starts, join_split, partitions, scratch
from textlineage.llm.neighbours import matrix

K, EVERY, SCALE = 5, 50, 256
#: Queries and bytes of a block, vectors of a slice, and vectors that meet a block at once.
BLOCK, BLOCK_BYTES, SLICE, STEP = 2_048, 1 << 23, 32_768, 1_024
#: One in FIRST components is in the first partial sum; up to FEW of the pairs are looked at one by one.
FIRST, FEW = 4, 1 / 8
#: The rotation is fitted on at most so many rows and bytes, for the most frequent lengths up to LONGEST components; first bounds come from HEAD vectors.
SAMPLE, SAMPLE_BYTES, LENGTHS, LONGEST, HEAD = 16_384, 1 << 24, 8, 1_024, 1_024
#: Lengths up to which their table is broadcast.
MOST_LENGTHS = 10_000
#: Relative error that bounds allow for.
SLACK = 1e-9

LAYOUT = "d int, block long, slice long, kind int, node long, place long, bound double, size double, v array<double>"
GROUP = ["d", "block", "slice", "kind"]


def rotation(x: np.ndarray) -> np.ndarray:
    """Columns: the right singular vectors of x, the strongest first; all of them, so lengths and products stay."""
    return np.linalg.svd(x.T @ x)[0]


def turned(x: np.ndarray, turn: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first components of rotated rows, the length of the rest, and the whole length."""
    y = x if turn is None else x @ turn
    p = max(1, x.shape[1] // FIRST)
    return y[:, :p], np.sqrt(np.einsum("ij,ij->i", y[:, p:], y[:, p:])), np.sqrt(np.einsum("ij,ij->i", x, x))


def beyond_doubles(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether a product of rows, or a sum on its way, may be beyond the whole numbers of doubles. Beyond 64 bits it raises."""
    most = np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0.0) * np.einsum("ij,ij->i", y, y).max(initial=0.0))
    if most >= 2.0**63:
        raise OverflowError("inner products beyond 64 bits")
    return most >= 2.0**52


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of every row of x with every row of y, of whole numbers; sums of longs are right wherever the product is one."""
    return x.astype(np.int64) @ y.astype(np.int64).T if beyond_doubles(x, y) else (x @ y.T).astype(np.int64)


def pair_products(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    wide = beyond_doubles(x, y)
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 1 << 16):
        p, q = x[a[i : i + (1 << 16)]], y[b[i : i + (1 << 16)]]
        out[i : i + (1 << 16)] = np.einsum("ij,ij->i", p.astype(np.int64), q.astype(np.int64)) if wide else np.einsum("ij,ij->i", p, q)
    return out


class Block:
    """Queries of one task, their `most` best vectors so far (ties to the smaller place), and the score that a vector has to reach."""

    def __init__(self, x: np.ndarray, node: np.ndarray, bound: np.ndarray, turn: np.ndarray | None, most: int):
        self.x, self.node, self.bound, self.turn, self.most = x, node, bound.copy(), turn, most
        self.head, self.rest, self.size = turned(x, turn)
        self.query, self.score, self.place, self.found = (np.zeros(0, np.int64) for _ in range(4))
        self.met = self.summed = self.whole = 0  # vectors, pairs with a partial sum, pairs with a whole product

    def meet(self, y: np.ndarray, node: np.ndarray, place: np.ndarray) -> bool:
        """Compares vectors of descending length; False once neither these nor shorter ones can reach any bound."""
        head, rest, size = turned(y, self.turn)
        self.met += len(y)
        live = np.flatnonzero(self.size * size.max(initial=0.0) * (1 + SLACK) + SLACK >= self.bound)
        if not len(live) or not len(y):
            return False
        self.summed += len(live) * len(y)
        # What the rest can add is at most the product of its lengths.
        top = self.head[live] @ head.T
        top += np.outer(self.rest[live], rest)
        top += SLACK * (np.outer(self.size[live], size) + 1)
        q, c = np.nonzero(top >= self.bound[live][:, None])
        if len(q) > FEW * top.size:
            self.whole += top.size
            score = products(self.x[live], y)
            reach = self.bound[live]
            if len(y) > self.most:
                reach = np.maximum(reach, np.partition(score, len(y) - self.most, axis=1)[:, len(y) - self.most])
            q, c = np.nonzero(score >= reach[:, None])
            score = score[q, c]
        else:
            self.whole += len(q)
            score = pair_products(self.x, y, live[q], c)
            some = score >= self.bound[live[q]]
            q, c, score = q[some], c[some], score[some]
        self.add(live[q], score, place[c], node[c])
        return True

    def add(self, query: np.ndarray, score: np.ndarray, place: np.ndarray, found: np.ndarray) -> None:
        q, s, p, f = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.place, place), (self.found, found)))
        order = np.lexsort((p, -s, q))
        q = q[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        kept = order[rank < self.most]
        self.query, self.score, self.place, self.found = q[rank < self.most], s[kept], p[kept], f[kept]
        last = rank[rank < self.most] == self.most - 1
        self.bound[self.query[last]] = np.maximum(self.bound[self.query[last]], self.score[last])

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.node[self.query]), pa.array(self.score), pa.array(self.place), pa.array(self.found)], ["query", "score", "place", "node"])


# --- all vectors -----------------------------------------------------------------------------------


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(id, v, h1, h2): floor(SCALE * x) of vectors without null or non-finite components, and the 128 bits that tell them apart."""
    double = lambda x: x.cast("double") * F.lit(float(SCALE))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(double(x)) & (F.abs(double(x)) < float("inf")))
    # From 2**53 on a double is whole.
    v = F.transform("embedding", lambda x: F.when(F.abs(double(x)) < 2.0**53, F.floor(double(x)).cast("double")).otherwise(double(x)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.when(F.coalesce(good, F.lit(False)), v).alias("v")).filter("v is not null")
    return rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.reverse("v")).alias("h2"))


def different(rows: DataFrame, most: int, every: int) -> DataFrame:
    """(node, h1, h2, v, d, size, asked, ids, place): each vector once, with the `most` smallest ids of its rows, nulls last, as no others can be in a result."""
    key = Window.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last())
    few = rows.select("id", "h1", "h2").withColumn("n", F.row_number().over(key)).filter(F.col("n") <= most)
    few = few.groupBy("h1", "h2").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
    each = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.bool_or(F.coalesce(F.col("id") % every == 0, F.lit(False))).alias("asked"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return cut(each.join(few, ["h1", "h2"]).withColumns({"d": F.size("v"), "size": size, "node": F.monotonically_increasing_id(), "place": F.coalesce(F.col("ids")[0], F.lit((1 << 63) - 1))}), "topk-vectors")


def fitted(nodes: DataFrame, d: int, n: int) -> tuple[np.ndarray | None, pa.Table]:
    """The rotation of vectors of a length, from a hashed sample of bounded rows and bytes, and the longest of them."""
    own = nodes.filter(F.col("d") == d)
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(d, 1))))
    turn = None
    if 0 < d <= LONGEST:
        sample = own.select("v") if n <= most else own.filter(F.pmod(F.xxhash64(F.lit("sample"), "node"), F.lit(1 << 30)) < int(most / n * (1 << 30))).select("v")
        t = fetch(sample)
        if t.num_rows:
            turn = rotation(matrix(t["v"]) / max(1.0, np.abs(matrix(t["v"])).max()))
    return turn, fetch(own.orderBy(F.desc("size"), "place").select("node", "place", "v").limit(min(HEAD, most)))


def nearest(nodes: DataFrame, most: int) -> DataFrame:
    """(query, score, place, node): the `most` best vectors of each asked one, itself among them."""
    sizes = nodes.groupBy("d").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"))
    frequent = sizes.filter("asked > 0").orderBy(F.desc("n"), "d").limit(LENGTHS).collect()
    known = {r.d: fitted(nodes, r.d, r.n) for r in frequent}
    turns = {d: x[0] for d, x in known.items()}
    heads = {d: x[1] for d, x in known.items()}

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                mine = batch.filter(pa.array(lengths == d))
                bound = np.full(mine.num_rows, -np.inf)
                if d in heads and d:
                    h = heads[d]
                    for i in range(0, mine.num_rows, STEP):
                        p = mine.slice(i, STEP)
                        b = Block(matrix(p.column("v")), p.column("node").to_numpy(), bound[i : i + STEP], turns[d], most)
                        b.meet(matrix(h["v"]), h["node"].to_numpy(), h["place"].to_numpy())
                        bound[i : i + STEP] = b.bound
                yield pa.RecordBatch.from_arrays([*[mine.column(c) for c in ("node", "d", "size", "v")], pa.array(bound)], ["node", "d", "size", "v", "bound"])

    asked = nodes.filter("asked").select("node", "d", "size", "v").mapInArrow(first_bounds, "node long, d int, size double, v array<double>, bound double")
    asked = cut(asked, "topk-queries")
    # No query's bound is in reach of a vector that is shorter than this.
    least = asked.groupBy("d").agg(F.min(F.when(F.col("size") > 0, F.col("bound") / F.col("size") * (1 - 2 * SLACK) - SLACK).otherwise(F.lit(float("-inf")))).alias("least"), F.count("*").alias("n_asked"))
    plan = sizes.join(least, "d")
    plan = F.broadcast(plan) if plan.count() <= MOST_LENGTHS else plan
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest("d", F.lit(1))))))
    shape = {"blocks": F.ceil(F.col("n_asked") / block), "slices": F.ceil(F.col("n") / F.lit(SLICE))}
    part = lambda c, of: F.pmod(F.xxhash64(F.lit(of), "node"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    names = [f.split()[0] for f in LAYOUT.split(", ")]
    q = asked.join(plan, "d").withColumns(shape).withColumns({"block": part("blocks", "block"), "kind": F.lit(0), "place": F.lit(0).cast("long")}).withColumn("slice", every("slices"))
    c = nodes.join(plan, "d").filter("size >= least").withColumns(shape).withColumns({"slice": part("slices", "slice"), "kind": F.lit(1), "bound": F.lit(0.0)}).withColumn("block", every("blocks"))
    dealt = q.select(*names).unionByName(c.select(*names)).repartition(partitions(nodes), "d", "block", "slice").sortWithinPartitions("d", "block", "slice", "kind", F.desc("size"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block, open_ = None, [], None, False
        for batch in batches:
            t = pa.Table.from_batches([batch])
            starts = group_starts(t, GROUP)
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                p = t.slice(lo, hi - lo).combine_chunks()
                key = tuple(p[k][0].as_py() for k in GROUP[:3])
                if key != at:
                    if block is not None:
                        yield block.rows()
                    at, held, block, open_ = key, [], None, True
                if p["kind"][0].as_py() == 0:
                    held.append(p)
                    continue
                if block is None and held:
                    w = pa.concat_tables(held).combine_chunks()
                    block, held = Block(matrix(w["v"]), w["node"].to_numpy(), w["bound"].to_numpy(), turns.get(key[0]), most), []
                for i in range(0, p.num_rows if block is not None and open_ else 0, STEP):
                    y = p.slice(i, STEP)
                    open_ = block.meet(matrix(y["v"]), y["node"].to_numpy(), y["place"].to_numpy())
                    if not open_:
                        break
        if block is not None:
            yield block.rows()

    found = dealt.mapInArrow(run, "query long, score long, place long, node long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "place", "node")
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most).drop("n")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every` the k other rows with the largest inner products of
    floor(256 * x), ties to the smaller vec_id, a null one last.

    Equal vectors are compared once, and of their rows the k + 1 smallest ids stand for all, since no others can be in a result. Queries in blocks meet
    vectors in slices, each slice from its longest vector on; a task ends a slice where the product of lengths is below every bound, and looks at a pair only
    if its first rotated components and the lengths of the others can reach the bound. First bounds are those of the longest vectors, and leave out
    all that are too short before anything is dealt. The rotation comes from a bounded sample; it only orders components, so results are exact.

    Rows that are null or hold null or non-finite components take no part; vectors of different lengths don't meet; those of length 0 have products of 0. A row that
    repeats a query is another row and may be its result. A row with a null vec_id is a result but no query. Where there are fewer than k other rows
    all are given. Products beyond 64 bits raise. An empty table gives an empty table; other columns are ignored.
    """
    with scratch(vectors.sparkSession) as keep:
        rows = whole_vectors(vectors)
        nodes = different(rows, k + 1, every)
        found = nearest(nodes, k + 1).join(nodes.select("node", F.posexplode("ids").alias("n", "id")), "node")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "node", "n")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
        lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", (F.col("node") == F.col("query")).alias("same")))).alias("best"))
        asked = rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "h1", "h2")
        copies = asked.groupBy("h1", "h2").agg(F.count("*").alias("copies"))
        known = keep(cut(lists.join(nodes.select(F.col("node").alias("query"), "h1", "h2"), "query").join(copies, ["h1", "h2"]).select("h1", "h2", "copies", "best"), "topk-lists"))
    total = known.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    out = join_split(asked, known, ["h1", "h2"], "copies", total)
    own = F.array_position(F.transform("best", lambda x: x["same"] & (x["id"] == F.col("query_id"))), True)
    rest = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("_own")), 1, k)
    out = out.withColumn("_own", own).select("query_id", F.posexplode(rest).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
