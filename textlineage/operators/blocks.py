"""Pairs of documents by blocks: what meets is a block of documents of one year and a block of a later one.

A term join makes a row of each product, which a shuffle then adds up by pair: products grow faster than the corpus and are many times its size. Here only
vectors are shuffled, a row a document, once to its block as an earlier and once as a later document; blocks hold so many entries at most. The tasks of a Cartesian product of the blocks read
two of them each, so that no copy of a vector is written for those that its own meets. A task keeps the later block as inverted lists, streams the earlier one's documents past it and adds up the products of some documents at a time.
Pairs are thus whole where they are made: hits leave the task as they are, sums by document a row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlineage.functions.joins import checked_small
from textlineage.operators.weight import MOST_TERMS

#: Entries of a block of earlier and of later documents, about; products that a step adds up.
EARLIER, LATER, STEP = 4_000_000, 2_000_000, 1 << 20

Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Lists:
    """Inverted lists of a block of documents; `doc` counts them from 0."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.ids = pa.concat_arrays([r.column("id") for r in rows])
        self.n = len(self.ids)
        doc, term, w = entries(pa.RecordBatch.from_arrays([pa.concat_arrays([r.column(c) for r in rows]) for c in ("terms", "ws")], ["terms", "ws"]))
        order = np.argsort(term, kind="stable")
        self.doc, term, self.w = doc[order], term[order], w[order]
        self.terms, self.start, self.count = np.unique(term, return_index=True, return_counts=True)
        self.hi = np.maximum.reduceat(self.w, self.start) if len(term) else self.w
        self.lo = np.minimum.reduceat(self.w, self.start) if len(term) else self.w

    def find(self, term: np.ndarray) -> np.ndarray:
        """Number of each term's list, -1 without one."""
        if not len(self.terms):
            return np.full(len(term), -1)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        return np.where(self.terms[at] == term, at, -1)

    def products(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of lists, one after another: which of them, and the place of each entry."""
        n = self.count[at]
        which = np.repeat(np.arange(len(at)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n - self.start[at], n)


def entries(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, from 0, term and weight of each entry of packed rows."""
    terms = rows.column("terms")
    doc = np.repeat(np.arange(rows.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
    return doc, terms.flatten().to_numpy(zero_copy_only=False), rows.column("ws").flatten().to_numpy(zero_copy_only=False)


def added(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each key once, how often it stands and its sums."""
    order = np.argsort(key)
    key = key[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[cut], np.diff(np.append(cut, len(key))), [np.add.reduceat(v[order], cut) if len(key) else v for v in values]


def chunks(rows: pa.RecordBatch, y: Lists, most: int) -> Iterator[pa.RecordBatch]:
    """Slices with about so many products, a document at least."""
    doc, term, _ = entries(rows)
    at = y.find(term)
    n = np.bincount(doc, np.where(at >= 0, np.append(y.count, 0)[at], 0), minlength=rows.num_rows)
    ends = np.cumsum(n)
    i = 0
    while i < rows.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield rows.slice(i, j - i)
        i = j


def native(x: pa.RecordBatch, y: Lists, threshold: float) -> Found:
    """(earlier document, later document, terms, similarity) of all pairs that share a term."""
    doc, term, w = entries(x)
    at = y.find(term)
    doc, at, w = doc[at >= 0], at[at >= 0], w[at >= 0]
    which, place = y.products(at)
    key, n, (sim,) = added(doc[which] * y.n + y.doc[place], w[which] * y.w[place])
    return key // y.n, key % y.n, n, sim


def tails(doc: np.ndarray, bound: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the bounds of each document's entries up to each, in the order given, and over all of the document's."""
    by = np.lexsort((*order[::-1], doc))
    b, d = bound[by], doc[by]
    total = np.cumsum(b)
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    before = np.repeat(np.append(0.0, total)[first], np.diff(np.append(first, len(d))))
    sums = np.empty(len(b))
    sums[by] = total - before
    return sums, np.bincount(doc, bound, minlength=doc.max() + 1 if len(doc) else 0)[doc]


#: What sums of bounds may err by.
SLACK = 1e-9


def prefix(x: pa.RecordBatch, y: Lists, threshold: float) -> Found:
    """As native, of pairs that share a term of the earlier document's head: the rarer terms, without which the others, by the extremes of their lists, stay
    below the threshold."""
    doc, term, w = entries(x)
    at = y.find(term)
    doc, at, w = doc[at >= 0], at[at >= 0], w[at >= 0]
    bound = np.maximum(np.maximum(w * y.hi[at], w * y.lo[at]), 0.0)
    head = tails(doc, bound, -y.count[at], at)[0] >= threshold - SLACK * max(1.0, threshold)
    which, place = y.products(at[head])
    found = np.unique(doc[head][which] * y.n + y.doc[place])
    return verified(found, doc, at, w, y)


def verified(found: np.ndarray, doc: np.ndarray, at: np.ndarray, w: np.ndarray, y: Lists) -> Found:
    """Pairs given as sorted keys, over all terms that they share."""
    which, place = y.products(at)
    key = doc[which] * y.n + y.doc[place]
    among = np.searchsorted(found, key)
    own = found[np.minimum(among, len(found) - 1)] == key if len(found) else np.zeros(len(key), bool)
    key, n, (sim,) = added(key[own], w[which[own]] * y.w[place[own]])
    return key // y.n, key % y.n, n, sim


def bounded(x: pa.RecordBatch, y: Lists, threshold: float) -> Found:
    """The pairs that bounds leave to look at, n being the products added up; the similarity is nan where a bound ruled a pair out.

    A document's terms go from the one that can add most down; the first ones, up to the one from which on the rest stays below the threshold, meet their
    lists, and products that can't reach it with all that the other terms can add are left out. What a pair has so far and what is left decide whether it is verified.
    """
    least = threshold - SLACK * max(1.0, threshold)
    doc, term, w = entries(x)
    at = y.find(term)
    every = doc[at >= 0], at[at >= 0], w[at >= 0]
    some = every[2] != 0
    doc, at, w = (v[some] for v in every)
    bound = np.maximum(np.maximum(w * y.hi[at], w * y.lo[at]), 0.0)
    upto, total = tails(doc, bound, -bound, at)
    head = total - upto + bound >= least
    rest = np.bincount(doc, np.where(head, 0.0, bound), minlength=x.num_rows)
    doc, at, w, others = doc[head], at[head], w[head], (total - bound)[head]
    which, place = y.products(at)
    p = w[which] * y.w[place]
    meets = (p + others[which] >= least) & (y.w[place] != 0)
    key, n, (has,) = added(doc[which[meets]] * y.n + y.doc[place[meets]], p[meets])
    stays = has + rest[key // y.n] >= least
    a, b, more, sim = verified(key[stays], *every, y)
    out = key[~stays]
    return np.append(a, out // y.n), np.append(b, out % y.n), np.append(more + n[stays], n[~stays]), np.append(sim, np.full(len(out), np.nan))


STRATEGIES: dict[str, Callable[[pa.RecordBatch, Lists, float], Found]] = {"native": native, "prefix": prefix, "bounded": bounded}


def written(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema) as out:
        out.write_table(pa.Table.from_batches(rows).combine_chunks())
    return sink.getvalue().to_pybytes()


def read(value: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks().to_batches()[0]


def in_blocks(rows: DataFrame, cut: list[tuple], by: list[str], name: str, most: int | None) -> DataFrame:
    """(by..., part, rows): the documents of each block, or some of them with about `most` entries, as one value. A partition has one block, and is made of what is shuffled once, however often it is read.

    cut: values of `by` and the number of their blocks; others than these go.
    """
    spark, first, parts = rows.sparkSession, 0, []
    for *values, n in cut:
        parts.append((*values, first, n))
        first += n
    kinds = ", ".join(f"{c} int" for c in by)
    known = F.broadcast(spark.createDataFrame(parts, f"{kinds}, _first int, _n int"))
    columns = [c for c in rows.columns if c not in by]
    dealt = rows.join(known, by).withColumn(name, (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_n"))).cast("int")).drop("_first", "_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in key], pa.array([written(held)], pa.binary())], [*by, name, f"rows_{name}"])

        for b in batches:
            keys = [b.column(c).to_numpy() for c in (*by, name)]
            cuts = np.flatnonzero(keys[-1][1:] != keys[-1][:-1]) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if i == j:
                    continue
                own = tuple(k[i] for k in keys)
                if held and own != key:
                    yield out()
                    held, size = [], 0
                key = own
                held.append(b.slice(i, j - i).select(columns))
                size += len(held[-1].column("terms").flatten())
                if most is not None and size >= most:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return dealt.repartitionById(first, F.col(name)).mapInArrow(run, f"{kinds}, {name} int, rows_{name} binary")


def met(vectors: DataFrame, later: DataFrame, window: int, kernel: Callable, schema: str, year: int | None = None, earlier: int | None = None, most: int | None = None) -> DataFrame:
    """What a kernel yields of every block of documents and every later block within the window; with a year, of pairs of years with it alone.

    vectors: packed earlier documents (id, yr, terms, ws, others..., and yr_y where they differ by the later year); later: packed (id, yr, terms, ws). The entries of each year are counted first, in a job of its own.
    kernel(lists or None, rows or None): called with some rows at a time, and once at a block's end without.
    """
    earlier, most = earlier or EARLIER, most or LATER
    spark = later.sparkSession
    sizes = {r.yr: r.n for r in later.groupBy("yr").agg(F.sum(F.size("terms")).alias("n")).collect()}  # a row a year
    years = [(a, b) for a in sorted(sizes) for b in sorted(sizes) if a < b <= a + window and (year is None or year in (a, b))]
    if not years:
        return spark.createDataFrame([], schema)
    blocks = lambda keys, size: [(*k, max(1, -(-sizes[k[0]] // size))) for k in sorted(set(keys))]
    if "yr_y" in vectors.columns:
        x = in_blocks(vectors.withColumnRenamed("yr", "yr_x"), blocks(years, earlier), ["yr_x", "yr_y"], "bx", STEP).withColumnRenamed("yr_y", "yr_of")
        near = F.col("yr_of") == F.col("yr_y")
    else:
        x = in_blocks(vectors.withColumnRenamed("yr", "yr_x"), blocks([(a,) for a, _ in years], earlier), ["yr_x"], "bx", STEP)
        near = (F.col("yr_x") < F.col("yr_y")) & (F.col("yr_y") <= F.col("yr_x") + window)
    if year is not None:
        near &= (F.col("yr_x") == year) | (F.col("yr_y") == year)
    y = in_blocks(later.withColumnRenamed("yr", "yr_y"), blocks([(b,) for _, b in years], most), ["yr_y"], "by", None)
    both = x.hint("shuffle_replicate_nl").join(y, near).select("yr_x", "yr_y", "by", "rows_bx", "rows_by")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists, state = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                yr_x, yr_y, by = (batch.column(c)[i].as_py() for c in ("yr_x", "yr_y", "by"))
                if (yr_x, by) != at:
                    if lists is not None:
                        yield from kernel(lists, None, state)
                    if at is None or by != at[1]:
                        lists = Lists([read(batch.column("rows_by")[i]).select(["id", "terms", "ws"])])
                    at, state = (yr_x, by), {"years": (yr_x, yr_y)}
                for some in chunks(read(batch.column("rows_bx")[i]), lists, STEP):
                    yield from kernel(lists, some, state)
        if lists is not None:
            yield from kernel(lists, None, state)

    return both.mapInArrow(run, schema)


def packed(vectors: DataFrame) -> DataFrame:
    """(id, yr, terms, ws): a row a document, of entries (id, yr, term_id, w), or of rows that are so already."""
    if "ws" in vectors.columns:
        return vectors.select("id", "yr", "terms", "ws")
    return vectors.groupBy("id", "yr").agg(F.collect_list("term_id").alias("terms"), F.collect_list("w").alias("ws"))


def batch(schema: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema)


def similarity(vectors: DataFrame, window: int, threshold: float, strategy: str = "native", hits: bool = False, **sizes) -> DataFrame:
    """(yr_x, yr_y, id_x, id_y, n_terms, sim) of the pairs that the strategy looks at, or of hits alone; sim is null where a bound ruled a pair out."""
    look = STRATEGIES[strategy]

    def kernel(y: Lists, rows: pa.RecordBatch | None, state: dict) -> Iterator[pa.RecordBatch]:
        if rows is None:
            return
        a, b, n, sim = look(rows, y, threshold)
        if hits:
            a, b, n, sim = (v[sim >= threshold] for v in (a, b, n, sim))
        years = [np.full(len(a), v, np.int32) for v in state["years"]]
        yield batch(["yr_x", "yr_y", "id_x", "id_y", "n_terms", "sim"], *years, rows.column("id").take(pa.array(a)), y.ids.take(pa.array(b)), n.astype(np.int64), pa.array(sim, mask=np.isnan(sim)))

    docs = packed(vectors)
    return met(docs, docs, window, kernel, "yr_x int, yr_y int, id_x string, id_y string, n_terms long, sim double", **sizes)


def sides(vectors: DataFrame, window: int, threshold: float, strategy: str = "native", **sizes) -> DataFrame:
    """pairs.pair_sides of `similarity`, added up where pairs are made: a row a document and block leaves a task."""
    look = STRATEGIES[strategy]
    names = ["yr_x", "yr_y", "side", "id", "contrib", "hits", "touched", "ops"]

    def out(state: dict, side: str, ids: pa.Array, sums: list[np.ndarray]) -> pa.RecordBatch:
        at = np.flatnonzero(sums[2])
        years = [np.full(len(at), v, np.int32) for v in state["years"]]
        return batch(names, *years, pa.array([side] * len(at), pa.string()), ids.take(pa.array(at)), sums[0][at].astype(np.float64), *[v[at].astype(np.int64) for v in sums[1:]])

    def kernel(y: Lists, rows: pa.RecordBatch | None, state: dict) -> Iterator[pa.RecordBatch]:
        own = state.setdefault("sums", [np.zeros(y.n) for _ in range(4)])
        if rows is None:
            yield out(state, "y", y.ids, own)
            return
        a, b, n, sim = look(rows, y, threshold)
        hit = sim >= threshold
        values = [np.where(hit, sim, 0.0), hit.astype(np.float64), np.ones(len(a)), n.astype(np.float64)]
        for total, v in zip(own, values, strict=True):
            total += np.bincount(b, v, minlength=y.n)
        yield out(state, "x", rows.column("id"), [np.bincount(a, v, minlength=rows.num_rows) for v in values])

    docs = packed(vectors)
    found = met(docs, docs, window, kernel, "yr_x int, yr_y int, side string, id string, contrib double, hits long, touched long, ops long", **sizes)
    return found.groupBy("yr_x", "yr_y", "side", "id").agg(*[F.sum(c).alias(c) for c in names[4:]])


def running(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the values of each group up to each, added up in order and in the group alone, so that groups before leave no error."""
    out = values.copy()
    for j in range(1, int(size.max(initial=0))):
        at = first[size > j] + j
        out[at] += out[at - 1]
    return out


#: After so many terms it is said what is left to add.
LEFT_AFTER = (1, 3, 5, 10)


def bounds(vectors: DataFrame, window: int, threshold: float, **sizes) -> DataFrame:
    """(yr_x, yr_y, id, remain_init, remain_k1, ..., touched, dead): of each document of the earlier year what its terms can add to a similarity at first
    and after some of them (0 where there are fewer), its candidates, and those that the bound rules out.

    A term can add its weight times the later year's largest of the term; terms go from the one that can add most down, ties by term. A candidate is ruled out if,
    after some term from its first shared one on, what it has and what is left are below the threshold. Documents take the largest weights of their terms,
    one a later year of the window, to the blocks; no product leaves a task.
    """
    top = vectors.groupBy("term_id", "yr").agg(F.max("w").alias("m"))
    top = top.groupBy("term_id").agg(F.map_from_entries(F.collect_list(F.struct("yr", "m"))).alias("m"))
    near = F.map_filter("m", lambda y, _: y.between(F.col("yr") + 1, F.col("yr") + window))
    x = vectors.join(checked_small(top, MOST_TERMS), "term_id").select("id", "yr", F.struct("term_id", "w", near.alias("m")).alias("e"))
    x = x.groupBy("id", "yr").agg(F.collect_list("e").alias("e")).withColumn("yr_y", F.explode(F.sequence(F.col("yr") + 1, F.col("yr") + window)))
    tops = F.transform("e", lambda e: F.coalesce(F.try_element_at(e["m"], F.col("yr_y")), F.lit(0.0)))
    x = x.select("id", "yr", "yr_y", F.col("e.term_id").alias("terms"), F.col("e.w").alias("ws"), tops.alias("tops"))
    names = ["yr_x", "yr_y", "id", "remain_init", *[f"remain_k{k}" for k in LEFT_AFTER], "touched", "dead"]

    def kernel(y: Lists, rows: pa.RecordBatch | None, state: dict) -> Iterator[pa.RecordBatch]:
        if rows is None:
            return
        doc, term, w = entries(rows)
        bound = np.round(w * rows.column("tops").flatten().to_numpy(zero_copy_only=False), 12)
        by = np.lexsort((term, -bound, doc))
        term, w, bound = term[by], w[by], bound[by]
        n = np.bincount(doc, minlength=rows.num_rows)
        first = np.cumsum(n) - n
        k = np.arange(len(doc)) - first[doc]
        upto = running(bound, first, n)
        total = upto[first + n - 1]
        left = np.where(k == n[doc] - 1, 0.0, np.round(total[doc] - upto, 9))
        # What is left falls while bounds are positive, so it is above 0 for the first terms only.
        above = np.bincount(doc, left > 0, minlength=rows.num_rows).astype(np.int64)
        at = y.find(term)
        met = np.flatnonzero(at >= 0)
        which, place = y.products(at[met])
        key = doc[met[which]] * y.n + y.doc[place]
        order = np.argsort(key, kind="stable")
        key, entry, p = key[order], met[which[order]], w[met[which[order]]] * y.w[place[order]]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        acc = running(p, new, np.diff(np.append(new, len(key))))
        # Between two shared terms the bound is least just before the second, while anything is left.
        until = n[doc[entry]] - 1
        until[:-1] = np.where(key[1:] == key[:-1], k[entry[1:]] - 1, until[:-1])
        until = np.minimum(until, above[doc[entry]] - 1)
        out = (until >= k[entry]) & (np.round(acc + left[first[doc[entry]] + np.maximum(until, 0)], 9) < threshold)
        pair = key[new] // max(1, y.n)
        dead = np.logical_or.reduceat(out, new) if len(new) else out
        after = [np.where(n >= i, left[first + np.minimum(n, i) - 1], 0.0) for i in LEFT_AFTER]
        sums = [np.bincount(pair, v, minlength=rows.num_rows).astype(np.int64) for v in (np.ones(len(pair)), dead)]
        yield batch(names, *[np.full(rows.num_rows, v, np.int32) for v in state["years"]], rows.column("id"), total, *after, *sums)

    schema = "yr_x int, yr_y int, id string, remain_init double, " + ", ".join(f"remain_k{k} double" for k in LEFT_AFTER) + ", touched long, dead long"
    found = met(x, packed(vectors), window, kernel, schema, **sizes)
    return found.groupBy("yr_x", "yr_y", "id").agg(*[F.max(c).alias(c) for c in names[3:-2]], F.sum("touched").alias("touched"), F.sum("dead").alias("dead"))
