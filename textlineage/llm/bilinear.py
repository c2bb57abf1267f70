"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlineage.llm.common import BASE, LOWER, U64, VISIBLE, cut, drop, fetch, fold, free_shuffles, mix, partitions, span_hashes, steps, task_sums, text_buffers, word_bounds

#: Words that the first fit tells apart, classes by their ends of words without an embedding, and words whose counts every task holds.
FREQUENT, RARE, HEAD = 1_000, 96, 1 << 19
SMOOTH = 0.1
#: Words have an embedding from sqrt(tokens) / SPARSE occurrences on, 2 at least: by Zipf's law their number goes with the root of
#: the corpus, so their exact normalisers, a square of it, cost as much a token at every size.
SPARSE = 120
#: Draws of noise per pair; steps and rate of the fit of all words, and how strongly a word keeps to the class it begins with.
NOISE, STEPS, RATE, KEEP = 20, 10, 0.05, 3.0
#: Every context of two words has direct weights, which a pull of DIRECT occurrences keeps to the bilinear model; tokens for each bucket of contexts,
#: bits of a context's hash (at 30 GB one in some 20 million contexts shares its own).
DIRECT, MET, BITS = 4.0, 2_000_000, 56
#: The most frequent classes of a noise set, which are taken exactly, and draws that stand for the others.
EXACT, DRAWS = 1_000, 1_000


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and rare class of each word of the texts, and each text's first word (n + 1)."""
    data, offsets = text_buffers(batch.column("text"))
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, VISIBLE)
    last = data[ends - 1].astype(U64) if len(ends) else np.zeros(0, U64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(U64) if len(ends) else last
    return span_hashes(data, starts, ends)[0], (mix((before << U64(8)) | last) % U64(RARE)).astype(np.int64), first


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, rare, c) of every distinct word of the texts. Tasks add up what they read before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        known_h, known_r = [np.zeros(0, U64)], [np.zeros(0, np.int64)]

        def out() -> pa.RecordBatch:
            u, c = added(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(rares(u)), pa.array(c)], ["hash", "rare", "c"])

        def rares(u: np.ndarray) -> np.ndarray:
            h, r = np.concatenate(known_h), np.concatenate(known_r)
            order = np.argsort(h, kind="stable")
            return r[order][np.searchsorted(h[order], u)]

        for batch in batches:
            for b in steps(batch, "text", 4 << 20):
                h, r, _ = tokens(b)
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                keys.append(u)
                counts.append(n)
                known_h.append(u)
                known_r.append(r[at])
                held += len(u)
                if held > 2_000_000:
                    yield out()
                    keys, counts, held, known_h, known_r = [], [], 0, [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "hash long, rare long, c long").groupBy("hash").agg(F.first("rare").alias("rare"), F.sum("c").alias("c"))


@dataclass
class Model:
    """Classes are: 0 the end, then the embedded words, then the rare classes.

    The score of a class after a class is context[before] . [result[class], 1] - norm[before], in natural logarithms: the last column
    of context is 1 and that of result its bias. norm is the logarithm of the normaliser over all classes. rare_norm is log10 of
    the normaliser of the words in each rare class, one unseen word included.
    """

    frequent: np.ndarray
    head: np.ndarray
    head_counts: np.ndarray
    context: np.ndarray
    result: np.ndarray
    norm: np.ndarray
    rare_norm: np.ndarray
    end_count: int
    total: int
    distinct: int

    def classes(self, h: np.ndarray, rare: np.ndarray) -> np.ndarray:
        return classes_of(self.frequent, h, rare)

    def after(self, before: np.ndarray, current: np.ndarray) -> np.ndarray:
        """log10 of the probability of each class after the class before it."""
        out = np.empty(len(before))
        for i in range(0, len(before), 1 << 12):
            a, b = before[i : i + (1 << 12)], current[i : i + (1 << 12)]
            out[i : i + (1 << 12)] = np.einsum("ij,ij->i", self.context.take(a, axis=0), self.result.take(b, axis=0)) - self.norm[a]
        return out / np.log(10)

    @property
    def table(self) -> np.ndarray:
        """log10 of the probabilities of every class (column) after every class (row): for small models."""
        return ((self.context @ self.result.T - self.norm[:, None]) / np.log(10)).astype(np.float32)


def classes_of(frequent: np.ndarray, h: np.ndarray, rare: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return 1 + rare
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return np.where(frequent[at] == h, 1 + at, 1 + len(frequent) + rare)


def transitions(cls: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class before and class of every token, the end after each text included (and before it: a text begins after an end)."""
    n = np.diff(first)
    stops = first[1:] + np.arange(len(n))  # places of the ends once they stand in the sequence
    current = np.zeros(len(cls) + len(n), np.int64)
    inner = np.ones(len(current), bool)
    inner[stops] = False
    current[inner] = cls
    before = np.concatenate([[0], current[:-1]])
    return before, current


BLOCKS = "bucket int, cells binary, n binary"


def blocks(cells: np.ndarray, n: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Cells, as differences, and their numbers as one row of two byte strings a bucket: small to shuffle, and no row each for the JVM."""
    order = np.argsort(bucket, kind="stable")
    cells, n, bucket = cells[order], n[order], bucket[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([np.diff(cells[i:j], prepend=0).tobytes() for i, j in spans], pa.binary()), pa.array([n[i:j].tobytes() for i, j in spans], pa.binary())], ["bucket", "cells", "n"]
    )


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for c, n in zip(b.column("cells"), b.column("n"), strict=True):
            yield np.cumsum(np.frombuffer(c.as_py(), np.int64)), np.frombuffer(n.as_py(), np.int64)


#: Tokens for each bucket of pairs.
BUCKET = 250_000


def pair_counts(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """How often each class col stands after the class row in all the texts, as blocks of cells row * classes + col, by row mod buckets.

    Tasks add up what they read before the shuffle and what they get after it; a pair is dealt by both classes, so no class is one
    task's.
    """
    m = 1 + len(frequent) + RARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            u, n = added(keys, counts)
            return blocks(u, n, (mix(u.astype(U64)) % U64(buckets)).astype(np.int64))

        for batch in batches:
            for b in steps(batch, "text", 4 << 20):
                h, r, first = tokens(b)
                before, current = transitions(classes_of(frequent, h, r), first)
                u, n = np.unique(before * m + current, return_counts=True)
                keys.append(u)
                counts.append(n)
                held += len(u)
                if held > 2_000_000:
                    yield out()
                    keys, counts, held = [], [], 0
        if held:
            yield out()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(opened(batches))
        if got:
            u, n = added(*map(list, zip(*got, strict=True)))
            yield blocks(u, n, u // m % buckets)

    return docs.select("text").mapInArrow(run, BLOCKS).repartitionById(buckets, F.col("bucket")).mapInArrow(whole, BLOCKS)


def first_pairs(pairs: DataFrame, first: np.ndarray, m: int) -> np.ndarray:
    """The pair counts of the m classes that the classes belong to at first, added up in the tasks."""
    classes = len(first)

    def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        for u, n in opened(iter([batch])):
            np.add.at(sums, first[u // classes] * m + first[u % classes], n)

    return task_sums(pairs, m * m, add).astype(np.float64).reshape(m, m)


def train(pairs: np.ndarray, size: int = 32, noise: int = NOISE, rounds: int = 250, rate: float = 0.03, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context vectors q C, result vectors and biases of a log-bilinear model of few classes, trained by noise-contrastive estimation.

    The score of class w after c is (q_c C) . r_w + b_w. Every observed pair is told from `noise` draws of the unigram
    distribution per pair; as the counts of all pairs are at hand, the expectation over the draws is taken exactly instead of
    by sampling. Adam over batched matrix products.
    """
    m = len(pairs)
    total = max(pairs.sum(), 1.0)
    unigram = (pairs.sum(0) + SMOOTH) / (pairs.sum() + SMOOTH * m)
    rng = np.random.default_rng(seed)
    p = {"q": rng.normal(0, 0.3, (m, size)), "c": np.eye(size) + rng.normal(0, 0.05, (size, size)), "r": rng.normal(0, 0.3, (m, size)), "b": np.log(unigram)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    data = (pairs / total).astype(np.float32)
    noises = ((pairs.sum(1, keepdims=True) / total) * unigram[None, :] * noise).astype(np.float32)
    shift = np.log(noise * unigram).astype(np.float32)
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    if pairs.sum():
        for t in range(1, rounds + 1):
            context = p["q"] @ p["c"]
            right = 1 / (1 + np.exp(-np.clip(context @ p["r"].T + p["b"] - shift, -60, 60)))
            slope = (data + noises) * right - data  # of the loss by the score
            back = slope @ p["r"]
            grads = {"q": back @ p["c"].T, "c": p["q"].T @ back, "r": slope.T @ context, "b": slope.sum(0)}
            step = rate * min(1.0, 3 * (1 - t / (rounds + 1)))
            for k, g in grads.items():
                u, v = mom[k]
                u += 0.1 * (g - u)
                v += 0.02 * (g * g - v)
                p[k] -= step * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-10)
    return p["q"] @ p["c"], p["r"], p["b"]


def noise_set(weights: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and their weights that stand for all: the heaviest exactly, the others by draws."""
    order = np.lexsort((np.arange(len(weights)), -weights))
    top, rest = order[:EXACT], order[EXACT:]
    total = weights[rest].sum()
    if not total > 0:
        return top, weights[top].astype(np.float32)
    drawn = np.random.default_rng(seed).choice(rest, DRAWS, p=weights[rest] / total)
    return np.append(top, drawn), np.append(weights[top], np.full(DRAWS, total / DRAWS)).astype(np.float32)


def logistic(z: np.ndarray) -> np.ndarray:
    z *= np.float32(0.5)
    np.tanh(z, out=z)
    z += np.float32(1)
    z *= np.float32(0.5)
    return z


def refit(x: np.ndarray, others: np.ndarray, free: int, rows: np.ndarray, cols: np.ndarray, n: np.ndarray, noise: np.ndarray, noise_weights: np.ndarray, own: np.ndarray) -> np.ndarray:
    """x with its first `free` columns fitted by noise-contrastive estimation, each row by itself.

    The logit of pair (rows, cols), seen n times, is x[row] . others[col]; the noise of a row is `own` times noise_weights
    at the classes `noise`. Pairs are sorted by row. Adam, with a pull of KEEP occurrences to where a row began.
    """
    start, x = x, x.copy()
    cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    against = others[noise]
    u, v = np.zeros((len(x), free), np.float32), np.zeros((len(x), free), np.float32)
    for t in range(1, STEPS + 1):
        g = KEEP * (x - start)
        for i in range(0, len(x), 128):
            p = logistic(x[i : i + 128] @ against.T)
            p *= noise_weights
            g[i : i + 128] += (p @ against) * own[i : i + 128, None]
        # Blocks of whole rows.
        i = 0
        while i < len(cuts):
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + (1 << 13))))
            lo, hi = cuts[i], cuts[j] if j < len(cuts) else len(rows)
            y = others.take(cols[lo:hi], axis=0)
            p = logistic(np.einsum("ij,ij->i", x.take(rows[lo:hi], axis=0), y))
            y *= ((1 - p) * n[lo:hi])[:, None].astype(np.float32)
            g[rows[cuts[i:j]]] -= np.add.reduceat(y, cuts[i:j] - lo, axis=0)
            i = j
        g = g[:, :free]
        u += 0.1 * (g - u)
        v += 0.02 * (g * g - v)
        step = RATE * min(1.0, 3 * (1 - t / (STEPS + 1)))
        x[:, :free] -= step * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-6)
    return x


def refitted(pairs: DataFrame, buckets: int, by: str, x: np.ndarray, others: np.ndarray, free: int, noise: np.ndarray, noise_weights: np.ndarray, own: np.ndarray) -> np.ndarray:
    """refit over all pairs, dealt by their context (`by` row) or result (col): with the other side held, no row needs another's pairs."""
    m = len(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(opened(batches))
        if not got:
            return
        u, n = (np.concatenate(v) for v in zip(*got, strict=True))
        a, b = (u // m, u % m) if by == "row" else (u % m, u // m)
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        mine, at = np.unique(a, return_inverse=True)
        new = refit(x[mine], others, free, at, b, n, noise, noise_weights, own[mine])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * free), pa.array(new[:, :free].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(mine.astype(np.int32)), lists], ["at", "x"])

    def by_result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for u, n in opened(batches):
            held.append((u, n))
            size += len(u)
            if size > 2_000_000:
                yield split(held)
                held, size = [], 0
        if held:
            yield split(held)

    def split(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, n = (np.concatenate(v) for v in zip(*held, strict=True))
        return blocks(u, n, u % m % buckets)

    dealt = (pairs if by == "row" else pairs.mapInArrow(by_result, BLOCKS)).repartitionById(buckets, F.col("bucket"))
    got = fetch(dealt.mapInArrow(run, "at int, x array<float>"))  # a row per class
    out = x.copy()
    if got.num_rows:
        out[got["at"].to_numpy(), :free] = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, free)
    return out


def normalisers(spark: SparkSession, context: np.ndarray, result: np.ndarray) -> np.ndarray:
    """Logarithm of the exact normaliser over all classes after each class. Tasks take slices of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("id").to_numpy()
            for i in range(0, len(every), 128):
                at = every[i : i + 128]
                top, total = np.full(len(at), -np.inf, np.float32), np.zeros(len(at))
                for j in range(0, len(result), 2048):
                    s = context[at] @ result[j : j + 2048].T
                    high = np.maximum(top, s.max(1))
                    s -= high[:, None]
                    total = total * np.exp(top - high) + np.exp(s, out=s).sum(1)
                    top = high
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(top + np.log(total))], ["id", "norm"])

    got = fetch(spark.range(0, len(context), 1, max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), len(context) // 256))).mapInArrow(run, "id long, norm double"))
    out = np.zeros(len(context))
    out[got["id"].to_numpy()] = got["norm"].to_numpy()
    return out


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all training texts, and the counts (hash, c) of the words outside the head, for joins."""
    rows = docs.select("doc_id", "text").filter(fold(F.col("doc_id"), 10) != 0)
    counts = cut(word_counts(rows), "lm-counts")
    ends = rows.count()
    sums = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    # The least count whose words, and all more frequent ones, fit into the head: from a histogram on a log scale.
    step = F.floor(F.log2("c") * 8)
    histogram = sorted(((r.s, r.n, r.least) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    least, room = 1 << 62, HEAD
    for _, n, c in histogram:
        if n > room:
            break
        least, room = c, room - n
    enough = max(2, math.ceil(math.sqrt(int(sums.n) + ends) / SPARSE))
    least = min(least, enough)  # the embedded words are in the head, whatever its size
    head = fetch(counts.filter(F.col("c") >= least).select("hash", "c", "rare"))
    h, c, r = head["hash"].to_numpy().view(U64), head["c"].to_numpy(), head["rare"].to_numpy()
    order = np.argsort(h)
    h, c, r = h[order], c[order], r[order]
    listed = np.lexsort((h, -c))[:FREQUENT]
    first = np.sort(h[listed])
    embedded = c >= enough
    embedded[listed] = True
    frequent = h[embedded]
    # What the embedded words leave of each rare class.
    rare = fetch(counts.groupBy("rare").agg(F.sum("c").alias("n"), F.count("*").alias("v")))
    n_rare, v_rare = np.zeros(RARE), np.zeros(RARE)
    n_rare[rare["rare"].to_numpy()], v_rare[rare["rare"].to_numpy()] = rare["n"].to_numpy(), rare["v"].to_numpy()
    n_rare -= np.bincount(r[embedded], weights=c[embedded], minlength=RARE)
    v_rare -= np.bincount(r[embedded], minlength=RARE)
    buckets = max(1, min(partitions(docs), (int(sums.n) + ends) // BUCKET))
    pairs = cut(pair_counts(rows, frequent, buckets), "lm-pairs")
    # Every class begins as that of the few that it belongs to, by its share of it.
    m = 1 + len(first) + RARE
    begin = np.concatenate([[0], classes_of(first, frequent, r[embedded]), 1 + len(first) + np.arange(RARE)])
    context, result, bias = train(first_pairs(pairs, begin, m))
    n = np.concatenate([[ends], c[embedded], n_rare]).astype(np.float64)
    share = (n + SMOOTH) / np.bincount(begin, weights=n + SMOOTH, minlength=m)[begin]
    context = np.column_stack([context[begin], np.ones(len(n))]).astype(np.float32)
    result = np.column_stack([result[begin], bias[begin] + np.log(share)]).astype(np.float32)
    # Contexts, then results, by noise-contrastive estimation with the other side held. Each token is once a context.
    unigram = (n + SMOOTH) / (n + SMOOTH).sum()
    shift = np.zeros_like(result)
    shift[:, -1] = np.log(NOISE * unigram)
    size = context.shape[1]
    context = refitted(pairs, buckets, "row", context, result - shift, size - 1, *noise_set(unigram, 5), (NOISE * n).astype(np.float32))
    result = refitted(pairs, buckets, "col", result - shift, context, size, *noise_set(n, 7), (NOISE * unigram).astype(np.float32)) + shift
    drop(pairs)
    norm = normalisers(docs.sparkSession, context, result)
    model = Model(frequent, h, c, context, result, norm, np.log10(n_rare + SMOOTH * (v_rare + 1)), ends, int(sums.n) + ends, int(sums.v) + (ends > 0))
    return model, counts.filter(F.col("c") < least).select("hash", "c")


def score(docs: DataFrame, model: Model, tail: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, frequent_tokens, memory) of each document.

    score is the log10 probability of the text and its end: a class after a class, or after two words where the text has two before it, times the word's smoothed share of its rare
    class. Words that the head lacks, and contexts, are counted through shuffles, so every count is exact. memory is what direct weights that other training documents
    have taught give to a token after two words, in log10 and on average: near 0 or less for a text like no other, high for one that occurs elsewhere in the training part.
    A null text is empty: its only token is the end. Texts of any length are scored whole. Rows that repeat a doc_id are scored each; equal texts have equal scores. A null doc_id
    is never held out. An empty table gives an empty table; other columns are ignored.
    """
    buckets = max(1, min(partitions(docs), model.total // MET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for b in steps(batch, "text", 4 << 20):
                n = b.num_rows
                h, r, first = tokens(b)
                cls = model.classes(h, r)
                before, current = transitions(cls, first)
                ends = first + np.arange(n + 1)
                log_p = model.after(before, current)
                after = np.concatenate([[0.0], np.cumsum(log_p)])
                owner = np.repeat(np.arange(n), np.diff(first))
                if len(model.head):
                    at = np.minimum(np.searchsorted(model.head, h), len(model.head) - 1)
                    known = model.head[at] == h
                    c = np.where(known, model.head_counts[at], 0)
                else:
                    known, c = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
                log_c = np.where(known, np.log10(c + SMOOTH), 0.0)
                is_rare = cls > len(model.frequent)
                count = np.diff(first)
                sums = lambda v: np.bincount(owner, weights=v, minlength=n)  # noqa: E731, B023
                in_class = np.where(is_rare, log_c - model.rare_norm[r], 0.0)
                end_log = np.log10(model.end_count + SMOOTH)
                # Words that the head lacks, by document, with how often they occur.
                lost = np.flatnonzero(~known)
                yield laid_out(
                    n, bucket=np.full(n, (uid + (uid >> 33)) % buckets, np.int32), block=np.full(n, uid), uid=np.arange(uid, uid + n), doc_id=b.column("doc_id"), n_tokens=count + 1, known=(sums(known) + (model.end_count > 0)).astype(np.int64),
                    base=sums(log_c) + end_log - (count + 1) * np.log10(model.total + SMOOTH * (model.distinct + 1)), part=after[ends[1:]] - after[ends[:-1]] + sums(in_class), frequent_tokens=(count - sums(is_rare)).astype(np.int64),
                    **dict(zip(("lost", "times"), by_document(owner[lost], h[lost], n), strict=True)),
                )
                place, ctx = two_words(h, first)
                if len(place):
                    of = np.repeat(np.arange(n), count + 1)[place]
                    cells = context_cells(ctx, current[place], log_p[place], of, b.column("train").to_numpy(zero_copy_only=False), buckets)
                    yield laid_out(len(cells), bucket=pa.array([i for i, _ in cells], pa.int32()), block=np.full(len(cells), uid), cells=pa.array([x for _, x in cells], pa.binary()))
                uid += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(F.col("doc_id"), 10) != 0).alias("train")).mapInArrow(run, layout(SCORED))
    met = rows.repartitionById(buckets, F.col("bucket")).mapInArrow(direct_weights, layout(SCORED))
    rows = cut(met.repartition(partitions(docs), "block").mapInArrow(documents, layout(DOCUMENTS)), "lm-rows")
    words = rows.select("uid", F.inline(F.arrays_zip(F.col("lost").alias("hash"), F.col("times").alias("t"))))
    found = words.join(tail, "hash", "left")
    c = F.coalesce("c", F.lit(0))
    more = found.groupBy("uid").agg(F.sum(F.col("t") * F.log10(c + F.lit(SMOOTH))).alias("log_c"), F.sum(F.when(c > 0, F.col("t")).otherwise(0)).alias("k"))
    out = rows.drop("lost", "times").join(more, "uid", "left")
    log_c = F.coalesce("log_c", F.lit(0.0))
    return out.select(
        "doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + log_c).alias("base_score"), (F.col("part") + log_c + F.col("direct")).alias("score"), "frequent_tokens", (F.col("memory") / F.greatest(F.col("n_tokens") - 2, F.lit(1))).alias("memory"),
    )


#: Columns of what goes to the buckets and comes from them: documents, and cells or sums of a block of them; and of documents with their sums.
SCORED = {
    "bucket": pa.int32(), "block": pa.int64(), "uid": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "part": pa.float64(), "frequent_tokens": pa.int64(),
    "lost": pa.list_(pa.int64()), "times": pa.list_(pa.int64()), "cells": pa.binary(), "direct": pa.binary(), "memory": pa.binary(),
}
DOCUMENTS = {c: SCORED[c] for c in SCORED if c not in ("bucket", "block", "cells", "direct", "memory")} | {"direct": pa.float64(), "memory": pa.float64()}


def layout(columns: dict[str, pa.DataType]) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{c} {names[t]}" for c, t in columns.items())


def laid_out(n: int, **columns) -> pa.RecordBatch:
    """n rows of SCORED, null where nothing is given."""
    made = {c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in columns.items()}
    return pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(n, t) for c, t in SCORED.items()], list(SCORED))


def by_document(owner: np.ndarray, key: np.ndarray, n: int) -> list[pa.ListArray]:
    """Lists, a document each, of its distinct keys and how often it has them."""
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    offsets = pa.array(np.searchsorted(owner[at], np.arange(n + 1)).astype(np.int32))
    columns = [key[at].view(np.int64), np.diff(np.append(at, len(order))).astype(np.int64)]
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in columns]


def two_words(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, in the sequence with the ends, of the tokens that follow two words of their text, and the hash of those two."""
    n = np.diff(first)
    if len(h) < 2:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    pair = mix(h[:-1] * U64(BASE) + h[1:])
    owner = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(owner[1:] == owner[:-1])
    return at + 2 + owner[at], pair[at] >> U64(64 - BITS)  # an end stands in the sequence for each text before


#: Numbers of a piece of cells: of each context its hash, as differences, and cells; of each cell its class, log10 of its probability and documents; of
#: each document its number in the block (times 2, 1 more for a training one) and how often it has the cell.
CELLS = (np.uint64, np.uint32, np.uint32, np.float32, np.uint32, np.uint32, np.uint32)
CODEC = pa.Codec("zstd", 1)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of the types CELLS as bytes: their first bytes, then their second ones and so on, which compresses them well."""
    planes = [np.ascontiguousarray(v.astype(t)).view(np.uint8).reshape(len(v), -1).T.tobytes() for v, t in zip(arrays, CELLS, strict=True)]
    return np.array([len(v) for v in arrays], np.int64).tobytes() + CODEC.compress(b"".join(planes), asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    head = 8 * len(CELLS)
    n = np.frombuffer(data[:head], np.int64)
    raw = np.frombuffer(CODEC.decompress(data[head:], int(sum(k * np.dtype(t).itemsize for k, t in zip(n, CELLS, strict=True))), asbytes=True), np.uint8)
    out, at = [], 0
    for k, t in zip(n.tolist(), CELLS, strict=True):
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + k * size].reshape(size, k).T).view(t).ravel())
        at += k * size
    return out


def context_cells(ctx: np.ndarray, cls: np.ndarray, log_p: np.ndarray, doc: np.ndarray, train: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """What follows each context in a block of documents: a piece, packed, for each bucket, which is a range of hashes."""
    code = 2 * doc + train[doc]
    follow = cls * (2 * len(train)) + code
    rank = np.unique(ctx, return_inverse=True)[1]
    order = np.argsort(rank * (int(follow.max()) + 1) + follow)  # one sort of numbers each, which is faster than by two keys
    ctx, cls, log_p, code, follow = ctx[order], cls[order], log_p[order], code[order], follow[order]
    new_ctx = np.concatenate([[True], ctx[1:] != ctx[:-1]])
    new_cell = new_ctx | np.concatenate([[True], cls[1:] != cls[:-1]])
    entry = np.flatnonzero(new_cell | np.concatenate([[True], follow[1:] != follow[:-1]]))
    times = np.diff(np.append(entry, len(ctx)))
    bucket = ((ctx >> U64(BITS - 32)) * U64(buckets)) >> U64(32)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(ctx))
    contexts, cells = np.flatnonzero(new_ctx), np.flatnonzero(new_cell)
    in_context, in_cell = np.diff(np.searchsorted(cells, np.append(contexts, len(ctx)))), np.diff(np.searchsorted(entry, np.append(cells, len(ctx))))
    ranges = [np.searchsorted(v, cuts) for v in (contexts, cells, entry)]
    out = []
    for i in range(len(cuts) - 1):
        c, k, e = (slice(v[i], v[i + 1]) for v in ranges)
        own = ctx[contexts[c]]
        out.append((int(bucket[cuts[i]]), packed(np.append(own[:1], own[1:] - own[:-1]), in_context[c], cls[cells[k]], log_p[cells[k]], in_cell[k], code[entry[e]], times[e])))
    return out


def opened_cells(data: bytes) -> tuple[np.ndarray, ...]:
    """Of each cell its context's hash, its own and its log10 probability; of each document of a cell the cell, from 0, the document's code and how often it has it."""
    ctx, in_context, cls, log_p, in_cell, code, times = unpacked(data)
    ctx = np.repeat(np.cumsum(ctx, dtype=U64), in_context)
    return ctx, mix(ctx ^ mix(cls.astype(U64) + U64(1))), log_p.astype(np.float64), np.repeat(np.arange(len(cls)), in_cell), code.astype(np.int64), times.astype(np.int64)


def direct_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the direct weights of the contexts of a bucket add to the scores of each block's documents, and what they would add if they were learnt without the
    document. Rows of documents pass. Pieces stay packed, but for one at a time.

    A context of two words has a weight of its own for each class that follows it. With a pull of DIRECT occurrences to the bilinear model, which gives the
    class p, the weight at which noise-contrastive estimation ends, with all noise expected, makes its probability
    (n + DIRECT p) / (N + DIRECT), for n of N occurrences: normalised, and p times a quotient whose two counts are looked up apart.
    """
    held: list[tuple[int, bytes]] = []
    sums = {k: ([np.zeros(0, U64)], [np.zeros(0, np.int64)]) for k in ("contexts", "cells")}

    def add(kind: str, key: np.ndarray, n: np.ndarray) -> None:
        keys, counts = sums[kind]
        keys.append(key)
        counts.append(n)
        if sum(map(len, keys[1:])) > max(1_000_000, len(keys[0])):
            sums[kind] = tuple([v] for v in added(keys, counts))

    for batch in batches:
        whole = batch.filter(pc.is_null(batch.column("cells")))
        if whole.num_rows:
            yield whole
        for block, cells in zip(batch.column("block"), batch.column("cells"), strict=True):
            if cells.is_valid:
                held.append((block.as_py(), cells.as_py()))
                ctx, cell, _, at, code, times = opened_cells(held[-1][1])
                n = np.bincount(at, times * (code & 1), minlength=len(cell)).astype(np.int64)
                new = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
                add("contexts", ctx[new], np.add.reduceat(n, new))
                add("cells", cell, n)
    if not held:
        return
    (contexts, big), (cells, small) = (added(*sums[k]) for k in ("contexts", "cells"))
    for block, data in held:
        ctx, cell, log_p, at, code, times = opened_cells(data)
        doc, mine = np.unique(code, return_inverse=True)
        odds, n, total = np.exp(-np.log(10) * log_p), small[np.searchsorted(cells, cell)], big[np.searchsorted(contexts, ctx)]
        direct = np.log(n * odds + DIRECT) - np.log(total + DIRECT)
        # Without the document's own occurrences, of the cell and of its context.
        own = times * (code & 1)
        rank = np.cumsum(np.concatenate([[0], ctx[1:] != ctx[:-1]]))[at]
        pair, back = np.unique(rank * len(doc) + mine, return_inverse=True)
        of_context = np.bincount(back, own, minlength=len(pair))[back]
        others = np.log((n[at] - own) * odds[at] + DIRECT) - np.log(total[at] - of_context + DIRECT)
        got = [(np.bincount(mine, times * v, minlength=len(doc)) / np.log(10)).astype(np.float32).tobytes() for v in (direct[at], others)]
        yield laid_out(1, block=np.array([block]), cells=pa.array([(doc >> 1).astype(np.uint32).tobytes()], pa.binary()), direct=pa.array([got[0]], pa.binary()), memory=pa.array([got[1]], pa.binary()))


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents with the sums of all buckets: blocks are whole in a task."""
    sums: dict[int, np.ndarray] = {}
    held = []
    for batch in batches:
        alone = pc.is_null(batch.column("cells"))
        held.append(batch.filter(alone))
        some = batch.filter(pc.invert(alone))
        for block, doc, *values in zip(*[some.column(c).to_pylist() for c in ("block", "cells", "direct", "memory")], strict=True):
            at = np.frombuffer(doc, np.uint32)
            total = sums.get(block, np.zeros((0, 2)))
            if len(total) <= at[-1]:
                total = np.concatenate([total, np.zeros((int(at[-1]) + 1 - len(total), 2))])
            for i, v in enumerate(values):
                total[at, i] += np.frombuffer(v, np.float32)
            sums[block] = total
    for rows in held:
        if rows.num_rows:
            block, uid = rows.column("block").to_numpy(), rows.column("uid").to_numpy()
            out = np.zeros((rows.num_rows, 2))
            for b in np.unique(block).tolist():
                mine, total = np.flatnonzero(block == b), sums.get(b, np.zeros((0, 2)))
                place = uid[mine] - b
                out[mine[place < len(total)]] = total[place[place < len(total)]]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in DOCUMENTS if c not in ("direct", "memory")], pa.array(out[:, 0]), pa.array(out[:, 1])], list(DOCUMENTS))


def score_documents(docs: DataFrame) -> DataFrame:
    """`score` of all docs by the model of those whose fold isn't held out; see there for nulls, empty and long texts, repeats and empty tables."""
    docs = docs.select("doc_id", "text")
    model, tail = fit(docs)
    free_shuffles(docs.sparkSession)
    return score(docs, model, tail)
