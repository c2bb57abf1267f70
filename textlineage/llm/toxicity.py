"""Toxicity: non-negative positive-unlabelled learning over hashed words and word beginnings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlineage.llm.common import ALNUM, U64, fetch, fold, span_hashes, steps, task_sums, text_buffers, word_bounds

BITS = 22
PREFIXES = (4, 5, 6, 7, 8)


def feature_ids(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text's lower-case words and their beginnings, and the rows they belong to."""
    data, offsets = text_buffers(pc.utf8_lower(text))
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    owner = np.repeat(np.arange(len(text)), np.diff(first))
    hashes = span_hashes(data, starts, ends, PREFIXES)
    ids, rows = [(hashes[0] >> U64(64 - BITS)).astype(np.int64)], [owner]
    for p, h in zip(PREFIXES, hashes[1:], strict=True):
        long = ends - starts > p  # a beginning is something else than the word
        ids.append((h[long] >> U64(64 - BITS)).astype(np.int64))
        rows.append(owner[long])
    return np.concatenate(ids), np.concatenate(rows)


@dataclass
class Model:
    """table: place of each hashed feature among the chosen ones, -1 for the rest."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        t = np.full(1 << BITS, -1, np.int32)
        t[self.chosen] = np.arange(len(self.chosen))
        return t

    def logit(self, text: pa.Array, table: np.ndarray) -> np.ndarray:
        """The bias and the weights of the features that a text has at all."""
        ids, rows = feature_ids(text)
        at = table[ids]
        hit = at >= 0
        key = np.unique(rows[hit] * len(self.chosen) + at[hit]) if len(self.chosen) else np.zeros(0, np.int64)
        return np.bincount(key // max(len(self.chosen), 1), weights=self.weights[key % max(len(self.chosen), 1)] if len(key) else None, minlength=len(text)) + self.bias

    def score(self, text: pa.Array, table: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(text, table), -60, 60)))


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, batch: int = 2048, rate: float = 0.05, l2: float = 2e-5, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative risk prior * R+(p) + max(0, R-(u) - prior * R-(p)), logistic loss, by Adam.

    Where the corrected negative risk of a batch is below zero, the step goes up its gradient instead, which undoes overfitting.
    """
    rng, d = np.random.default_rng(seed), positive.shape[1]
    w, b = np.zeros(d), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(d + 1), np.zeros(d + 1), 0
    for _ in range(epochs):
        order_p, order_u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        n = max(1, -(-(len(positive) + len(unlabelled)) // batch))
        for i in range(n):
            p = positive[order_p[i * len(order_p) // n : (i + 1) * len(order_p) // n]].astype(np.float32)
            u = unlabelled[order_u[i * len(order_u) // n : (i + 1) * len(order_u) // n]].astype(np.float32)
            if not len(p) or not len(u):
                continue
            sp, su = 1 / (1 + np.exp(-(p @ w + b))), 1 / (1 + np.exp(-(u @ w + b)))
            # Losses: positive log(1 + exp(-z)), negative log(1 + exp(z)); their slopes are s - 1 and s.
            negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
            gu, gp = su / len(u), sp / len(p)
            if negative >= 0:
                cp, cu = prior * (sp - 1) / len(p) - prior * gp, gu
            else:
                cp, cu = prior * gp, -gu
            g = np.append(p.T @ cp + u.T @ cu + l2 * w, cp.sum() + cu.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = np.maximum(w - step[:-1], 0.0), b - step[-1]  # chosen for positive lift: length can't outvote a finding
    return w, float(b)


#: Scores are counted in bins of this width from -LIMIT to LIMIT.
BIN, LIMIT = 1 / 64, 60


def bins(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + LIMIT) / BIN), 0, 2 * LIMIT / BIN - 1).astype(np.int64)


def threshold(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The score at which the corrected 0-1 risk, prior * misses + max(0, flagged share - prior * hits), is least: the middle of the longest stretch
    of bins without a change among those where it is. Takes the numbers of either kind in each bin."""
    at = np.flatnonzero(positive + unlabelled)
    if not positive.sum() or not unlabelled.sum():
        return 0.0
    # Cut above each occupied bin; above the last one nothing is flagged.
    hits = 1 - np.cumsum(positive)[at] / positive.sum()
    flagged = 1 - np.cumsum(unlabelled)[at] / unlabelled.sum()
    risk = prior * (1 - hits) + np.maximum(0.0, flagged - prior * hits)
    good = np.flatnonzero(risk <= risk.min() + 1e-4)
    above = np.append(at[1:], at[-1] + 1)
    best = good[np.argmax((above - at)[good])]
    return float((at[best] + above[best] + 1) / 2 * BIN - LIMIT)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_positive: int = 6_000, most_unlabelled: int = 24_000, features: int = 1024, least: int = 4) -> Model:
    """Learns from confirmed toxic documents and unlabelled ones of the training folds.

    Documented bounds: at most about most_positive confirmed documents are used; the weights are fitted on those and a hashed sample of about
    most_unlabelled others. Which features are chosen, and the threshold, follow from all unlabelled documents. The class prior is the toxic
    share among labelled rows of those folds, 0.0001 at least and 0.9999 at most. Features are those that are most surely more
    frequent among the positives. Without positives, so also with an empty table, the model scores every text 0. Repeated labels of a document count as the largest.
    """
    mine = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    counts = mine.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("k")).first()
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), -60.0)
    if not counts.k:
        return nothing
    chance = lambda name: F.pmod(F.xxhash64(F.lit(name), "doc_id"), F.lit(1_000_000))
    prior = min(max(counts.k / counts.n, 1e-4), 1 - 1e-4)
    toxic = mine.filter((F.col("_y") == 1) & (chance("sample") < int(1e6 * min(1.0, most_positive / counts.k)))).select("doc_id")
    # About most_positive ids by a hash; counted, as that is what makes the broadcast safe.
    if toxic.count() > 2 * most_positive:
        raise RuntimeError(f"the hashed sample holds more than {2 * most_positive} positives")
    rows = docs.select("doc_id", "text").filter(fold(F.col("doc_id"), 5) != 0)
    positives = rows.join(F.broadcast(toxic), "doc_id").select("text")

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Positives with each feature, added up in the task; -1 counts them all."""
        for batch in batches:
            for b in steps(batch, "text"):
                ids, owner = feature_ids(b.column("text"))
                found, n = np.unique(np.unique(owner * (1 << BITS) + ids) & ((1 << BITS) - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(n, b.num_rows))], ["f", "p"])

    got = fetch(positives.mapInArrow(features_of, "f long, p long").groupBy("f").agg(F.sum("p").alias("p")).filter((F.col("p") >= least) | (F.col("f") == -1))).sort_by("f")
    f, p = got["f"].to_numpy(), got["p"].to_numpy()
    if len(f) < 2:
        return nothing
    n_p, f, p = p[0], f[1:], p[1:]

    places: list[np.ndarray] = []

    def add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        """Documents with each of those features, and at the end all documents."""
        if not places:  # once a task
            places.append(np.full(1 << BITS, -1, np.int32))
            places[0][f] = np.arange(len(f))
        place = places[0]
        for b in steps(batch, "text"):
            ids, owner = feature_ids(b.column("text"))
            at = place[ids]
            key = np.unique(owner[at >= 0] * len(f) + at[at >= 0])
            sums[: len(f)] += np.bincount(key % len(f), minlength=len(f))
            sums[len(f)] += b.num_rows

    u = task_sums(rows.select("text"), len(f) + 1, add)
    n_u, u = max(u[-1], 1), u[:-1]
    # Lift with a margin for chance: difference of shares over its standard error.
    a, b = p / n_p, u / n_u
    z = (a - b) / np.sqrt(a / n_p + b / n_u + 1 / n_p**2)
    best = np.lexsort([f, -z])[:features]
    chosen = f[best[z[best] > 2]]
    # Weights, on the sample.
    other = chance("unlabelled") < int(1e6 * min(1.0, most_unlabelled / n_u))
    sample = positives.select("text", F.lit(1).alias("_y")).unionByName(rows.filter(other).select("text", F.lit(0).alias("_y")))
    if not len(chosen):
        return nothing
    small, places = np.sort(chosen), np.argsort(chosen)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chosen features of each sampled document."""
        for batch in batches:
            for b in steps(batch, "text"):
                ids, owner = feature_ids(b.column("text"))
                at = np.searchsorted(small, ids)
                hit = (at < len(small)) & (small[np.minimum(at, len(small) - 1)] == ids)
                key = np.unique(owner[hit] * len(small) + places[at[hit]])
                n = np.bincount(key // len(small), minlength=b.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array((key % len(small)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("_y"), lists], ["_y", "at"])

    got = fetch(sample.mapInArrow(rows_of, "_y int, at array<int>"))
    lists, y = got["at"].to_pylist(), got["_y"].to_numpy()
    order = sorted(range(len(lists)), key=lambda i: (y[i], lists[i]))  # the same fit whatever the order of arrival
    x = np.zeros((len(lists), len(chosen)), np.uint8)
    for r, i in enumerate(order):
        x[r, lists[i]] = 1
    y = y[order]
    w, bias = nnpu(x[y == 1], x[y == 0], prior)
    # The threshold, by the scores of all unlabelled documents.
    model = Model(chosen, w, bias)
    width = int(2 * LIMIT / BIN)

    lookups: list[np.ndarray] = []

    def add_scores(batch: pa.RecordBatch, sums: np.ndarray) -> None:
        if not lookups:
            lookups.append(model.table())
        lookup = lookups[0]
        for b in steps(batch, "text"):
            sums += np.bincount(bins(model.logit(pc.fill_null(b.column("text"), ""), lookup)), minlength=width)

    zp = np.bincount(bins(x[y == 1].astype(np.float64) @ w + bias), minlength=width)
    model.bias -= threshold(zp, task_sums(rows.select("text"), width, add_scores), prior)
    return model


def score_toxicity(docs: DataFrame, model: Model, least: float = 0.5, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """docs with held_out, score and predicted; a null text is scored as the empty one, a null doc_id isn't held out.

    One pass without a shuffle. Columns of docs stay but for those named as the results (`names`). Equal texts have equal scores, and repeated rows
    a score each; a score at the threshold is predicted 1. Texts of any length are read whole. An empty table gives an empty table.
    """
    held_out, result, predicted = names
    keep = docs.drop(*names)
    schema = T.StructType([*keep.schema.fields, T.StructField(result, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = model.table()
        for batch in batches:
            for b in steps(batch, "text"):
                text = pc.fill_null(b.column("text"), "")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(text, lookup))], [*b.schema.names, result])

    out = keep.mapInArrow(run, schema)
    return out.withColumn(held_out, fold(F.col("doc_id"), 5) == 0).withColumn(predicted, (F.col(result) >= least).cast("int"))
