"""Quality classifier: regularised quadratic discriminant analysis over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlineage.llm.common import ALNUM, U64, VISIBLE, byte_class, chain, fetch, fold, group_sums, span_hashes, steps, text_buffers, word_bounds

UPPER = byte_class(lambda b: 65 <= b <= 90)
LETTER = byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80)
DIGIT = byte_class(lambda b: 48 <= b <= 57)
SYMBOL = byte_class(lambda b: 33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-?()")
STOP = byte_class(lambda b: chr(b) in ".?!;:")
HIGH = byte_class(lambda b: b >= 0x80)

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "stops", "high", "lines", "distinct", "top_word", "distinct_pairs", "repeats", "short", "long", "single")


def distinct_counts(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document and the most often repeated one's count (48 bits of each hash)."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = np.sort((doc.astype(U64) << U64(48)) | (h >> U64(16)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    owner = (key[at] >> U64(48)).astype(np.int64)
    runs = np.diff(np.append(at, len(key)))
    most = np.zeros(n)
    np.maximum.at(most, owner, runs)
    return np.bincount(owner, minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, FEATURES) of the whole texts; an empty text has zeros and no variety."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, first = word_bounds(data, offsets, VISIBLE)
    words = np.diff(first).astype(float)
    owner = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(float)
    share = lambda flags, of: group_sums(flags[data].astype(np.int64), offsets) / np.maximum(of, 1)
    letters = np.maximum(group_sums(LETTER[data].astype(np.int64), offsets), 1)
    # Words without the punctuation around them, for variety.
    s2, e2, first2 = word_bounds(data, offsets, ALNUM)
    plain = np.maximum(np.diff(first2).astype(float), 1)
    owner2 = np.repeat(np.arange(n), np.diff(first2))
    h = span_hashes(data, s2, e2)[0]
    distinct, most = distinct_counts(h, owner2, n)
    if len(h) > 1:
        same = owner2[1:] == owner2[:-1]
        pairs = chain(h, 2)[same]
        distinct_pairs, _ = distinct_counts(pairs, owner2[1:][same], n)
        repeats = np.bincount(owner2[1:][same & (h[1:] == h[:-1])], minlength=n)
    else:
        distinct_pairs, repeats = np.zeros(n), np.zeros(n)
    by_word = lambda flags: np.bincount(owner, weights=flags, minlength=n) / np.maximum(words, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(size / np.maximum(words, 1)),
        np.sqrt(group_sums(UPPER[data].astype(np.int64), offsets) / letters), np.sqrt(share(DIGIT, size)), np.sqrt(share(SYMBOL, size)), np.sqrt(share(STOP, size)), np.sqrt(share(HIGH, size)),
        np.sqrt(group_sums((data == 10).astype(np.int64), offsets) / np.maximum(words, 1)),
        # Variety falls with length: log distinct against log words is nearly straight for prose.
        np.log1p(distinct) / np.maximum(np.log1p(plain), 1e-9), np.sqrt(most / plain), np.log1p(distinct_pairs) / np.maximum(np.log1p(np.maximum(plain - 1, 1)), 1e-9),
        np.sqrt(repeats / plain), by_word(length <= 3), by_word(length >= 13), by_word(length == 1),
    ])


@dataclass
class Discriminant:
    """Class means and cached Cholesky factors, with their inverses, over clipped, robustly scaled statistics."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: list[np.ndarray]
    inverses: list[np.ndarray]
    offsets: np.ndarray

    CLIP = 5.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, shrinkage: float = 0.15, ridge: float = 0.05) -> Discriminant:
        """Covariances shrunk towards the pooled one and, by ridge, the identity. A class without rows gets the other's place
        and a prior of nearly none."""
        if not len(x):
            x, y = np.zeros((2, len(FEATURES))), np.array([0, 1])
        center = np.median(x, 0)
        scale = np.maximum(np.percentile(x, 84, 0) - np.percentile(x, 16, 0), 1e-3) / 2 + 0.25 * x.std(0)
        scale = np.maximum(scale, 1e-6)
        z = np.clip((x - center) / scale, -cls.CLIP, cls.CLIP)
        d, groups = z.shape[1], [z[y == k] for k in (0, 1)]
        means = np.array([g.mean(0) if len(g) else z.mean(0) for g in groups])
        own = [np.cov(g.T, bias=True) if len(g) > 1 else np.eye(d) for g in groups]
        pooled = sum(len(g) * c for g, c in zip(groups, own, strict=True)) / max(len(z), 1)
        factors, offsets = [], []
        for g, c in zip(groups, own, strict=True):
            factor = np.linalg.cholesky((1 - shrinkage) * c + shrinkage * pooled + ridge * np.eye(d))
            factors.append(factor)
            offsets.append(np.log((len(g) + 0.5) / (len(z) + 1)) - np.log(np.diag(factor)).sum())
        # Lower triangular, so whitening a document is one product.
        inverses = [np.tril(np.linalg.inv(f)) for f in factors]
        return cls(center, scale, means, factors, inverses, np.array(offsets))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the logistic of the difference of log densities."""
        z = np.clip((x - self.center) / self.scale, -self.CLIP, self.CLIP)
        log = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for f, m, o in zip(self.inverses, self.means, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id and label of at most about `most` rows of the training folds: a hash of the id decides, whatever the order.

    Repeated labels of a document count as the largest.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    n = rows.count()
    share = min(1.0, most / max(n, 1))
    kept = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # The hash leaves about `most` ids, or 2 * `most` with a probability of nil; counted, as that is what makes the broadcast safe.
    if kept.count() > 2 * most:
        raise RuntimeError(f"the hashed sample holds more than {2 * most} labels")
    return docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000) -> Discriminant:
    """Learns from at most `most` labelled rows (a documented bound), outside the held-out fold."""
    names = ", ".join(f"{f} double" for f in FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                x = statistics(*text_buffers(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("_y"), *[pa.array(x[:, i]) for i in range(x.shape[1])]], ["_y", *FEATURES])

    got = fetch(labelled_sample(docs, labels, label, most).mapInArrow(run, f"_y int, {names}"))
    x = np.column_stack([got[f].to_numpy() for f in FEATURES]) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = got["_y"].to_numpy() if got.num_rows else np.zeros(0, int)
    order = np.lexsort([*x.T, y]) if len(x) else np.zeros(0, int)  # the same sums whatever the order of arrival
    return Discriminant.fit(x[order], y[order])


def score_quality(docs: DataFrame, model: Discriminant, threshold: float = 0.3, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """docs with held_out, score and predicted. A null text is scored as the empty one; a null doc_id isn't held out.

    One pass without a shuffle. Columns of docs stay but for those named as the results (`names`). Equal texts have equal scores, and repeated rows
    a score each; a score at the threshold is predicted 1. Texts of any length are read whole. An empty table gives an empty table; a model fitted on
    no labels scores every text alike.
    """
    held_out, result, predicted = names
    keep = docs.drop(*names)
    schema = T.StructType([*keep.schema.fields, T.StructField(result, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                score = model.score(statistics(*text_buffers(b.column("text"))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, result])

    out = keep.mapInArrow(run, schema)
    return out.withColumn(held_out, fold(F.col("doc_id"), 5) == 0).withColumn(predicted, (F.col(result) >= threshold).cast("int"))
