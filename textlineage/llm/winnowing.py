"""Document fingerprints by winnowing, and their likeness to edited and neighbouring texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlineage.llm.common import BYTE_VALUE, U64, fetch, mix, powers

K, W = 16, 32
BLOCK = 1 << 19
_tables: list[np.ndarray] = []


def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and letter-or-digit of the first 65,536 code points."""
    if not _tables:
        lower = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(1 << 16)], np.uint32)
        keep = np.array([chr(i).isalnum() for i in range(1 << 16)])
        _tables.extend((lower, keep))
    return _tables[0], _tables[1]


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and positions (code points of the text) that winnowing selects, positions ascending.

    Letters and digits count, in lower case, as do all code points past 65,535. Of each window of w consecutive k-gram hashes the least is chosen, the
    rightmost where several are equal, so texts that share a passage of k + w - 1 such characters share a selected hash.
    Fewer than w k-grams are one window; fewer than k characters are one gram; none give an empty fingerprint.
    Done in blocks of windows, so memory beyond the text's code points is bounded.
    """
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lower, keep = char_tables()
    low = np.minimum(code, (1 << 16) - 1)
    kept = keep[low] | (code >= 1 << 16)
    at = np.flatnonzero(kept)
    c = np.where(code < 1 << 16, lower[low], code)[at]
    n = len(c)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    k = min(k, n)
    grams = n - k + 1
    width = min(w, grams)
    windows = grams - width + 1
    hashes, places = [], []
    for lo in range(0, windows, BLOCK):
        m = min(BLOCK, windows - lo) + width - 1  # grams of this block
        part = c[lo : lo + m + k - 1].astype(U64)
        up, down = powers(BLOCK + W + K + 1)
        sums = np.empty(len(part) + 1, U64)
        sums[0] = 0
        # A bijective spread of the code points, then a polynomial over them.
        np.cumsum((part * U64(0xD6E8FEB86659FD93) + BYTE_VALUE[0]) * up[: len(part)], out=sums[1:])
        h = mix((sums[k:] - sums[:-k]) * down[:m])
        v, idx, have = h, np.arange(m), 1
        while have < width:  # minima of doubling widths; the right one on ties
            s = min(have, width - have)
            right = v[s:] <= v[:-s]
            v, idx = np.where(right, v[s:], v[:-s]), np.where(right, idx[s:], idx[:-s])
            have += s
        idx = idx[np.concatenate([[True], idx[1:] != idx[:-1]])]
        hashes.append(h[idx])
        places.append(at[idx + lo])
    h, p = np.concatenate(hashes), np.concatenate(places)
    first = np.concatenate([[True], p[1:] != p[:-1]])
    return h[first], p[first]


def encode(h: np.ndarray, p: np.ndarray) -> str:
    """Hex of (upper 32 bits of the hash, position), big-endian, in order of position."""
    out = np.empty((len(h), 2), ">u4")
    out[:, 0], out[:, 1] = h >> U64(32), p
    return out.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of sorted distinct hashes; 1 for two empty fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


#: Rows and bytes of a range; ranges of few rows are at most SHORT.
ROWS, BYTES, SHORT = 1_000, 64 << 20, 4_096


def ordered_ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) cut into ranges of ascending doc_id, each followed by the first row after it.

    Columns _r (range), _ghost (true for that next row, whose own place is another range), _k. There are as many ranges as make BYTES each, or
    more, of ROWS, while those are no more than SHORT; their quantiles of the ids and first ids are all that reaches the driver, 30 bytes a range. Every text is shuffled once. Null ids come last.
    """
    keyed = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sums = keyed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, min(SHORT, sums.n // ROWS), min(sums.n, -(-sums.bytes // BYTES)))
    cuts = sorted(set(keyed.select("_k").approxQuantile("_k", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    splits = [-float("inf"), *cuts, float("inf")]
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol="_d", outputCol="_b").transform(keyed.withColumn("_d", F.col("_k").cast("double")))
        ranged = ranged.withColumn("_r", F.col("_b").cast("int")).drop("_d", "_b")
    else:
        ranged = keyed.withColumn("_r", F.lit(0))
    firsts = fetch(ranged.groupBy("_r").agg(F.min("_k").alias("_k"))).sort_by("_r")
    before = np.roll(firsts["_r"].to_numpy(), 1)  # the first range follows the last
    nxt = docs.sparkSession.createDataFrame(pa.table({"_k": firsts["_k"], "_r": pa.array(before.astype(np.int32))}))
    ghosts = keyed.join(F.broadcast(nxt), "_k")
    both = ranged.select("_r", F.lit(False).alias("_ghost"), "_k", "doc_id", "text").unionByName(ghosts.select("_r", F.lit(True).alias("_ghost"), "_k", "doc_id", "text"))
    return both, len(splits) - 1


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each document.

    The edited text has its last floor(n_chars / 4) code points replaced by as many (or all) first ones of the next document's, by
    ascending doc_id and, where ids repeat, text; the first follows the last, a lone document itself. Null text is empty; null ids come last.
    Equal texts have equal fingerprints, repeated rows a row each. Texts of any length are read whole, in blocks. An empty table gives an empty table. Other columns of docs are not read.
    """
    both, parts = ordered_ranges(docs)
    dealt = both.repartitionById(parts, F.col("_r")).sortWithinPartitions("_r", "_ghost", "_k", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_selected long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []  # the document that waits for its next one

        def finish(nxt: str, nxt_set: np.ndarray) -> None:
            _, doc_id, text, (h, p), own = held
            n = len(text)
            edited = text[: n - n // 4] + nxt[: n // 4]
            eh, ep = winnow(edited)
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, n, digest, encode(h, p), encode(eh, ep), likeness(own, np.unique(eh)), likeness(own, nxt_set), len(h)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_selected"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            cols = {c: batch.column(c) for c in ("_r", "_ghost", "doc_id", "text")}
            for i in range(batch.num_rows):
                r, ghost, text = cols["_r"][i].as_py(), cols["_ghost"][i].as_py(), cols["text"][i].as_py()
                if held is None and ghost:
                    continue  # a second row with the id of the next document
                fp = winnow(text)
                own = np.unique(fp[0])
                if held is not None:
                    finish(text, own)
                held = None if ghost else (r, cols["doc_id"][i].as_py(), text, fp, own)
                if len(out) >= 256:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(run, schema)
