"""Best-fit packing: a configuration linear program over the length histogram, rounded to sequences."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlineage.llm.common import cut, fetch

SEQUENCE = 2048
#: Least number of items that one task ranks, and most salts that the lengths have together beside one each.
SALT_ROWS, SALTS = 500, 50_000

# --- the program ---------------------------------------------------------------------------------


def knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Most value of each capacity from any number of each length, and the length index added last (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = upto[c]
        if not k:
            continue
        options = best[c - lengths[:k]] + value[:k]
        j = int(options.argmax())
        if options[j] > best[c - 1] + 1e-15:
            best[c], last[c] = options[j], j
        else:
            best[c] = best[c - 1]
    return best, last


def best_filling(lengths: np.ndarray, last: np.ndarray, capacity: int) -> dict[int, int]:
    """Counts by length index of the filling that `last` describes."""
    out: dict[int, int] = {}
    while capacity > 0:
        j = int(last[capacity])
        if j < 0:
            capacity -= 1
        else:
            out[j] = out.get(j, 0) + 1
            capacity -= int(lengths[j])
    return out


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, work: int = 120_000, slack: float = 0.01, step: float = 0.25, rate: float = 0.2) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional configurations {((length index, times), ...): number} that cover the counts, by multiplicative weights.

    Lengths are the experts and their weights the prices. A round solves one knapsack table, which gives for every length the
    most valuable configuration that holds it; those within `slack` of the best are used, as often as a share `step` of what their
    scarcest length has. A length's price falls exponentially with the share of its items covered, so what is left uncovered
    gets dear and ends up in the best configurations. Prices and amounts are averaged over all rounds by the scale at the end, which
    makes the median coverage 1. work: rounds times lengths.
    """
    price = lengths / capacity
    x: dict[tuple[tuple[int, int], ...], float] = {}
    cover = np.zeros(len(lengths))
    for _ in range(max(24, min(1_500, work // max(len(lengths), 1)))):
        best, last = knapsack(lengths, price, capacity)
        worth = price + best[capacity - lengths]
        got = np.zeros(len(lengths))
        for i in np.flatnonzero(worth >= (1 - slack) * worth.max()):
            p = best_filling(lengths, last, capacity - int(lengths[i]))
            p[int(i)] = p.get(int(i), 0) + 1
            times = step * min(counts[j] / a for j, a in p.items())
            key = tuple(sorted(p.items()))
            x[key] = x.get(key, 0.0) + times
            for j, a in p.items():
                got[j] += a * times
        cover += got / counts
        price = price * np.exp(-rate * np.minimum(got / counts, 5.0))
        price /= price.max()
    scale = 1 / max(float(np.median(cover)), 1e-9)
    return {p: v * scale for p, v in x.items()}


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over counts: (configuration, times). Bins of one content are handled together."""
    room: dict[int, list[list]] = {}  # free tokens -> [[configuration as dict, times]]
    for i in np.argsort(-lengths):
        n, size = int(counts[i]), int(lengths[i])
        for r in sorted(k for k in room if k >= size):
            if not n:
                break
            k, rest = r // size, []
            for config, times in room.pop(r):
                full = min(times, n // k)
                if full:
                    room.setdefault(r - k * size, []).append([config | {int(i): k}, full])
                    n -= full * k
                if full < times and 0 < n < k:
                    room.setdefault(r - n * size, []).append([config | {int(i): n}, 1])
                    full, n = full + 1, 0
                if full < times:
                    rest.append([config, times - full])
            if rest:
                room.setdefault(r, []).extend(rest)
        k = capacity // size
        if n // k:
            room.setdefault(capacity - k * size, []).append([{int(i): k}, n // k])
        if n % k:
            room.setdefault(capacity - (n % k) * size, []).append([{int(i): n % k}, 1])
    return [(tuple(sorted(c.items())), t) for group in room.values() for c, t in group if t]


Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def rounded(x: dict[tuple[tuple[int, int], ...], float], lengths: np.ndarray, counts: np.ndarray, capacity: int, least: float) -> tuple[Plan, np.ndarray]:
    """Whole times of the configurations that fill at least that share of a sequence, the fullest first, and the items left."""
    out, left = [], counts.astype(np.int64).copy()
    fullness = {p: sum(a * int(lengths[j]) for j, a in p) for p in x}
    for p, v in sorted(x.items(), key=lambda t: (-fullness[t[0]], -t[1], t[0])):
        times = min(int(v), *(int(left[j]) // a for j, a in p))
        if times > 0 and fullness[p] >= capacity * least:
            out.append((p, times))
            for j, a in p:
                left[j] -= times * a
    return out, left


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = SEQUENCE) -> Plan:
    """Whole configurations for every item: the program's, rounded down, and the items left best-fit.

    lengths ascending and distinct, 1 to capacity; counts positive. What a rounding leaves is a smaller program of its own, solved
    once more. Of several roundings, by how full a configuration has to be, the one with the fewest sequences is taken.
    Work depends on the capacity, not on the number of items.
    """
    x = solve(lengths, counts, capacity) if len(lengths) else {}
    best: tuple[int, Plan] | None = None
    for least in (1.0, 0.995, 0.98, 0.95, 0.9, 0.0):
        out, left = rounded(x, lengths, counts, capacity, least)
        for again in (True, False):
            some = np.flatnonzero(left > 0)
            name = lambda found: [(tuple((int(some[j]), a) for j, a in p), t) for p, t in found]  # noqa: E731, B023
            if again and least in (0.995, 0.95) and len(some):
                more, rest = rounded(solve(lengths[some], left[some], capacity, 16), lengths[some], left[some], capacity, least)
                out = out + name(more)
                left[some] = rest
            elif not again:
                out = out + name(best_fit(lengths[some], left[some], capacity))
        n = sum(t for _, t in out)
        if best is None or n < best[0]:
            best = (n, out)
    return best[1] if best else []


# --- tokens --------------------------------------------------------------------------------------


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(path: str) -> Callable[[str], list[int]]:
    """Encoder of a byte-level BPE file, with the ids that `tokenizers` gives.

    The same vocabulary runs several times faster in tiktoken; texts that hold a special token's string, and very long
    ones, whose white space that pattern engine may not take, go through `tokenizers` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # Byte-level alphabets write byte b as a printable character: itself, or 256 and up in order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        if len(text) > 1_000_000 or any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and id 0, cut if longer than a sequence.

    All pieces but the first are full, so that long documents leave one rest each. An empty or null text is the one id 0.
    """
    path = path or tokenizer_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), 0], "<u4")
                ends = np.arange(len(ids) % capacity or capacity, len(ids) + 1, capacity) if len(ids) > capacity else np.array([len(ids)])
                start = 0
                for i, end in enumerate(ends.tolist()):
                    rows.append((doc_id, i, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """items with sequence_id and offset: `length` tokens each, 1 to capacity, in few sequences without gaps.

    Full items are sequences of their own, numbered where they are read. The histogram of the others by length, and then by length and salt, is all that reaches the driver:
    a length has a salt for each SALT_ROWS rows or, of many items, for each SALTS-th part of them, so that is a row for each length and SALTS more. Items are ranked
    within their length and salt, so that a length that a third of all items have is ranked by many tasks; the rank decides
    sequence and place by a search in the plan. Rows that are equal in all columns are interchangeable. items must be cheap
    to read several times (a cut table). An empty table gives an empty table.
    """
    full = items.filter(F.col("length") == capacity).withColumns({"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = items.filter(F.col("length") < capacity)
    table = fetch(rest.groupBy(F.col("length").cast("int").alias("length")).agg(F.count("*").alias("n"))).sort_by("length")
    lengths, counts = (table[c].to_numpy().astype(np.int64) for c in ("length", "n"))
    if not len(lengths):
        return full
    salts = np.zeros(capacity, np.int64)
    salts[lengths] = -(-counts // max(SALT_ROWS, -(-int(counts.sum()) // SALTS)))
    first = np.cumsum(salts) - salts  # place of each length's first salt
    row = F.xxhash64(*[F.col(c) for c in items.columns])
    salted = rest.withColumn("_salt", F.pmod(row, F.get(F.array(*[F.lit(int(k)) for k in salts]), F.col("length").cast("int"))).cast("int"))
    table = fetch(salted.groupBy(F.col("length").cast("int").alias("length"), "_salt").agg(F.count("*").alias("n")))
    size, salt, n = (table[c].to_numpy().astype(np.int64) for c in ("length", "_salt", "n"))
    before = np.zeros(int(salts.sum()) + 1, np.int64)
    before[first[size] + salt + 1] = n
    before = np.cumsum(before)
    before = before[:-1] - np.repeat(before[first[lengths]], salts[lengths])
    # Spans of ranks of each length: (length, first rank) -> times in a sequence, first sequence, offset.
    spans, taken, base = [], dict.fromkeys(range(len(lengths)), 0), 0
    for p, times in plan(lengths, counts, capacity):
        offset = 0
        for j, a in p:
            spans.append((int(lengths[j]), taken[j], a, base, offset))
            taken[j] += a * times
            offset += a * int(lengths[j])
        base += times
    spans.sort()
    s = np.array(spans, np.int64).reshape(-1, 5)
    keys = (s[:, 0] << 48) | s[:, 1]

    ranked = salted.withColumn("_rn", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*items.columns)) - 1)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), "sequence_id long", "offset long"])
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = before[first[length] + b.column("_salt").to_numpy(zero_copy_only=False)] + b.column("_rn").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            inside = rank - s[at, 1]
            sequence, offset = s[at, 3] + inside // s[at, 2], s[at, 4] + inside % s[at, 2] * length
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE) -> DataFrame:
    """One row per piece of each document, packed: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is the one id 0; texts of any length are read whole. Repeated rows, and rows that share a doc_id, have pieces each; ties
    are interchangeable. A null doc_id stays null. An empty table gives an empty table. Other columns are ignored, whatever their names.
    """
    return pack(cut(pieces(docs, path, capacity), "pack-pieces"), capacity)
