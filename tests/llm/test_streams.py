import collections
import datetime as dt
import zlib

import numpy as np
import pytest

from textlineage.llm import throttling
from textlineage.llm.throttling import BATCHES, BURST, COST, DELAYED, HOUR, WAIT_HOURS

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, c0 int, batch string"
EPOCH = dt.datetime(1970, 1, 1)


def us(t):
    return round((t - EPOCH) / dt.timedelta(microseconds=1))


def settled(rows):
    """The contract, click by click."""
    rows = [r for r in dict.fromkeys(map(tuple, rows)) if r[1] is not None and r[3] is not None]
    hours = [us(r[2]) // HOUR for r in rows if r[2] is not None]
    lo, hi = min(hours, default=0), max(hours, default=0)
    batches = collections.defaultdict(list)
    for i, ts, at, client, *_ in rows:
        b = ((us(at) // HOUR if at is not None else lo) - lo) * BATCHES // (hi - lo + 1)
        b += i is not None and zlib.crc32(str(i).encode()) % DELAYED == 0
        batches[min(b, BATCHES - 1)].append((us(ts), i is not None, i or 0, client))
    out, waiting, seen, state = [], [], [], {}
    for b in range(BATCHES):
        w = max(seen) - WAIT_HOURS * HOUR if seen else float("-inf")
        for r in batches[b]:
            if r[0] < w:
                out.append((r[2] if r[1] else None, "late", b, None, None, None))
            else:
                waiting.append(r)
        due = sorted(r for r in waiting if r[0] < w or b == BATCHES - 1)
        waiting = [r for r in waiting if not (r[0] < w or b == BATCHES - 1)]
        for t, known, i, client in due:
            credit, last, penalty = state.get(client, (BURST * COST, t, None))
            credit = min(BURST * COST, credit + t - last)
            if credit >= COST:
                credit, penalty, row = credit - COST, None, ("admitted",)
            else:
                penalty, row = penalty if penalty is not None else t, ("throttled",)
            state[client] = credit, t, penalty
            out.append((i if known else None, *row, b, credit, penalty, None if penalty is None else t + COST - credit))
        seen += [r[0] for r in batches[b]]
    return collections.Counter(out)


def clicks(seed, n, days=60):
    """Bursts, ties, repeated, delayed and old rows, nulls in every column, one client with a third of the rows."""
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        ts = start + dt.timedelta(seconds=int(rng.integers(days * 86_400)) if i % 3 else int(rng.integers(40)) * 60 + 3 * 86_400 * int(rng.integers(days // 3)), microseconds=int(rng.integers(3)))
        at = ts + dt.timedelta(seconds=int(rng.integers(3_600)), days=int(rng.choice([0, 0, 0, 0, 3, 20])))
        client = 7 if i % 3 == 0 else int(rng.integers(6))
        rows.append((i, ts, at, client, None if i % 5 == 0 else "click", float(i % 4), '{"k": 1}', 1, "x"))
        if i % 11 == 0:
            rows.append(rows[-1])
        if i % 13 == 0:
            rows.append((i, ts, at, client, "other", None, None, None, None))  # not equal, so another click
    some = rows[0]
    rows += [(None, *some[1:]), (n, None, *some[2:]), (n + 1, some[1], None, *some[3:]), (n + 2, some[1], some[2], None, *some[4:]), (n + 3, dt.datetime(1969, 5, 1, 0, 0, 0, 1), some[2], 7, *some[4:])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_throttling_is_the_plain_walk(spark, monkeypatch, small):
    rows = clicks(3, 1_200)
    if small:  # several keys, lists in parts
        monkeypatch.setattr(throttling, "BUCKET_ROWS", 300)
        monkeypatch.setattr(throttling, "HELD", 16)
        monkeypatch.setattr(throttling, "GIVEN", 8)
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")  # times without a zone are UTC all the same
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    try:
        got = collections.Counter(map(tuple, throttling.throttle(df).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = settled(rows)
    assert got == want
    assert len({k[1] for k in want}) == 3 and any(k[1] == "late" for k in want)


def test_throttling_without_clicks_and_between_empty_batches(spark):
    assert throttling.throttle(spark.createDataFrame([], SCHEMA)).count() == 0
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(days=d), start + dt.timedelta(days=d), 1, None, None, None, None, None) for i, d in enumerate((0, 0, 0, 0, 0, 0, 100))]
    got = collections.Counter(map(tuple, throttling.throttle(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == settled(rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0  # the caller's session stays
