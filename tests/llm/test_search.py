import collections
import re

import numpy as np
import pytest

from textlineage.llm import divergence, topk

VECTORS = "vec_id long, embedding array<float>, label int, node string, d string, v string, size string"


def vector_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)) * rng.lognormal(0, 0.6, (400, 1)) / 4
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400 + i, rows[50][1]) for i in range(40)]  # copies of a query, queries among them
    rows += [rows[100], rows[100], (100, rows[101][1]), (None, rows[7][1]), (None, None), (450, None), (500, []), (501, []), (550, [0.0] * 16), (551, [1.0] * 3), (600, [1.0, -2.0, 0.5]), (650, [float("nan")] * 16), (700, [None] + [1.0] * 15), (750, [float("inf")] * 16)]
    return rows


def plain_top(rows, k=5):
    good = [(i, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int))) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    out = collections.Counter()
    for a, (q, x) in enumerate(good):
        if q is None or q % 50:
            continue
        scores = sorted((-sum(p * r for p, r in zip(x, y, strict=True)), i is None, i or 0) for b, (i, y) in enumerate(good) if b != a and len(x) == len(y))
        for rank, (s, no, i) in enumerate(scores[:k], 1):
            out[(q, rank, None if no else i, -s)] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_top_k_is_that_of_all_products(spark, monkeypatch, small):
    if small:  # several blocks and slices, steps of a few vectors
        for name, n in (("BLOCK", 4), ("SLICE", 60), ("STEP", 16), ("HEAD", 8), ("SAMPLE", 50)):
            monkeypatch.setattr(topk, name, n)
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, "n", "d", "v", "s") for i, v in rows], VECTORS).repartition(3)
    got = topk.top_k(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == plain_top(rows)


def test_top_k_of_few_and_no_rows(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (3, [-1.0, 0.25])]
    df = spark.createDataFrame([(i, v, 1, "n", "d", "v", "s") for i, v in rows], VECTORS)
    assert collections.Counter(map(tuple, topk.top_k(df).collect())) == plain_top(rows)


def test_a_block_looks_at_few_pairs_and_stops_early():
    rng = np.random.default_rng(0)
    basis = rng.normal(size=(8, 64))
    x = np.floor(64 * (rng.normal(size=(8_192, 8)) @ basis + 0.05 * rng.normal(size=(8_192, 64))) * rng.lognormal(0, 1, (8_192, 1)))
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    q = x[rng.integers(0, 8_192, 100)]
    place = rng.permutation(8_192)
    block = topk.Block(q, np.arange(100), np.full(100, -np.inf), topk.rotation(x[:2_000]), 6)
    for i in range(0, 8_192, 512):
        if not block.meet(x[i : i + 512], np.arange(i, i + 512), place[i : i + 512]):
            break
    s = (q @ x.T).astype(np.int64)
    for i in range(100):
        want = np.lexsort((place, -s[i]))[:6]
        mine = block.query == i
        assert block.found[mine].tolist() == want.tolist() and block.score[mine].tolist() == s[i, want].tolist()
    assert block.met < 8_192 and block.whole < 0.15 * 100 * 8_192  # lengths end the walk, bounds spare most products


def test_products_beyond_doubles_are_whole():
    x, y = np.array([[2.0**31, 3.0, 1.0]]), np.array([[2.0**31 - 1, 5.0, 7.0], [-(2.0**31), 1.0, 1.0]])
    want = [2**31 * (2**31 - 1) + 22, -(2**62) + 4]
    assert topk.products(x, y).tolist() == [want]
    assert topk.pair_products(x, y, np.array([0, 0]), np.array([0, 1])).tolist() == want
    with pytest.raises(OverflowError):
        topk.products(np.array([[2.0**40]]), np.array([[2.0**40]]))


# --- divergence


def plain_divergence(rows):
    n, df, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        n.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for k, t in df if k == lang and df[k, t] >= 10]
        v = len(kept)
        total = {s: sum(n[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (n[lang, s, t] + 2) // (total[s] + 2 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(n[lang, s, t] for s in sources) + 2) // (sum(total.values()) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s, t] and p[s][t] > q[t])[:10]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, i.decode(), -x, rank) for rank, (x, i) in enumerate(items, 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_is_the_plain_sum(spark, monkeypatch, small):
    if small:  # several chunks a task, partial counts added up on the way, many shards
        for name, size in (("CHUNK_BYTES", 200), ("SHARD_BYTES", 60_000), ("HELD_ROWS", 20)):
            monkeypatch.setattr(divergence, name, size)
    rng = np.random.default_rng(8)
    words = ["the", "The", "naïve", "NAÏVE", "漢字", "x1y", "don't", "a_b", "É", "zz"] + [f"w{c}" for c in "abcdefghij"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words, int(rng.integers(0, 30)), p=None))
        rows.append(("en" if i % 4 else "fr", f"s{int(rng.integers(5)) if i % 3 else 0}", text))
    rows += [(None, None, None), ("", "", "the the"), ("de", "only", "the " * 20), ("en", "blank", " \n\t "), ("en", "empty", ""), ("en", None, "\x00the\x00" * 9), ("fr", "long", "the naïve zz " * 60_000), rows[0], rows[0]]
    rows += [("x", s, t) for s in "ab" for t in ("one two", "three")]  # a language without kept terms
    df = spark.createDataFrame([(i, s, t, g, "n", "x") for i, (g, s, t) in enumerate(rows)], "doc_id long, source string, text string, lang string, term string, shard string").repartition(4)
    got = divergence.divergence(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == plain_divergence(rows)
    assert divergence.divergence(df.limit(0)).count() == 0
