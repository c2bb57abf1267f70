import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from textlineage.llm import bilinear, quality, toxicity, winnowing
from textlineage.llm.common import ALNUM, VISIBLE, span_hashes, steps, text_buffers, word_bounds
from textlineage.llm.registry import QUERIES

SF = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    mine = [r for r in rows if r.held_out]
    return [(r[label], r.predicted) for r in mine]


def test_quality_on_held_out_documents(spark):
    pairs = held_out(spark, "op5_quadratic_discriminant_quality", "quality")
    assert np.mean([a == b for a, b in pairs]) >= 0.98
    assert np.mean([b for a, b in pairs if a == 1]) >= 0.99


def test_toxicity_on_held_out_documents(spark):
    pairs = held_out(spark, "op2_nonnegative_pu_toxicity", "toxic")
    assert np.mean([b for a, b in pairs if a == 1]) >= 0.75
    assert np.mean([b for a, b in pairs if a == 0]) <= 0.02


@pytest.mark.parametrize("module,score,label", [(quality, "score_quality", "quality"), (toxicity, "score_toxicity", "toxic")])
def test_classifier_edge_cases(spark, edge_docs, no_docs, edge_labels, module, score, label):
    model = module.fit(edge_docs, edge_labels)
    rows = getattr(module, score)(edge_docs, model)
    assert set(edge_docs.columns) <= set(rows.columns)
    got = rows.collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.text or ""].add(r.score)
    assert all(len(v) == 1 for v in by_text.values())
    kept = getattr(module, score)(edge_docs, model, names=("_a", "_b", "_c")).select(*edge_docs.columns).collect()
    assert sorted(map(str, kept)) == sorted(map(str, edge_docs.collect()))
    empty = module.fit(no_docs, edge_labels.limit(0))
    assert getattr(module, score)(no_docs, empty).count() == 0
    assert getattr(module, score)(edge_docs, empty).count() == len(got)


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 4)), rng.normal(1.5, 2, (300, 4))])
    y = np.repeat([0, 1], 300)
    m = quality.Discriminant.fit(x, y)
    z = np.clip((x - m.center) / m.scale, -m.CLIP, m.CLIP)
    logs = []
    for f, mean, o in zip(m.factors, m.means, m.offsets, strict=True):
        inv = np.linalg.inv(f @ f.T)
        logs.append(o - 0.5 * np.einsum("ij,jk,ik->i", z - mean, inv, z - mean))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_nnpu_finds_the_positive_feature():
    rng = np.random.default_rng(1)
    toxic = rng.random(4000) < 0.1
    x = (rng.random((4000, 6)) < 0.2).astype(np.uint8)
    x[:, 0] = toxic
    w, b = toxicity.nnpu(x[toxic][:200], x, 0.1)
    z = x @ w + b
    width = int(2 * toxicity.LIMIT / toxicity.BIN)
    cut = toxicity.threshold(np.bincount(toxicity.bins(z[toxic][:200]), minlength=width), np.bincount(toxicity.bins(z), minlength=width), 0.1)
    flagged = z >= cut
    assert (flagged == toxic).mean() > 0.99 and (w >= 0).all()


def plain_features(text):
    """The features of a text by their bytes."""
    out = set()
    for w in re.findall(rb"(?:[a-z0-9]|[\x80-\xff])+", (text or "").lower().encode()):
        out |= {(w, 0)} | {(w[:p], p) for p in toxicity.PREFIXES if len(w) > p}
    return out


def test_toxicity_is_fitted_as_by_hand(spark, edge_docs):
    """Features, prior, weights and threshold against a plain fit, with every document in the sample; scores of all texts."""
    rng = np.random.default_rng(12)
    docs, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.2
        words = [f"w{rng.integers(300)}" for _ in range(int(rng.integers(0, 30)))] + (["vileness", "vilest"][: int(rng.integers(1, 3))] if bad else [])
        docs.append((i, " ".join(words)))
        if rng.random() < 0.7:
            labels.append((i, int(bad)))
    train = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    hashed = lambda x: {int(v) for v in toxicity.feature_ids(pa.array([x]))[0]}
    assert all(len(hashed(t)) == len(plain_features(t)) for _, t in docs[:50])
    toxic = {i for i, y in labels if y and train(i)}
    rows = [(i, hashed(t)) for i, t in docs if train(i)]
    prior = len(toxic) / sum(train(i) for i, _ in labels)
    p, u = collections.Counter(f for i, fs in rows if i in toxic for f in fs), collections.Counter(f for _, fs in rows for f in fs)
    n_p, n_u = len(toxic), len(rows)
    lift = {f: (p[f] / n_p - u[f] / n_u) / math.sqrt(p[f] / n_p / n_p + u[f] / n_u / n_u + 1 / n_p**2) for f in p if p[f] >= 4}
    chosen = sorted((f for f in lift if lift[f] > 2), key=lambda f: (-lift[f], f))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.chosen.tolist() == chosen and len(chosen) >= 4
    lists = lambda keep: np.array(sorted([chosen.index(f) in range(len(chosen)) and 1 if f in fs else 0 for f in chosen] for i, fs in rows if keep(i)), np.uint8)
    order = lambda x: x[np.array(sorted(range(len(x)), key=lambda r: np.flatnonzero(x[r]).tolist()))]
    x, every = order(lists(lambda i: i in toxic)), order(lists(lambda i: True))
    w, bias = toxicity.nnpu(x, every, prior)
    assert np.allclose(w, model.weights)
    zp, zu = x @ w + bias, every @ w + bias
    risks = {c: prior * (zp < c).mean() + max(0.0, (zu >= c).mean() - prior * (zp >= c).mean()) for c in [*(np.unique(zu) + 0.02), zu.min() - 1]}
    cut = bias - model.bias
    assert prior * (zp < cut).mean() + max(0.0, (zu >= cut).mean() - prior * (zp >= cut).mean()) <= min(risks.values()) + 2e-4
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert all(scores[i] == pytest.approx(1 / (1 + math.exp(-(model.bias + sum(model.weights[chosen.index(f)] for f in hashed(t) if f in chosen))))) for i, t in docs)


def plain_statistics(text):
    """The statistics of the quality classifier of one text, in plain Python."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    plain = re.findall(rb"(?:[A-Za-z0-9]|[\x80-\xff])+", raw)
    pairs = list(zip(plain, plain[1:], strict=False))
    n, k, m = len(raw), max(len(words), 1), max(len(plain), 1)
    among = lambda keep: sum(map(keep, raw))
    letters = max(among(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128), 1)
    most = max(collections.Counter(plain).values(), default=0)
    variety = lambda d, of: math.log1p(d) / max(math.log1p(of), 1e-9)
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(n / k), math.sqrt(among(lambda b: 65 <= b <= 90) / letters), math.sqrt(among(lambda b: 48 <= b <= 57) / max(n, 1)),
        math.sqrt(among(lambda b: 33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-?()") / max(n, 1)), math.sqrt(among(lambda b: chr(b) in ".?!;:") / max(n, 1)), math.sqrt(among(lambda b: b >= 128) / max(n, 1)),
        math.sqrt(raw.count(b"\n") / k), variety(len(set(plain)), m), math.sqrt(most / m), variety(len(set(pairs)), max(m - 1, 1)), math.sqrt(sum(a == b for a, b in pairs) / m),
        sum(len(w) <= 3 for w in words) / k, sum(len(w) >= 13 for w in words) / k, sum(len(w) == 1 for w in words) / k,
    ]


def test_quality_is_fitted_as_by_hand(spark):
    """All statistics of whole texts, and the fit from them, against plain versions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in docs] + ["", None, "a a a b", "Ünï cödé!\n\n漢字 x9", "one"]
    x = quality.statistics(*text_buffers(pa.array(texts)))
    want = np.array([plain_statistics(t) for t in texts])
    assert np.allclose(x, want)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.quality is not None}
    mine = [i for i, r in enumerate(docs) if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5]
    y = np.array([labels[docs[i].doc_id] for i in mine])
    model = quality.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert np.allclose(model.score(x), quality.Discriminant.fit(want[mine], y).score(want))


def test_steps_are_bounded_by_rows():
    texts = pa.RecordBatch.from_arrays([pa.array(["a b c d"] * 70_000)], ["text"])
    sizes = [b.num_rows for b in steps(texts, "text")]
    assert sum(sizes) == 70_000 and max(sizes) <= 1 << 15
    assert len(np.unique(np.concatenate([quality.statistics(*text_buffers(b.column("text"))) for b in steps(texts, "text")]), axis=0)) == 1


def test_spans_are_hashed_like_their_bytes():
    texts = ["", "ab cd ab", "cd  ab\n", None, "zz ab", "é ab é"]
    data, offsets = text_buffers(pa.array(texts))
    for keep in (ALNUM, VISIBLE):
        s, e, first = word_bounds(data, offsets, keep)
        words = [bytes(data[i:j]) for i, j in zip(s, e, strict=True)]
        assert [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == [(t or "").encode().split() for t in texts]
        h, p = span_hashes(data, s, e, (1,))
        assert len(set(h.tolist())) == len(set(words)) and len(set(zip(h.tolist(), words, strict=True))) == len(set(words))
        assert len(set(p.tolist())) == len({w[:1] for w in words})


def naive_winnow(text, k, w):
    kept = [(c.lower() if len(c.lower()) == 1 else c, i) for i, c in enumerate(text) if c.isalnum() or ord(c) >= 1 << 16]
    if not kept:
        return []
    k = min(k, len(kept))
    grams = ["".join(c for c, _ in kept[i : i + k]) for i in range(len(kept) - k + 1)]
    h = {g: int(winnowing.winnow(g, k, 1)[0][0]) for g in set(grams)}
    values, w = [h[g] for g in grams], min(w, len(grams))
    chosen = {max(j for j in range(i, i + w) if values[j] == min(values[i : i + w])) for i in range(len(grams) - w + 1)}
    return [(values[j], kept[j][1]) for j in sorted(chosen)]


@pytest.mark.parametrize("text", ["", "a", "Hello, World! " * 9, "aaaaaaaaaaaaaaaaaaaaaaaaa", "xyzzy " * 3 + "ÀÉ 漢字 😀 " * 6, "the cat sat on the mat and the cat sat on the mat again " * 4])
def test_winnowing_equals_the_definition(text, monkeypatch):
    for block in (1 << 19, 7):
        monkeypatch.setattr(winnowing, "BLOCK", block)
        for k, w in ((5, 4), (16, 32), (3, 1)):
            h, p = winnowing.winnow(text, k, w)
            assert list(zip(h.tolist(), p.tolist(), strict=True)) == naive_winnow(text, k, w)


def test_shared_passages_share_a_hash():
    rng = np.random.default_rng(7)
    make = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    for _ in range(50):
        same = make(winnowing.K + winnowing.W - 1)
        a, b = (set(winnowing.winnow(make(90) + same + make(80))[0].tolist()) for _ in range(2))
        assert a & b


def test_fingerprints_follow_the_order_of_ids(spark, edge_docs, no_docs):
    rng = np.random.default_rng(8)
    docs = {int(i): "".join(rng.choice(list("abc déf"), int(rng.integers(0, 300)))) for i in rng.choice(10_000, 2_500, replace=False)}
    got = {r.doc_id: r for r in winnowing.fingerprints(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    ids = sorted(docs)
    for i, nxt in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, u = docs[i], docs[nxt]
        edited = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        sets = [set(winnowing.winnow(x)[0].tolist()) for x in (t, edited, u)]
        like = lambda a, b: len(a & b) / len(a | b) if a and b else float(len(a) == len(b))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == winnowing.encode(*winnowing.winnow(t)) and r.edited_fingerprint == winnowing.encode(*winnowing.winnow(edited))
        assert r.near_edited == pytest.approx(like(sets[0], sets[1])) and r.near_next == pytest.approx(like(sets[0], sets[2]))
    rows = winnowing.fingerprints(edge_docs).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, (r.doc_id for r in edge_docs.collect())))
    assert winnowing.fingerprints(no_docs).count() == 0
    alone = winnowing.fingerprints(edge_docs.filter("doc_id = 8")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"one twoo"[:6] + b"o").hexdigest()


def brute_base(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [(i, [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower)), ("end",)]) for i, t in texts]
    c = collections.Counter(w for i, ws in toks if i is None or zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for i, w in toks]


@pytest.mark.parametrize("head", [1 << 19, 40])
def test_counts_and_base_scores_are_exact(spark, edge_docs, no_docs, monkeypatch, head):
    monkeypatch.setattr(bilinear, "HEAD", head)
    monkeypatch.setattr(bilinear, "FREQUENT", 20)
    got = bilinear.score_documents(edge_docs).collect()
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got))) == sorted(map(str, brute_base([(r.doc_id, r.text) for r in edge_docs.collect()])))
    assert all(r.score < 0 for r in got)
    assert bilinear.score_documents(no_docs).count() == 0


def test_model_is_normalised_and_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model, tail = bilinear.fit(docs)
    assert np.allclose((10.0 ** model.table.astype(np.float64)).sum(1), 1, atol=1e-4)
    rows = [r for r in bilinear.score(docs, model, tail).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) * 0.96


def test_scores_are_the_plain_sums(spark):
    """Every token's probability by the model's table, its share of a rare class and the weights of its context, in plain Python."""
    rng = np.random.default_rng(5)
    texts = {i: " ".join(f"w{int(rng.zipf(1.3)) % 400}" for _ in range(int(rng.integers(0, 60)))) for i in range(300)}
    texts[300], texts[301], texts[302] = texts[7], texts[8], None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model, tail = bilinear.fit(docs)
    rows = {r.doc_id: r for r in bilinear.score(docs, model, tail).collect()}
    table = model.table.astype(np.float64)
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 10}
    words = {i: (t or "").split() for i, t in texts.items()}
    c = collections.Counter(w for i in train for w in words[i])
    hashed = lambda w: span_hashes(np.frombuffer(w.encode(), np.uint8), np.zeros(1, int), np.array([len(w)]))[0]
    rare = lambda w: bilinear.tokens(pa.RecordBatch.from_arrays([pa.array([w])], ["text"]))[1]
    cls = {w: int(model.classes(hashed(w), rare(w))[0]) for ws in words.values() for w in ws}
    sampled = lambda a, b: len(bilinear.two_words(np.concatenate([hashed(a), hashed(b)]), np.array([0, 2]))[0])
    steps_of = {i: [(ws[j - 2], ws[j - 1], cls[ws[j]] if j < len(ws) else 0) for j in range(2, len(ws) + 1) if sampled(ws[j - 2], ws[j - 1])] for i, ws in words.items()}
    big, small = collections.Counter(x[:2] for i in train for x in steps_of[i]), collections.Counter(x for i in train for x in steps_of[i])
    assert sum(map(len, steps_of.values())) > 100
    for i, ws in words.items():
        order = [0, *(cls[w] for w in ws), 0]
        want = sum(table[a, b] for a, b in zip(order, order[1:], strict=False))
        want += sum(math.log10(c[w] + 0.1) - model.rare_norm[cls[w] - 1 - len(model.frequent)] for w in ws if cls[w] > len(model.frequent))
        own = collections.Counter(steps_of[i]), collections.Counter(x[:2] for x in steps_of[i])
        memory = 0.0
        for a, b, k in steps_of[i]:
            p = 10 ** table[cls[b], k]
            want += math.log10((small[a, b, k] / p + bilinear.DIRECT) / (big[a, b] + bilinear.DIRECT))
            mine = (own[0][a, b, k], own[1][a, b]) if i in train else (0, 0)
            memory += math.log10(((small[a, b, k] - mine[0]) / p + bilinear.DIRECT) / (big[a, b] - mine[1] + bilinear.DIRECT))
        assert rows[i].score == pytest.approx(want, rel=1e-3, abs=2e-3)
        assert rows[i].memory == pytest.approx(memory / max(len(steps_of[i]), 1), abs=2e-3)
    assert rows[300].score == pytest.approx(rows[7].score)


def test_texts_that_occur_elsewhere_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.memory for r in bilinear.score_documents(docs).collect()}
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.text].append(r.doc_id)
    once = [rows[ids[0]] for t, ids in texts.items() if len(ids) == 1 and t]  # near copies of others among them
    known = lambda ids, i: any(j != i and zlib.crc32(str(j).encode()) % 10 for j in ids)
    twice = [rows[i] for t, ids in texts.items() if len(ids) == 2 and len(t) > 600 for i in ids if known(ids, i)]
    assert np.mean(np.array(twice) > np.quantile(once, 0.85)) >= 0.8


def test_embedded_words_follow_the_corpus(spark):
    """Every word from the threshold on has vectors of its own, which tell it from the words of its class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    few, _ = bilinear.fit(docs.limit(100))
    model, _ = bilinear.fit(docs)
    texts = [r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 10]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    c = collections.Counter(w for t in texts for w in re.findall("[^\x20\x09-\x0d]+", t.translate(lower)))
    least = max(2, math.ceil(math.sqrt(sum(c.values()) + len(texts)) / bilinear.SPARSE))
    assert len(model.frequent) == sum(n >= least for n in c.values()) > 2 * bilinear.FREQUENT and len(few.frequent) < len(model.frequent)
    for vectors in (model.context, model.result[:, :-1]):  # equal only where words of a class have the same neighbours
        assert len(np.unique(vectors, axis=0)) > 0.98 * len(vectors)


def test_every_context_of_two_words_has_direct_weights(spark, monkeypatch):
    """None is left out by a hash, and buckets of any number, which blocks of documents meet in pieces, give the same sums."""
    hashes = np.random.default_rng(6).integers(1, 1 << 62, 100, dtype=np.uint64)
    place, ctx = bilinear.two_words(hashes, np.array([0, 60, 61, 100]))
    assert len(place) == 59 + 38 and len(set(ctx.tolist())) == 97
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{int(rng.zipf(1.3)) % 300}" for _ in range(int(rng.integers(0, 50)))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:20], "a b " * 400])), "doc_id long, text string").repartition(5)
    model, tail = bilinear.fit(docs)
    found = lambda: {r.doc_id: r for r in bilinear.score(docs, model, tail).collect()}
    want = found()
    monkeypatch.setattr(bilinear, "MET", 100)
    got = found()
    assert set(got) == set(want) and all(got[i].score == pytest.approx(want[i].score, rel=1e-5) and got[i].memory == pytest.approx(want[i].memory, abs=1e-5) for i in want)
    assert any(r.memory > 0 for r in want.values())
