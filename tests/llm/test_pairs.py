import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from textlineage.llm import jaccard, neighbours
from textlineage.llm.common import components, roots, text_buffers, text_words


def brute_jaccard(texts):
    """{doc_id: (class, links)} from word sets in plain Python."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[\u4e00-\u9fff]|(?:(?![\u4e00-\u9fff_])\w)+", (t or "").lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(texts)
    links = {i: {j for j in ids if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in ids}
    low = {i: i for i in ids}
    for _ in ids:
        low = {i: min([low[i], *(low[j] for j in links[i])]) for i in ids}
    return {i: (low[i], len(links[i])) for i in ids}


def test_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = {}
    for g in range(25):
        base = prose(rng, int(rng.integers(5, 120))).split()
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[rng.integers(len(w))] = f"e{rng.integers(50)}"
            texts[len(texts)] = " ".join(w)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_jaccard(texts)


def test_join_of_a_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = np.random.default_rng(3)
    base = prose(rng, 90).split()
    texts = {i: " ".join([*base[: 80 + i % 10], f"z{i}"]) for i in range(60)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_jaccard(texts)


def test_prefixes_shorten_until_the_target():
    d = jaccard.sure_depth()
    assert jaccard.meeting(0.8, d) >= jaccard.RECALL > jaccard.meeting(0.8, d + 1)
    with pytest.raises(ValueError):
        jaccard.sure_depth(trees=1)


def group_of(keys, n=100):
    """One subtrie of rows with these signatures, as the join deals them."""
    m = len(keys)
    t = pa.table({"keys": pa.array([k.view(np.int64).tolist() for k in keys]), "n": [n] * m, "_block": [0] * m, "tree": [0] * m, "_i": [0] * m, "_j": [0] * m})
    return jaccard.Subtries(t, np.array([0, m]))


def test_dense_subtries_lose_another_label(monkeypatch):
    """Rows of one subtrie in two halves that part at the fifth label: where the links found leave too many to be expected, the halves meet."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, (40, 32, 8), dtype=np.uint8)
    base[:] = base[0]
    noise = rng.random(base.shape) < 0.15
    noise[:, 0, :4] = False
    base[noise] = rng.integers(0, 256, int(noise.sum()), dtype=np.uint8)
    base[:20, 0, 4], base[20:, 0, 4] = 7, 9
    base[:, 1:, 0] = np.arange(40)[:, None]  # they meet in the first tree alone
    keys = np.ascontiguousarray(base[:, :, ::-1]).view(np.uint64)[:, :, 0]
    halves = lambda: {(bool(i < 20), bool(j < 20)) for _, _, pairs in group_of(keys).shortened(5) for a, b in pairs for i, j in zip(a, b, strict=True)}
    monkeypatch.setattr(jaccard, "MISSED", 1e9)
    assert halves() == {(True, True), (False, False)}
    monkeypatch.setattr(jaccard, "MISSED", 0.0)
    assert halves() == {(True, True), (False, False), (True, False)}


def test_each_pair_is_compared_in_one_tree():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 2, (30, 32, 8), dtype=np.uint8)
    labels[:, :, :4] = 3
    keys = np.ascontiguousarray(labels[:, :, ::-1]).view(np.uint64)[:, :, 0]
    m = len(keys)
    t = pa.table({"keys": pa.array([k.view(np.int64).tolist() for _ in range(32) for k in keys]), "n": [100] * m * 32, "_block": [0] * m * 32, "tree": np.repeat(range(32), m), "_i": [0] * m * 32, "_j": [0] * m * 32})
    seen = [(int(a) % m, int(b) % m) for _, _, pairs in jaccard.Subtries(t, np.arange(0, 33 * m, m)).shortened(4) for x, y in pairs for a, b in zip(x, y, strict=True)]
    assert sorted(seen) == [(i, j) for i in range(m) for j in range(i + 1, m)]


def test_words_of_any_script():
    words = lambda t: [bytes(np.frombuffer(t.encode(), np.uint8)[i:j]).decode() for i, j in zip(*text_words(*text_buffers(pa.array([t])))[:2], strict=True)]
    assert words("naïve a_b «été»\u3000x\u00a0y—z") == ["naïve", "a", "b", "été", "x", "y", "z"]
    assert words("漢字、abc カナ 한국어") == ["漢", "字", "abc", "カ", "ナ", "한국어"]
    assert words("e\u0301t 😀 𠀀𠀁") == ["e\u0301t", "𠀀", "𠀁"] and words("") == []


def test_near_copies_without_spaces_link(spark):
    rng = np.random.default_rng(6)
    base = "".join(chr(0x4E00 + rng.integers(500)) for _ in range(80))
    texts = {1: base, 2: base[:78] + "，終", 3: base[::-1]}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_jaccard(texts) == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_recall_is_audited(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, got = jaccard.audit(docs)
    assert want > 0 and got >= 0.9999 * want


def test_join_edge_cases(spark, edge_docs, no_docs):
    got = {}
    for r in jaccard.join(edge_docs).collect():
        got.setdefault(r.doc_id, set()).add((r.class_id, r.n_links))
    assert None not in got
    assert got[1] == got[2] == got[3] == {(1, 2)}
    assert got[4] == got[2**62] == {(4, 2)}  # the repeated row of 4 counts as a copy
    assert got[5] == {(5, 0)} and got[6] == {(6, 0)} and got[7] == {(7, 0)} and got[10] == {(10, 0)}
    assert got[8] == got[9] == {(8, 1)}
    assert got[11] == got[12] == {(11, 1)}
    assert jaccard.join(no_docs).count() == 0


def test_pipeline_keeps_one_row_of_each_class_where_ids_repeat(spark, edge_docs, no_docs):
    rng = np.random.default_rng(9)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    # 7's second text is a copy of 3's, its first is its own; 8 stands at two near copies, 9 at two texts without words.
    rows = [(7, a), (3, b), (7, b), (5, c), (8, d), (8, d + " tail"), (8, d), (9, "!"), (9, ""), (9, None)]
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    got = [(r.doc_id, r.text or "") for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    eight = [t for i, t in got if i == 8]
    assert len(eight) == 1 and eight[0] in (d, d + " tail")
    assert sorted(x for x in got if x[0] != 8) == sorted([(7, a), (3, b), (5, c), (9, "!"), (9, "")])
    kept = stage(spark, edge_docs, "")
    assert kept.columns == edge_docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert ids == [1, 4, 5, 6, 7, 8, 10, 11, 13, 14, 14] and kept.filter("doc_id is null").count() == 2
    assert stage(spark, no_docs, "").count() == 0


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(70)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    a, b = (np.array(x) for x in zip(*edges, strict=True))
    label = roots(301, a, b)
    assert got == {i: int(label[i]) for e in edges for i in e if e[0] != e[1] or i in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=5, groups=12, size=30, d=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = rng.normal(size=d)
        out += [base + rng.normal(size=d) * rng.choice([0.05, 0.2, 0.3]) for _ in range(size)]
    return np.array(out, np.float32)


def brute_cosine(x):
    x = x.astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    a, b = np.nonzero(linked)
    return linked.sum(1), roots(len(x), a, b)


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 60, "CELL": 80, "SHARD": 20}, {"BLOCK": 60, "CELL": 20, "CENTRES": 4, "SPLIT": 60, "SLICE": 50, "SHARD": 10}])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, limits):
    """In one cell, in cells of several blocks, and in cells cut again by pivots dealt in slices."""
    for name, value in limits.items():
        monkeypatch.setattr(neighbours, name, value)
    x = vectors()
    want, low = brute_cosine(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    result = neighbours.near_duplicates(df).cache()
    rows = result.collect()
    got = {r.vec_id: r for r in rows}
    found = sum(r.n_links for r in rows)
    assert want.sum() * 0.99 <= found <= want.sum()
    assert all(got[i].n_links <= want[i] and got[i].kept == (got[i].component_id == i) for i in got)
    assert np.mean([got[i].component_id == low[i] for i in got]) >= 0.99
    assert neighbours.audit(df, result, most=400) == (want.sum(), found)


def test_search_walks_the_united_lists():
    """A search finds what all cosines find, over rows of many shards, from the medoids alone, and computes few of the cosines."""
    rng = np.random.default_rng(2)
    x = neighbours.unit(rng.normal(size=(200, 24)).repeat(8, 0) + 0.15 * rng.normal(size=(1600, 24))).astype(np.float32)
    lists, medoids = neighbours.flat_graph(x)
    assert len(medoids) >= 6 and lists.max() < 1600
    truth = x @ x.T >= 0.95 - neighbours.SLACK
    count, plain = [0], neighbours.cosines

    def counted(x, a, b):
        count[0] += len(a)
        return plain(x, a, b)

    neighbours.cosines = counted
    try:
        found = neighbours.search(x, lists, medoids, np.arange(1600), neighbours.BEAM)
    finally:
        neighbours.cosines = plain
    assert not (found & ~truth).any() and found.sum() >= 0.99 * truth.sum()
    assert count[0] < 0.5 * x.shape[0] ** 2


def test_groups_of_near_copies_are_found_whole():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=16) + 0.03 * rng.normal(size=(900, 16)), rng.normal(size=(300, 16))])
    u = neighbours.unit(x)
    truth = u @ u.T >= 0.95
    np.fill_diagonal(truth, False)
    assert (neighbours.linked_rows(x, np.arange(1200)) == truth).all()
    assert (neighbours.linked_rows(x, np.arange(850, 1000)) == truth[850:1000]).all()


def test_refined_cells_keep_every_row(spark, monkeypatch):
    for name, value in {"CELL": 20, "CENTRES": 4, "SPLIT": 60, "SLICE": 50}.items():
        monkeypatch.setattr(neighbours, name, value)
    x = vectors()
    # A large cell, one of near copies only, and a small one. Half of the rows are another cell's.
    cell = [0] * 240 + [1] * 90 + [2] * 30
    x[240:330] = x[240] + x[240:330] * 1e-3
    length = 16 << neighbours.CELL_BITS
    placed = spark.createDataFrame([(s + length, i % 2 == 0, i, 1, v.tolist()) for i, (s, v) in enumerate(zip(cell, x, strict=True))], "cell long, own boolean, node long, copies long, embedding array<double>")
    rows = neighbours.refined(placed, placed.groupBy("cell").count().withColumnRenamed("count", "m")).collect()
    assert {r.node for r in rows} == set(range(360)) and len({(r.cell, r.node) for r in rows}) == len(rows)
    assert sorted(r.node for r in rows if r.own) == list(range(0, 360, 2))
    parts = [len({r.cell for r in rows if r.node in range(lo, hi)}) for lo, hi in ((0, 240), (240, 330), (330, 360))]
    assert parts[0] > 2 and parts[1:] == [1, 1] and all(r.cell >> neighbours.CELL_BITS == 16 for r in rows)


def test_vector_edge_cases(spark):
    n = float("nan")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [2.0, 0.1], 1), (4, [0.0, 1.0], 1), (5, None, 1), (6, [0.0, 0.0], 1), (7, [n, 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [None, 1.0], 1), (10, [1.0], 1), (11, [], 1), (None, [1.0, 0.0], 1), (4, [0.0, 1.0], None), (12, [-1.0, -0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect()), key=str)
    want = [(0, 0, None, False), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True), (12, 0, 12, True), *[(i, 0, i, True) for i in range(5, 12)]]
    assert got == sorted(want, key=str)
    unlike = [(4, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 0.01]), (6, [0.01, 1.0]), (7, [0.0, 2.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.01, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_duplicates(spark.createDataFrame(unlike, "vec_id long, embedding array<double>")).collect())
    assert got == [(4, 1, 4), (4, 2, 4), (5, 1, 4), (6, 2, 4), (7, 2, 4), (8, 1, 8), (9, 1, 8)]
    assert neighbours.near_duplicates(df.limit(0)).count() == 0
    assert neighbours.near_duplicates(df.filter("vec_id in (5, 6)")).count() == 2


def test_of_rows_equal_in_id_and_text_a_fixed_one_stays(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "en", s, n) for s, n in (("b", 1), ("a", 9), ("a", 3), (None, 5))] + [(2, text, "en", "a", 1), (3, None, "fr", "z", 2), (3, "", "de", "y", 1)]
    want = {(1, text, "en", None, 5), (3, "", "de", "y", 1)}
    for n in (1, 5):
        docs = spark.createDataFrame(rows[::-1] if n > 1 else rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        assert {tuple(r) for r in jaccard.one_of_each_class(docs).collect()} == want


def test_copies_of_vectors_are_dealt_from_one_table(spark, monkeypatch):
    """No table holds a vector once for each cell, and components given as floats stay floats on their way."""
    tables, plain = {}, neighbours.cut

    def noted(df, name):
        out = plain(df, name)
        tables[name] = (out.count(), out.schema)
        return out

    monkeypatch.setattr(neighbours, "cut", noted)
    monkeypatch.setattr(neighbours, "CELL", 20)
    x = vectors()
    neighbours.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    held = {name: (n, schema["embedding"].dataType.elementType.simpleString()) for name, (n, schema) in tables.items() if "embedding" in schema.names}
    assert held == {"vector-nodes": (len(x), "float")}


def test_embeddings_are_told_apart_by_value_and_place():
    rows = [[1.0, 2.0], [2.0, 1.0], [1.0, 2.0], [0.0, 1.0], [-0.0, 1.0], [1.0, 2.0, 0.0], None, [], [0.0], [float("nan")], [1.0, None], [float("-inf")], [1.0], [2.0]]
    good, h1, h2 = neighbours.hashes(pa.array(rows, pa.list_(pa.float32())))
    assert good.tolist() == [True] * 6 + [False] * 6 + [True] * 2
    keys = list(zip(h1.tolist(), h2.tolist(), strict=True))
    assert keys[0] == keys[2] and keys[3] == keys[4] and len({keys[i] for i in (0, 1, 3, 5, 12, 13)}) == 6
    assert keys[:6] == list(zip(*(h.tolist() for h in neighbours.hashes(pa.array(rows[:6], pa.list_(pa.float64())))[1:]), strict=True))


def test_highest_cosines_come_first():
    s = np.random.default_rng(6).normal(size=(40, 90)).clip(-1, 1).astype(np.float32)
    s[:, 30:50] = s[:, 10:30]
    for k in (1, 4, 12, 90):
        assert (neighbours.nearest(s, k) == np.argsort(-s, axis=1, kind="stable")[:, :k]).all()


def test_pairs_of_a_shard_are_known_beforehand():
    """What the cosines of a shard say needs no walk: a search that may walk from one row only finds them all the same."""
    rng = np.random.default_rng(9)
    x = neighbours.unit(rng.normal(size=(300, 24)).repeat(2, 0) + 0.05 * rng.normal(size=(600, 24))).astype(np.float32)
    truth = x @ x.T >= 0.95 - neighbours.SLACK
    known = np.zeros((600, 600), bool)
    lists, medoids = neighbours.flat_graph(x, known)
    assert not (known & ~truth).any() and known.sum() >= 0.99 * truth.sum()
    assert (neighbours.search(x, lists, medoids, np.arange(600), 1, known=known) & truth).sum() >= 0.99 * truth.sum()
