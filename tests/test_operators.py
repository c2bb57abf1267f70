"""Hand-computed fixture and invariants of the lineage."""

import pytest
from pyspark.sql import functions as F

from textlineage.config import Settings
from textlineage.operators import pairs, prune, stats, vocab
from textlineage.plans.lineage import Lineage, single_year

M1 = [("d1", 2010, "a b"), ("d2", 2010, "a c"), ("d3", 2011, "a b d"), ("d4", 2011, "c d d"), ("d5", 2012, "b d e"), ("d6", 2012, "a c")]


@pytest.fixture(scope="module")
def m1(spark):
    tokens = spark.createDataFrame([(i, y, i, t.split()) for i, y, t in M1], "id string, yr int, title string, tokens array<string>")
    return Lineage(tokens, Settings(min_term_count=1, max_doc_freq_ratio=0.9, window_size=2, use_filtered_vectors=False), keep=True)


def test_fixture_vectors(m1):
    got = {(r.id, r.term): round(r.w, 6) for r in m1.vectors.collect()}
    assert got == {
        ("d1", "a"): 0, ("d1", "b"): 0, ("d2", "a"): 0, ("d2", "c"): 0, ("d3", "a"): -0.50492, ("d3", "b"): 0, ("d3", "d"): 0.863166, ("d4", "c"): 0, ("d4", "d"): 1,
        ("d5", "b"): 0.199121, ("d5", "d"): 0.199121, ("d5", "e"): 0.959532, ("d6", "a"): 0, ("d6", "c"): 1,
    }


def test_fixture_scores(m1):
    got = {r.id: (round(r.bs, 8), round(r.fs, 8), round(r.q, 3)) for r in m1.quality.collect()}
    assert got["d3"][:2] == (0, 0.17187443) and got["d4"][:2] == (0, 0.19912089) and got["d5"][:2] == (0.37099532, 0)
    assert got["d3"][2] == pytest.approx(17187442.594, rel=1e-6) and all(got[i] == (0, 0, 0) for i in ("d1", "d2", "d6"))
    assert m1.sims.count() == 10
    assert sum(v[0] for v in got.values()) == pytest.approx(sum(v[1] for v in got.values()))


def test_fixture_pair_sums(m1):
    got = {(r.yr_1, r.yr_2): r.s for r in stats.df_pair_sum(m1.term_df, m1.docs.select("yr")).collect()}
    half = {(2010, 2010): 6, (2010, 2011): 4, (2010, 2012): 4, (2011, 2011): 7, (2011, 2012): 5, (2012, 2012): 5}
    assert got == half | {(b, a): v for (a, b), v in half.items()}


def test_single_year_equals_the_whole(m1):
    flat = lambda rows: {(r.id, k): round(r[k], 12) for r in rows if r.yr == 2011 for k in ("bs", "fs")}
    assert flat(single_year(m1.base, m1.vector_docs, 2011, m1.s).collect()) == flat(m1.scores.collect())


def test_threshold_is_inclusive(spark):
    v = spark.createDataFrame([("a", 2000, 0, 0.5), ("b", 2001, 0, 0.1), ("c", 2006, 0, 1.0)], "id string, yr int, term_id int, w double")
    sims = pairs.pair_similarity(v, 5)
    assert {(r.id_x, r.id_y) for r in pairs.hits(sims, 0.05).collect()} == {("a", "b"), ("b", "c")}  # a and c are 6 years apart
    assert pairs.hits(pairs.prefix_similarity(v, 5, 0.05), 0.05).count() == pairs.hits(pairs.bounded_similarity(v, 5, 0.05), 0.05).count() == 2


def signed(spark, seed=4):
    import random

    rng = random.Random(seed)
    rows = [(f"d{i}", 2000 + i % 4, t, rng.choice([rng.uniform(-1, 1), rng.uniform(0, 0.1)])) for i in range(40) for t in rng.sample(range(12), 5)]
    return spark.createDataFrame([*rows, ("p", 2000, 90, -0.9), ("q", 2001, 90, -0.8), ("z", 2002, 90, 0.0)], "id string, yr int, term_id int, w double").cache()


@pytest.mark.parametrize("join", [pairs.prefix_similarity, pairs.bounded_similarity])
def test_bounds_hold_with_weights_of_any_sign(spark, join):
    """Rare terms of negative weight on both sides make hits, as do frequent ones."""
    v = signed(spark)
    for threshold in (0.05, 0.5, 0.0):
        want = {(r.id_x, r.id_y, round(r.sim, 9)) for r in pairs.hits(pairs.pair_similarity(v, 2), threshold).collect()}
        got = {(r.id_x, r.id_y, round(r.sim, 9)) for r in pairs.hits(join(v, 2, threshold), threshold).collect()}
        assert got == want and ("p", "q", 0.72) in got


def test_bounded_join_computes_fewer_products(spark):
    """Every candidate stays in the count, with its products, though a bound drops it; sides of hits are the same under each strategy."""
    import random

    rng = random.Random(1)
    rows = []
    for i in range(120):
        w = {t: rng.random() ** 4 for t in rng.sample(range(40), 12)}
        norm = sum(x * x for x in w.values()) ** 0.5
        rows += [(f"d{i}", 2000 + i % 5, t, x / norm) for t, x in w.items()]
    v = spark.createDataFrame(rows, "id string, yr int, term_id int, w double").cache()
    native, bounded = pairs.pair_similarity(v, 5).cache(), pairs.bounded_similarity(v, 5, 0.6).cache()
    key = lambda df: {(r.id_x, r.id_y): round(r.sim, 9) for r in pairs.hits(df, 0.6).collect()}
    assert key(native) == key(bounded) and len(key(native)) > 50
    count = lambda df: df.agg(F.sum("n_terms").alias("n"), F.count("*").alias("pairs"), F.count("sim").alias("verified")).first()
    all_, some = count(native), count(bounded)
    assert some.n < 0.5 * all_.n and some.verified < some.pairs < all_.pairs
    flat = lambda sims: {(r.yr_x, r.yr_y, r.side, r.id): (round(r.contrib, 9), r.hits) for r in pairs.pair_sides(sims, 0.6).filter("hits > 0").collect()}
    assert flat(native) == flat(bounded) == flat(pairs.prefix_similarity(v, 5, 0.6))
    touched = {r.side: r.n for r in pairs.pair_sides(bounded, 0.6).groupBy("side").agg(F.sum("touched").alias("n")).collect()}
    assert touched == {"x": some.pairs, "y": some.pairs}


def test_bucketed_lists_are_joined_without_a_shuffle(spark, tmp_path):
    """Written once, opened again by path: pairs are those of the vectors, the plan's one exchange adds up pairs; with terms over the limit too."""
    from textlineage.sources import artifacts

    v = signed(spark, 6)
    want = {(r.id_x, r.id_y, r.n_terms, round(r.sim, 9)) for r in pairs.pair_similarity(v, 2).collect()}
    path = f"file://{tmp_path}/lists"
    artifacts.write_bucketed(pairs.postings(v, most=4), "lists_once", path, 4)
    spark.sql("DROP TABLE lists_once")  # the files stay
    try:
        lists = artifacts.open_bucketed(spark, "lists_again", path, 4)
        found = pairs.list_similarity(lists, 2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and "hashpartitioning(yr_x" in plan
        for most in (pairs.PRODUCTS, 40):
            assert {(r.id_x, r.id_y, r.n_terms, round(r.sim, 9)) for r in pairs.list_similarity(lists, 2, most).collect()} == want
    finally:
        spark.sql("DROP TABLE IF EXISTS lists_again")


def test_heavy_terms_are_split_by_their_products(spark):
    """100,000 documents of a year share a term with 3,000 of a later one, and with 2 of another: no key has more than a task's products, and nothing is lost."""
    x = spark.range(100_000).select(F.concat(F.lit("x"), "id").alias("id_x"), F.lit(2000).alias("yr_x"), F.lit(7).alias("term_id"), F.lit(0.5).alias("w_x"))
    y = spark.range(3_000).select(F.concat(F.lit("y"), "id").alias("id_y"), F.lit(2001).alias("yr_y"), F.lit(7).alias("term_id"), F.lit(0.5).alias("w_y"))
    y = y.unionByName(y.limit(2).withColumn("yr_y", F.lit(2002)))
    years = spark.createDataFrame([(2000, 2001), (2000, 2002)], "yr_x int, yr_y int")
    most = 20_000_000
    a, b, keys = pairs.split_keys(x.join(years, "yr_x"), y, pairs.KEYS, most)
    assert len(keys) == 4
    met = a.groupBy(*keys).agg(F.count("*").alias("nx")).join(b.groupBy(*keys).agg(F.count("*").alias("ny")), keys).select(*keys, (F.col("nx") * F.col("ny")).alias("n")).collect()
    assert sum(r.n for r in met) == 100_000 * 3_002 and max(r.n for r in met) < 1.1 * most and len(met) >= 16
    assert pairs.split_keys(x.join(years, "yr_x"), y, pairs.KEYS, 10**9)[2] == pairs.KEYS


def test_split_joins_give_the_same_pairs(spark):
    v = signed(spark, 9)
    for join in (lambda m: pairs.pair_similarity(v, 2, m), lambda m: pairs.prefix_similarity(v, 2, 0.2, m), lambda m: pairs.bounded_similarity(v, 2, 0.2, m)):
        flat = lambda df: sorted((r.id_x, r.id_y, r.n_terms, None if r.sim is None else round(r.sim, 9)) for r in df.collect())
        assert flat(join(3)) == flat(join(10**9)), join


def test_similarity_joins_by_year_and_term(spark, m1):
    plan = pairs.pair_similarity(m1.base, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert any("yr_y" in line and "term_id" in line and line.count(" = ") >= 2 for line in plan.splitlines() if "Join Inner" in line)


def test_counts_are_added_up_before_the_shuffle(spark):
    rows = spark.createDataFrame([("a", 2000, "x", 1)], "id string, yr int, term string, tf long")
    plan = vocab.term_df_year(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("count(1)") < plan.index("Exchange") < plan.index("partial_count(1)")  # the last step stands first


def test_years_run_in_order(spark):
    years = spark.createDataFrame([(2003,), (2001,), (2009,), (2002,)], "yr int")
    got = [tuple(r) for r in pairs.year_pairs(years, 2).orderBy("yr_x", "yr_y").collect()]
    assert got == [(2001, 2002), (2001, 2003), (2002, 2003)] and pairs.year_pairs(years, 0).count() == 0


def test_sides_give_scores_and_meta(m1):
    sides = pairs.pair_sides(m1.sims, m1.s.similarity_threshold)
    flat = lambda df: {(r.id, round(r.bs, 12), round(r.fs, 12)) for r in df.collect()}
    assert flat(pairs.side_scores(m1.vector_docs, sides)) == flat(m1.scores)
    meta = {(r.yr_x, r.yr_y): r for r in pairs.pair_meta(sides, m1.vector_docs, m1.year_pairs, thr=0.05, method_version="v1").collect()}
    assert set(meta) == {(2010, 2011), (2010, 2012), (2011, 2012)} and sum(r.hits for r in meta.values()) == m1.hits.count() and meta[2010, 2011].thr == 0.05
    diag = {(r.yr_x, r.yr_y): r for r in pairs.pair_diagnostics(sides, m1.vector_docs, m1.year_pairs).collect()}
    assert set(diag) == set(meta) and all(diag[k].touched_avg == pytest.approx(meta[k].avg_touched) for k in meta)


def test_inverted_lists_in_parts(spark):
    v = spark.createDataFrame([(f"d{i:03d}", 2000, t, float(i + t)) for i in range(50) for t in (1, 2) if t == 1 or i < 3], "id string, yr int, term_id int, w double")
    lists = pairs.postings(v, most=8).collect()
    assert max(len(r.docs) for r in lists) < 30 and len(lists) > 4 and {(r.term_id, r.n_docs, r.max_w) for r in lists} == {(1, 50, 50.0), (2, 3, 4.0)}
    assert sorted(map(tuple, pairs.entries(pairs.postings(v, most=8)).collect())) == sorted(map(tuple, v.collect()))


def test_long_word_lists_are_joined(spark, monkeypatch):
    tokens = spark.createDataFrame([("a", 2000, ["x", "y", "x", "z"]), ("b", 2000, ["y"]), ("c", 2001, []), ("d", 2001, ["z", "z"])], "id string, yr int, tokens array<string>")
    words = spark.createDataFrame([("y",), ("q",), ("y",)], "term string")
    want = {"a": ["x", "x", "z"], "b": [], "c": [], "d": ["z", "z"]}
    for most in (1_000, 1):
        monkeypatch.setattr(vocab, "MOST_LISTED", most)
        assert {r.id: r.tokens for r in vocab.without_words(tokens, words).collect()} == want


def test_dense_ids_follow_code_points(spark):
    words = ["a", "ab", "abc", "abcd", "abce", "b", "电", "电池", "电池组", "电路", "é", "😀", "z", "zz"]
    got = {r.term: r.term_id for r in vocab.dense_ids(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words, key=lambda w: w.encode()))}


def test_dense_ids_of_one_prefix_are_ranged(spark):
    """Terms that all begin alike: no range has more than a few times its share, and ids are those of one sort."""
    n, most = 40_000, 2_500
    terms = spark.range(n).select(F.concat(F.lit("电池组"), F.md5(F.col("id").cast("string"))).alias("term")).cache()
    words = [r.term for r in terms.collect()]
    got = {r.term: r.term_id for r in vocab.dense_ids(terms, most=most).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words, key=lambda w: w.encode()))}
    bounds = sorted(words)[:: n // 9][1:9]
    ranges = {r.n: r["count"] for r in terms.select(vocab.range_of(F.col("term"), bounds).alias("n")).groupBy("n").count().collect()}
    import bisect
    from collections import Counter

    assert ranges == Counter(bisect.bisect_left(bounds, w) for w in words)
    sample = [r.term for r in terms.orderBy(F.xxhash64("term"), "term").limit(vocab.SAMPLED * 16).collect()]
    cuts = sorted(sample)[vocab.SAMPLED - 1 :: vocab.SAMPLED][:15]
    sizes = Counter(bisect.bisect_left(cuts, w) for w in words)
    assert len(sizes) == 16 and max(sizes.values()) < 2 * most


def test_pair_sums_need_one_exchange_by_term(spark):
    rows = spark.createDataFrame([("a", 2000, 1), ("a", 2003, 2), ("b", 2003, 5), ("a", 2009, 7)], "term string, yr int, df long")
    years = rows.select("yr").distinct()
    got = {(r.yr_1, r.yr_2): r.s for r in stats.df_pair_sum(rows, years).collect()}
    assert got == {(2000, 2000): 1, (2003, 2003): 29, (2009, 2009): 49, (2000, 2003): 2, (2003, 2000): 2}
    plan = stats.df_pair_sum(rows, years)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(term") == 1


def test_kept_stages_are_released(spark):
    tokens = spark.createDataFrame([(i, y, i, t.split()) for i, y, t in M1], "id string, yr int, title string, tokens array<string>")
    x = Lineage(tokens, Settings(min_term_count=1, max_doc_freq_ratio=0.9), keep=True)
    x.vectors.count()
    assert x.vectors.is_cached
    x.release()
    assert not x.vectors.is_cached and not x.counts.is_cached


def test_reports_are_whole_or_refused(spark):
    assert stats.report(spark.range(3).withColumnRenamed("id", "yr"), {"yr": 4}).count("\n") == 4
    with pytest.raises(ValueError):
        stats.report(spark.range(3).withColumnRenamed("id", "yr"), {"yr": 4}, most=2)


def test_top_k_variants(spark):
    v = spark.createDataFrame([("a", 2000, t, i, w) for i, (t, w) in enumerate([("p", 0.5), ("q", 0.5), ("r", -0.9), ("s", 0.0), ("t", 0.1)])], "id string, yr int, term string, term_id int, w double")
    names = lambda df: sorted(r.term for r in df.collect())
    assert names(prune.top_k_terms(v, 1)) == ["p"] and names(prune.top_k_terms(v, 4)) == ["p", "q", "t"] and names(prune.top_k_terms(v, 9)) == ["p", "q", "r", "t"]
    assert names(prune.top_k_terms(v, 0)) == [] and len(names(prune.top_k_terms(v, 0, True))) == 5


def test_pruning_order(spark):
    """A term removed by ratio doesn't use the quota of the most frequent."""
    term_df = spark.createDataFrame([(2000, f"t{i:02d}", 10 - i if i < 5 else 1) for i in range(20)], "yr int, term string, df long")
    docs = spark.createDataFrame([(2000, 45)], "yr int, docs long")
    words = vocab.vocabulary(term_df, docs, 1, 1.0)
    ratio = prune.ratio_columns(term_df, docs, words, 0.2)
    top = prune.top_df_columns(term_df, words, ratio, 0.1)
    assert sorted(r.term for r in ratio.collect()) == ["t00", "t01"] and sorted(r.term for r in top.collect()) == ["t02", "t03"]  # 9/45 is exactly 0.2
    assert [r.term_id for r in words.orderBy("term").collect()] == list(range(20))


def test_documents_without_terms(spark):
    tokens = spark.createDataFrame([("a", 2000, "", ["x"]), ("b", 2001, "", []), ("c", 2001, "", ["rare"]), ("d", 2002, "", ["x", "x"])], "id string, yr int, title string, tokens array<string>")
    x = Lineage(tokens, Settings(min_term_count=2, max_doc_freq_ratio=1.0, use_filtered_vectors=False))
    assert {r.yr: r.docs for r in x.docs.collect()} == {2000: 1, 2001: 1, 2002: 1}
    assert {r.yr: r.docs for r in vocab.docs_per_year_all(tokens).collect()} == {2000: 1, 2001: 2, 2002: 1}
    assert sorted(r.id for r in x.scores.collect()) == ["a", "d"]


def test_histogram_keeps_empty_bins_and_the_total(spark):
    lengths = spark.createDataFrame([("a", 2000, 0), ("b", 2000, 1000), ("c", 2000, 2000)], "id string, yr int, n long")
    got = {r.lo: (r.n, round(r.pct, 3)) for r in stats.row_length_histogram(lengths).collect()}
    assert got[0] == (1, 33.333) and got[100] == (1, 33.333) and got[5] == (0, 0) and len(got) == 7


def test_stream_equals_batch(spark, tmp_path):
    from textlineage.functions.tokenize import regex_words
    from textlineage.streaming.ingest import stream_term_df

    rows = spark.createDataFrame([(y, t) for _, y, t in M1], "yr int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    q = stream_term_df(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), regex_words).writeStream.format("memory").queryName("stream_df").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.yr, r.term): r.df for r in spark.table("stream_df").collect()}
    assert got[2011, "d"] == 2 and got[2010, "a"] == 2 and len(got) == 12


def test_counts_need_no_shuffle_and_add_up_rows_of_one_id(spark, monkeypatch):
    rows = [("a", 2000, ["x", "y", "x", ""]), ("b", 2000, []), ("c", 2001, ["z"] * 5 + ["x"]), ("d", 2001, ["y"])]
    tokens = spark.createDataFrame(rows, "id string, yr int, tokens array<string>")
    want = {("a", "x", 2), ("a", "y", 1), ("a", "", 1), ("c", "z", 5), ("c", "x", 1), ("d", "y", 1)}
    flat = lambda df: {(r.id, r.term, r.tf) for r in df.collect()}
    assert flat(vocab.term_counts(tokens)) == flat(vocab.term_counts(tokens, dealt=True)) == want
    plan = vocab.term_counts(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan and plan.count("ArrowEvalPython") == 1
    twice = tokens.unionByName(spark.createDataFrame([("a", 2000, ["x"])], tokens.schema))
    assert flat(vocab.term_counts(twice)) == want - {("a", "x", 2)} | {("a", "x", 3)}
    df = lambda found: {(r.yr, r.term): r.df for r in found.collect()}
    for t in (tokens, twice):
        assert df(vocab.term_df(t)) == df(vocab.term_df_year(vocab.term_counts(t)))
    few = vocab.counted.func
    monkeypatch.setattr(vocab, "STEP", 2)
    import pyarrow as pa

    got = few(pa.array([t for _, _, t in rows], pa.list_(pa.string()))).to_pylist()
    assert [dict(zip(r["terms"], r["tfs"], strict=True)) for r in got] == [{"x": 2, "y": 1, "": 1}, {}, {"z": 5, "x": 1}, {"y": 1}]


def test_wide_stages_are_not_kept(spark):
    tokens = spark.createDataFrame([(i, y, i, t.split()) for i, y, t in M1], "id string, yr int, title string, tokens array<string>")
    x = Lineage(tokens, Settings(min_term_count=1, max_doc_freq_ratio=0.9), keep=True, wide=False)
    x.vectors.count()
    assert not x.vectors.is_cached and not x.counts.is_cached and x.term_df.is_cached
    x.release()


@pytest.mark.parametrize("strategy", ["native", "prefix", "bounded"])
def test_blocks_give_the_pairs_of_the_term_join(spark, monkeypatch, strategy):
    """Whatever the blocks' sizes and the steps', with no shuffle of products; sums by document are those of the pairs."""
    from textlineage.operators import blocks

    v = signed(spark, 5)
    native = pairs.pair_similarity(v, 2)
    key = lambda df: {(r.yr_x, r.yr_y, r.id_x, r.id_y, round(r.sim, 9)) for r in df.collect()}
    want = key(pairs.hits(native, 0.3))
    for size in (7, 10**6):
        assert key(blocks.similarity(v, 2, 0.3, strategy, hits=True, earlier=size, most=2 * size)) == want
        found = blocks.similarity(v, 2, 0.3, strategy, earlier=size, most=2 * size)
        if strategy == "native":
            full = lambda df: {(r.id_x, r.id_y, r.n_terms, round(r.sim, 9)) for r in df.collect()}
            assert full(found) == full(native)
        flat = lambda df: {(r.yr_x, r.yr_y, r.side, r.id, round(r.contrib, 9), r.hits, r.touched, r.ops) for r in df.collect()}
        assert flat(blocks.sides(v, 2, 0.3, strategy, earlier=size, most=2 * size)) == flat(pairs.pair_sides(found, 0.3))
    plan = blocks.similarity(v, 2, 0.3, strategy)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(yr_x" not in plan
    assert blocks.similarity(v.filter("yr = 2000"), 2, 0.3, strategy).count() == 0


def test_vectors_are_shuffled_once_however_many_blocks_they_meet(spark):
    """Rows written to shuffles don't grow with the blocks, and rows that are packed already aren't put together again."""
    from textlineage.operators import blocks
    from textlineage.plans.metrics import StageWatch

    v = signed(spark, 7)
    lists = blocks.packed(v).coalesce(1).cache()
    rows, got = {}, {}
    for name, source, size in (("one", v, 10**6), ("many", v, 20), ("packed", lists, 20)):
        lists.count()
        with StageWatch(spark) as w:
            got[name] = {(r.id_x, r.id_y, r.n_terms, round(r.sim, 9)) for r in blocks.similarity(source, 2, 0.3, earlier=size, most=size).collect()}
        rows[name] = sum(dict(zip(w.table().columns, r, strict=True))["rows_out"] for r in w.rows)
    assert got["one"] == got["many"] == got["packed"] == {(r.id_x, r.id_y, r.n_terms, round(r.sim, 9)) for r in pairs.pair_similarity(v, 2).collect()}
    assert rows["one"] == rows["many"]
    docs = {r.yr: r.n for r in lists.groupBy("yr").agg(F.count("*").alias("n")).collect()}
    assert rows["packed"] == sum(n for y, n in docs.items() if y < 2003) + sum(n for y, n in docs.items() if y > 2000)
    lists.unpersist()


def bounds_by_hand(rows, window, threshold):
    """What is left to add, candidates and those ruled out, a document and pair of years."""
    docs, top = {}, {}
    for i, y, t, w in rows:
        docs.setdefault((i, y), {})[t] = w
        top[y, t] = max(top.get((y, t), -9), w)
    years, out = {y for _, y in docs}, {}
    for (i, y), own in docs.items():
        for later in sorted(z for z in years if y < z <= y + window):
            bound = {t: round(w * top.get((later, t), 0.0), 12) for t, w in own.items()}
            order = sorted(own, key=lambda t: (-bound[t], t))
            left = [round(sum(bound.values()) - sum(bound[t] for t in order[: k + 1]), 9) for k in range(len(order))]
            left[-1] = 0.0
            above = sum(v > 0 for v in left)
            touched = dead = 0
            for (_, z), other in docs.items():
                shared = [k for k, t in enumerate(order) if t in other]
                if z != later or not shared:
                    continue
                touched += 1
                has = [sum(own[t] * other.get(t, 0.0) for t in order[: k + 1]) for k in range(len(order))]
                dead += any(round(has[k] + left[k], 9) < threshold for k in range(shared[0], min(len(order), above)))
            out[y, later, i] = (round(sum(bound.values()), 6), *[round(left[k - 1], 6) if len(left) >= k else 0.0 for k in (1, 3, 5, 10)], touched, dead)
    return out


def test_bounds_by_blocks_are_those_by_hand(spark):
    """Whatever the blocks' sizes, for weights of any sign, with no shuffle of products."""
    from textlineage.operators import blocks

    v = signed(spark, 6)
    rows = [tuple(r) for r in v.collect()]
    for threshold in (0.05, 0.5):
        want = bounds_by_hand(rows, 2, threshold)
        for size in (7, 10**6):
            got = {(r[0], r[1], r[2]): (*[round(x, 6) + 0.0 for x in r[3:8]], r.touched, r.dead) for r in blocks.bounds(v, 2, threshold, earlier=size, most=2 * size).collect()}
            assert {k: tuple(x + 0.0 for x in w) for k, w in want.items()} == got
    plan = blocks.bounds(v, 2, 0.05)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "id_y" not in plan


def test_words_are_the_matches_of_the_expression(monkeypatch):
    """Whatever the steps; runs end with their text, null stays null."""
    import random
    import re

    import pyarrow as pa

    from textlineage.functions import tokenize

    rng = random.Random(1)
    for step in (4, 1 << 20):
        monkeypatch.setattr(tokenize, "STEP", step)
        for _ in range(100):
            texts = [None if rng.random() < 0.1 else "".join(rng.choice("ab zé0中A-") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 7))]
            want = [None if t is None else re.findall("[a-z]+", t) for t in texts]
            assert tokenize.letter_runs.func(pa.array(texts, pa.string())).to_pylist() == want
            assert tokenize.letter_runs.func(pa.array(texts, pa.string()).slice(2)).to_pylist() == want[2:]


def test_tables_of_a_row_a_year_are_listed(spark):
    """Their plans hold none of the stages that they were made from, also without rows."""
    tokens = spark.createDataFrame([(i, y, i, t.split()) for i, y, t in M1], "id string, yr int, title string, tokens array<string>")
    for rows in (tokens, tokens.limit(0)):
        x = Lineage(rows, Settings(min_term_count=1, max_doc_freq_ratio=0.9), keep=True, wide=False)
        assert {tuple(r) for r in x.docs.collect()} == {tuple(r) for r in vocab.docs_per_year(rows).collect()}
        assert x.docs.schema.simpleString() == "struct<yr:int,docs:bigint>"
        assert "Aggregate" not in x.docs._jdf.queryExecution().optimizedPlan().toString()
        x.release()


def test_vectors_in_rows_are_those_of_the_joins(spark, monkeypatch):
    """Whatever the steps, also where ids repeat or documents are empty, and where arrays would be too long; the vectors need no shuffle."""
    import random

    from textlineage.operators import weight

    rng = random.Random(8)
    rows = [(f"d{i}", 2010 + i % 4, f"d{i}", [rng.choice("abcdefghijkl") for _ in range(rng.choice([0, 1, 3, 9, 30]))]) for i in range(60)]
    stop = spark.createDataFrame([("a",), ("l",)], "term string")
    flat = lambda df, *c: sorted(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in df.select(*c).collect())
    for more in ([], [rows[3], rows[10]]):
        tokens = spark.createDataFrame([*rows, *more], "id string, yr int, title string, tokens array<string>").cache()
        s = Settings(min_term_count=1, max_doc_freq_ratio=0.9, df_ratio_threshold=0.6, top_df_percent=0.1, topk_terms_per_doc=4)
        want = Lineage(tokens, s, stop, keep=True)
        for most, step in ((1 << 24, 5), (1 << 24, 1 << 20), (0, 1 << 20)):
            monkeypatch.setattr(weight, "MOST_CELLS", most)
            monkeypatch.setattr(weight, "ENTRIES", step)
            monkeypatch.setattr(vocab, "ENTRIES", step)
            x = Lineage(tokens, s, stop, keep=True, wide=False)
            assert flat(x.term_df, "yr", "term", "df") == flat(want.term_df, "yr", "term", "df")
            assert (x.weights is None) == (x.pruned is None) == (most == 0)
            assert flat(x.tfidf, "id", "yr", "term", "term_id", "tf", "idf", "w") == flat(want.tfidf, "id", "yr", "term", "term_id", "tf", "idf", "w")
            for name in ("vectors", "filtered", "top"):
                assert flat(getattr(x, name), "id", "yr", "term", "term_id", "w") == flat(getattr(want, name), "id", "yr", "term", "term_id", "w")
            assert flat(x.vector_docs, "id", "yr") == flat(want.vector_docs, "id", "yr")
            if most and not more:
                assert "Exchange" not in x.vectors._jdf.queryExecution().executedPlan().toString()
            x.release()
        want.release()


def test_frequencies_have_no_aggregate_before_the_exchange(spark):
    """A hash table of a task's (yr, term) grows with what the task reads; steps of a fixed size don't."""
    tokens = spark.createDataFrame([(i, y, t.split()) for i, y, t in M1], "id string, yr int, tokens array<string>")
    plan = vocab.term_df(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Aggregate" not in plan.split("Exchange", 1)[1]
    assert {tuple(r) for r in vocab.docs_per_year(tokens, made=True).collect()} == {tuple(r) for r in vocab.docs_per_year(tokens).collect()}


def test_short_column_lists_leave_vectors_where_they_are(spark):
    v = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.1), ("b", "x", 0.0), ("b", "z", 1.0)], "id string, term string, w double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = prune.drop_columns(v, v.filter("term = 'y'").select("term"), ["term"])
        assert sorted((r.id, r.term) for r in found.collect()) == [("a", "x"), ("b", "z")]
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
