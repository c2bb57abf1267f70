import collections
import hashlib
import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import connect, same
from textlineage.llm import common, jaccard, mixing, packing, sharding, toolcalls
from textlineage.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


# --- packing


def test_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    slow, fast = Tokenizer.from_file(path), packing.token_ids(path)
    for t in ["", " ", "Hello  world\n\n x", "naïve 漢字 😀​", "a<|endoftext|>b", "x" * 3000, "tab\t\t\r\n 12345 don't we'll", "\x00\x01"]:
        assert list(fast(t)) == slow.encode(t, add_special_tokens=False).ids


def check_packing(rows, capacity):
    at = collections.defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for items in at.values():
        end = 0
        for o, n in sorted(items):
            assert o == end
            end += n
        assert end <= capacity
    return len(at)


def test_packing_round_trip(spark, edge_docs, no_docs):
    rows = packing.pack_documents(edge_docs, capacity=512).collect()
    check_packing(rows, 512)
    encode = packing.token_ids(packing.tokenizer_path())
    want = []
    for d in edge_docs.collect():
        ids = [*encode(d.text or ""), 0]
        start = 0
        sizes = [len(ids)]
        if len(ids) > 512:
            sizes = ([len(ids) % 512] if len(ids) % 512 else []) + [512] * (len(ids) // 512)
        for k, n in enumerate(sizes):
            want.append(str((d.doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))))
            start += n
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == sorted(want)
    assert packing.pack_documents(no_docs).count() == 0


def fewest_bins(items, room):
    """By trying every place of every item, largest first."""
    items, best = sorted(items, reverse=True), len(items)

    def walk(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for left in sorted({b for b in bins if b >= items[i]}):
            k = bins.index(left)
            walk(i + 1, [*bins[:k], left - items[i], *bins[k + 1 :]])
        walk(i + 1, [*bins, room - items[i]])

    walk(0, [])
    return best


def test_plans_of_few_items_are_the_fewest():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        items = rng.integers(3, 20, int(rng.integers(4, 12)))
        lengths, counts = np.unique(items, return_counts=True)
        assert sum(t for _, t in packing.plan(lengths, counts, 20)) == fewest_bins(items.tolist(), 20)


def test_packing_is_near_the_bound(spark):
    rows = QUERIES["op10_configuration_lp_packing"](spark, "/root/testdata/sf0.01").collect()
    n = check_packing(rows, 2048)
    assert n <= math.ceil(sum(r.length for r in rows) / 2048) * 1.01 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_every_item_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 101), 30, replace=False))
    counts = rng.integers(1, 400, 30)
    plan = packing.plan(lengths, counts, 100)
    got = np.zeros(30, int)
    for p, t in plan:
        assert sum(a * lengths[j] for j, a in p) <= 100
        for j, a in p:
            got[j] += a * t
    assert (got == counts).all()
    # Plain best-fit decreasing, item by item.
    room = []
    for x in sorted(np.repeat(lengths, counts), reverse=True):
        fits = [i for i, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= x
        else:
            room.append(100 - x)
    assert sum(t for _, t in plan) <= len(room) * 1.01 + 1
    assert sum(t for _, t in packing.best_fit(lengths, counts, 100)) == len(room)


# --- sharding


def test_shards_are_even_and_slots_gapless(spark, edge_docs, no_docs):
    for docs in (edge_docs, spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))):
        rows = sharding.shard_documents(docs).collect()
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        sizes = [len(slots[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    by_id = {r.doc_id: r for r in sharding.shard_documents(edge_docs).collect()}
    assert (by_id[6].size, by_id[6].text_crc32, by_id[8].size, by_id[8].text_crc32) == (1, 0, 8, zlib.crc32(b"one two"))
    assert sharding.shard_documents(no_docs).count() == 0


def test_ring_equals_a_walk_by_key(spark):
    """Keys in order around the ring, each to its own shard while it has room; then the rest, on clockwise."""
    keys = spark.range(500).select(F.col("id").alias("k"))
    got = {r.k: r.shard for r in sharding.assign(keys, "k", shards=5, vnodes=6).collect()}
    nodes = sharding.ring(spark, 5, 6)
    at = {r.k: r.at for r in keys.select("k", sharding.position(F.lit("key"), "k").alias("at")).collect()}
    room = [100] * 5
    want, left = {}, []
    arc = lambda p: next((i for i, (q, _) in enumerate(nodes) if q >= p), 0)
    first = nodes[0][0]
    for k in sorted(at, key=lambda k: (arc(at[k]), at[k] <= first, at[k])):
        s = nodes[arc(at[k])][1]
        if room[s]:
            room[s] -= 1
            want[k] = s
        else:
            left.append(k)
    for k in left:
        i = arc(at[k])
        while not room[nodes[i % len(nodes)][1]]:
            i += 1
        want[k] = nodes[i % len(nodes)][1]
        room[want[k]] -= 1
    assert got == want


def test_one_more_shard_moves_few_keys(spark):
    keys = spark.range(9000).select(F.col("id").alias("k"))
    a = {r.k: r.shard for r in sharding.assign(keys, "k", 8).collect()}
    b = {r.k: r.shard for r in sharding.assign(keys, "k", 9).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.16 * len(a)  # 1/9 at least


# --- mixing


def shares(rows, by="source"):
    out = collections.defaultdict(lambda: [0, 0, 0])
    for r in rows:
        out[r[by] or ""][0] += len((r.text or "").split())
    return out


def source_docs(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s, n in (("a", 400), ("b", 90), ("c", 30), (None, 12)):
        rows += [(len(rows) + i, " ".join(["w"] * int(rng.integers(1, 40))), s) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_temperature_weights_and_block_permutations(spark):
    docs = source_docs(spark).cache()
    total = {k: v[0] for k, v in shares(docs.collect()).items()}
    for p in (mixing.Mix(block_docs=16), mixing.Mix(max_repeats=3.5, block_docs=8), mixing.Mix(max_repeats=2, budget=4000, target_entropy=1.2)):
        rows = mixing.mix(docs, p).collect()
        got = shares(rows)
        repeats = {r.source or "": r.source_repeats for r in rows}
        weights = {r.source or "": r.source_weight for r in rows}
        assert sum(weights.values()) == pytest.approx(1)
        assert max(repeats.values()) <= p.max_repeats + 1e-6
        alpha = {round(math.log(weights[s] / weights["a"]) / math.log(total[s] / total["a"]), 4) for s in total if s != "a"}
        assert len(alpha) == 1  # one exponent for all
        for s in total:
            assert repeats[s] * total[s] - 40 <= got[s][0] <= repeats[s] * total[s] + 1e-6
        copies = collections.Counter((r.source or "", r.doc_id) for r in rows)
        for (s, _), n in copies.items():
            assert n in (math.floor(repeats[s] + 1e-9), math.floor(repeats[s] + 1e-9) + 1)
        if p.budget is None:
            assert len(copies) == docs.count() and max(repeats.values()) == pytest.approx(p.max_repeats, rel=1e-6) and repeats["a"] == pytest.approx(1)
        else:
            assert sum(v[0] for v in got.values()) <= p.budget


def test_target_entropy(spark):
    rows = mixing.mix(source_docs(spark), mixing.Mix(max_repeats=1000.0, target_entropy=1.0)).collect()
    w = {r.source: r.source_weight for r in rows}
    assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(1.0, abs=1e-4)


@pytest.mark.parametrize("p", [mixing.Mix(block_docs=16), mixing.Mix(max_repeats=3.5, block_docs=8), mixing.Mix(max_repeats=2, budget=4000, target_entropy=1.2, block_docs=5)])
def test_mixing_equals_a_plain_walk(spark, p):
    """The exponent by bisection; whole epochs, then the blocks of each source in their order and the documents of the last one."""
    docs = source_docs(spark).cache()
    rows = docs.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("doc_id").alias("_id"), mixing.words(F.col("text")).alias("_t"))
    n = rows.groupBy("_s").agg(F.ceil(F.count("*") / p.block_docs).alias("blocks"))
    rows = [(r["_s"], r["_id"], r["_t"], r.o, r.h) for r in rows.join(n, "_s").withColumns({"o": mixing.block_order(p), "h": mixing.doc_order(p)}).collect()]
    total = collections.Counter()
    for s, _, t, _, _ in rows:
        total[s] += t
    top = max(total.values())

    def weights(a):
        z = sum(v**a for v in total.values())
        return {s: v**a / z for s, v in total.items()}

    def repeats(a):
        w = weights(a)
        budget = p.budget or top * sum((v / top) ** a for v in total.values())
        return {s: w[s] * budget / total[s] for s in total}

    def bisect(ok):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if ok(mid) else (mid, hi)
        return hi

    a = bisect(lambda x: max(repeats(x).values()) <= p.max_repeats)
    if p.target_entropy:
        a = max(a, bisect(lambda x: -sum(w * math.log(w) for w in weights(x).values()) < p.target_entropy))
    out = mixing.mix(docs, p).collect()
    used = {r.source or "": r.source_repeats for r in out}
    assert all(used[s] == pytest.approx(min(v, p.max_repeats), rel=1e-6) for s, v in repeats(a).items() if s in used)
    want = collections.Counter()
    for s, r in used.items():
        mine = [x for x in rows if x[0] == s]
        left = (r - math.floor(r)) * total[s]
        for _, i, *_ in mine:
            want[s, i] += math.floor(r)
        order = sorted({x[3] for x in mine})
        for o in order if left > 0 else []:
            block = sorted((x for x in mine if x[3] == o), key=lambda x: x[4])
            size = sum(x[2] for x in block)
            for x in block:
                if x[2] > left:
                    left = -1
                    break
                left -= x[2]
                want[s, x[1]] += 1
            if left <= 0 or not size:
                break
    assert collections.Counter((r.source or "", r.doc_id) for r in out) == +want


def test_mixing_edge_cases(spark, edge_docs, no_docs):
    rows = mixing.mix(edge_docs, copies_only=True)
    assert rows.columns == edge_docs.columns
    assert set(map(str, rows.collect())) == set(map(str, edge_docs.collect()))
    assert mixing.mix(no_docs).count() == 0
    blank = edge_docs.filter("doc_id in (5, 6, 7)")
    assert mixing.mix(blank).count() == 3


# --- tool calls


def plain_links(rows):
    """[(conv, turn, kind, call_id, status, level, depth)] by walking every conversation in plain Python."""
    said = []
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        try:
            body = json.loads(text) if text.lstrip().startswith("{") else {}
        except ValueError:
            body = {}
        called = body.get("tool_calls") if role in ("assistant", "tool") else None
        calls = [f"turn-{turn}" if turn is not None else None] if role == "user" else [c.get("id") for c in called or []]
        answers = body.get("tool_call_id") if role == "tool" else f"turn-{turn - 1}" if role == "assistant" and called is None and turn is not None else None
        said.append((conv, turn, hashlib.md5(f"{role}:{text}".encode()).hexdigest(), calls, answers))
    order = sorted({(c, t, p, i, x) for c, t, p, calls, _ in said for i, x in enumerate(calls) if x is not None}, key=lambda k: (str(k[0]), k[1] if k[1] is not None else -1, k[2], k[3]))
    call = {}
    for c, t, p, i, x in order:
        call.setdefault((c, x), (t, p, i))
    answer = {}
    for c, t, p, _, x in sorted(said, key=lambda k: (str(k[0]), k[1] if k[1] is not None else -1, k[2])):
        if x is not None:
            answer.setdefault((c, x), (t, p))
    replies = {(c, t, p): x for c, t, p, _, x in said if x is not None}

    def place(c, t, p):
        """Level, depth and whether the way up is a cycle."""
        turns, seen = [t], []
        while (c, t, p) in replies and (c, replies[c, t, p]) in call:
            if (t, p) in seen:
                return max(turns), 1, True
            seen.append((t, p))
            t, p, _ = call[c, replies[c, t, p]]
            turns.append(t)
        return max((x for x in turns if x is not None), default=None), len(seen), False

    out = []
    for c, t, p, calls, x in said:
        level, depth, cyclic = place(c, t, p)
        status = None if x is None else "orphan" if (c, x) not in call else "cyclic" if cyclic else "answers" if answer[c, x] == (t, p) else "repeated"
        out.append((c, t, "message" if x is None else "result", x, status, level, depth))
        for i, k in enumerate(calls):
            status = "unnamed" if k is None else "repeated" if call[c, k] != (t, p, i) else "answered" if (c, k) in answer else "unanswered"
            out.append((c, t, "call", k, status, level, depth))
    return out


def calls_of(*cs, **more):
    return json.dumps({"tool_calls": [{"id": i, "function": {"name": n, "arguments": a}} for i, n, a in cs]} | more)


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", calls_of(("c1", "add", '{"b": 2, "a": 1}'), ("c2", "add", '{"a": "x"}'), ("c1", "add", "{}"))),
    (1, 2, "tool", '{"tool_call_id": "c2", "content": "two"}'), (1, 3, "tool", '{"tool_call_id": "zz", "content": "?"}'), (1, 4, "assistant", "done"), (1, 5, "tool", '{"tool_call_id": "c2", "content": "again"}'),
    (2, 0, "tool", '{"tool_call_id": "late", "content": "early"}'), (2, 1, "assistant", calls_of(("late", "nope", "not json"), (None, "add", "{}"))),
    (3, 0, None, None), (3, 0, "user", ""), (3, 0, "user", ""), (3, 0, "user", "other"), (3, 1, "assistant", "{broken"), (3, 1, "assistant", "second"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (4, None, "user", "q"), (4, None, "assistant", "q"),
    (5, 0, "user", "never answered"), (5, 1, "user", "x" * 300_000), (5, 2, "assistant", "y" * 300_000),
    # A chain of calls within results, out of turn, and cycles of one and two results, with one that hangs on a cycle.
    (6, 9, "assistant", calls_of(("a", "add", '{"a": 1}'))), (6, 3, "tool", calls_of(("b", "add", "{}"), tool_call_id="a")), (6, 5, "tool", calls_of(("c", "add", "{}"), tool_call_id="b")), (6, 1, "tool", calls_of(("d", "add", "{}"), tool_call_id="c")), (6, 2, "tool", '{"tool_call_id": "d"}'),
    (7, 0, "tool", calls_of(("s", "add", "{}"), tool_call_id="s")), (7, 1, "tool", calls_of(("p", "add", "{}"), tool_call_id="q")), (7, 2, "tool", calls_of(("q", "add", "{}"), tool_call_id="p")), (7, 4, "tool", calls_of(("h", "add", "{}"), tool_call_id="q", content="hangs")), (7, 3, "tool", '{"tool_call_id": "h"}'),
]


def test_calls_link_to_results_in_order(spark):
    schemas = {"add": {"a": ("BIGINT", True), "b": ("BIGINT", False)}, "reply": {"prompt": ("STRING", True)}}
    rows = [(*r, "x", "y") for r in CHATS]
    out = toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid string, place string"), schemas).collect()
    assert collections.Counter((r.conv_id, r.turn, r.kind, r.call_id, r.status, r.level, r.depth) for r in out) == collections.Counter(plain_links(CHATS))
    assert all(r.linked == (r.status in ("answered", "answers")) if r.status else r.linked is None for r in out)
    got = {(r.conv_id, r.turn, r.kind, r.call_id, r.json) for r in out}
    assert (1, 1, "call", "c1", '{"arguments":"{\\"a\\":1,\\"b\\":2}","id":"c1","name":"add"}') in got
    assert sorted((r.status, r.valid) for r in out if r.kind == "call" and r.call_id == "c1") == [("repeated", False), ("unanswered", True)]
    valid = {(r.conv_id, r.turn, r.kind, r.call_id): r.valid for r in out}
    assert valid[1, 2, "result", "c2"] is False and valid[1, 3, "result", "zz"] is None and valid[2, 1, "call", "late"] is False and valid[6, 9, "call", "a"] is True
    # In the order of its columns every result stands after its call.
    rank = {id(r): i for i, r in enumerate(sorted(out, key=lambda r: (str(r.conv_id), r.level if r.level is not None else -1, r.depth, r.turn or 0, r.step, r.call_id or "")))}
    for r in out:
        if r.status in ("answers", "repeated") and r.kind == "result":
            assert min(rank[id(c)] for c in out if c.kind == "call" and c.conv_id == r.conv_id and c.call_id == r.call_id and c.status == "answered") < rank[id(r)]
    assert toolcalls.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_json_texts_and_arguments_stay_whole(spark):
    said = '{"content": "a", "mood": "b"}'
    calls = json.dumps({"tool_calls": [{"id": "c1", "function": {"name": "reply", "arguments": '{"prompt": "p"}'}}, {"id": "c2", "function": {"arguments": "{}"}}], "content": "two calls"})
    result, more = '{"tool_call_id": "c1", "content": "done"}', '{"tool_call_id": "c2", "content": "done", "status": 7}'
    rows = [(1, 0, "system", said), (1, 1, "user", said), (1, 2, "assistant", said), (1, 3, "assistant", calls), (1, 4, "tool", result), (1, 5, "tool", more)]
    out = toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = {(r.turn, r.kind, r.call_id): json.loads(r.json) for r in out}
    assert [got[0, "message", None]["content"], got[1, "message", None]["content"], got[2, "result", "turn-1"]["content"]] == [said] * 3
    assert got[3, "call", "c1"] == {"arguments": '{"prompt":"p"}', "id": "c1", "name": "reply"} and got[3, "call", "c2"] == {"arguments": "{}", "id": "c2"}
    assert got[1, "call", "turn-1"] == {"id": "turn-1", "name": "reply"}
    assert got[3, "message", None]["content"] == "two calls" and got[4, "result", "c1"]["content"] == "done" and got[5, "result", "c2"]["content"] == more


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert same(QUERIES[name](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), ORACLES[name]) == ""


# --- pipeline


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    assert all(d.columns == docs.columns for d in seen[:-1])
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lost = set(ids[0]) - set(ids[1])
    assert lost and np.mean([labels[i].quality == 0 for i in lost if i in labels]) > 0.9
    assert set(ids[3]) <= set(ids[2]) <= set(ids[1]) and set(ids[4]) == set(ids[3]) and len(ids[4]) > len(ids[3])
    assert all(r.n_links == 0 for r in jaccard.join(seen[3]).collect())
    classes = {r.doc_id: r.class_id for r in jaccard.join(seen[2]).collect()}
    assert sorted(set(classes.values())) == ids[3]
    check_packing(seen[5].collect(), 2048)
    assert set(ids[5]) == set(ids[4])
    assert corpus_pipeline.run(spark, SF).count() == seen[5].count()


def test_tables_go_when_nothing_reads_them(spark, monkeypatch, tmp_path):
    """After two runs of the pipeline and a join the shared folder holds what their results read, and nothing after remove_tables."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    folder = tmp_path / f"tables-{spark.sparkContext.applicationId}"
    names = lambda: sorted(p.name.rpartition("-")[0] for p in folder.iterdir() if p.is_dir()) if folder.exists() else []
    results = [corpus_pipeline.run(spark, SF) for _ in range(2)]
    assert names() == ["pack-pieces"] * 2
    assert results[0].count() == results[1].count() > 0
    jaccard.join(spark.read.parquet(f"{SF}/documents.parquet")).count()
    assert names() == ["jaccard-nodes-classed", "jaccard-signatures", "pack-pieces", "pack-pieces"]
    common.remove_tables(spark)
    assert names() == []


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(Session)
    Context.master = "local[2]"
    assert common.shared_folder(Session).startswith("file://")


def test_pipeline_edge_cases(spark, edge_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.count()
