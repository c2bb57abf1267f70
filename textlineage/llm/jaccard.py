"""N-gram Jaccard join: a MinHash LSH forest of sorted prefix tries, shortened adaptively, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlineage.llm.common import BASE, U64, block_pairs, chain, components, cut, join_split, mix, partitions, roots, scratch, span_hashes, steps, text_buffers, text_words, whole_groups

SHINGLE, THRESHOLD = 5, 0.8
#: Tries of the forest and labels of a signature in each: one byte a label, so a signature is one sorted 64-bit number a trie.
TREES, LEVELS = 32, 8
#: Prefixes are shortened until a pair at the threshold meets with this probability, and in dense subtries further, to SHORTEST
#: labels, until fewer than MISSED links are to be expected beyond those found.
RECALL, MISSED, SHORTEST = 0.99999, 1e-3, 4
#: Least share of equal labels of a pair that is compared. A pair at 0.8 has less with a probability under 1e-17 (256 labels).
AGREEMENT = 0.55
#: Rows and shingles of a block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 22


def meeting(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """Probability that two sets share a prefix of so many labels in a tree at least."""
    return 1 - (1 - similarity**depth) ** trees


def sure_depth(trees: int = TREES, levels: int = LEVELS, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets with the target probability."""
    for depth in range(levels, SHORTEST - 1, -1):
        if meeting(threshold, depth, trees) >= recall:
            return depth
    raise ValueError("more trees are needed for this recall")


def shingle_sets(text: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles.

    Words are runs of letters, digits and marks in lower case, and single letters of scripts without spaces between words. A text of
    fewer than k words is one shingle; one without words has none.
    """
    data, offsets = text_buffers(pc.utf8_lower(text))
    starts, ends, first = text_words(data, offsets)
    words = span_hashes(data, starts, ends)[0]
    grams = chain(words, k) if len(words) >= k else np.zeros(0, U64)
    out = []
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(chain(words[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.zeros(0, U64))
    return out


@lru_cache
def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def tree_keys(sets: list[np.ndarray], trees: int = TREES) -> np.ndarray:
    """(sets, trees) signatures: the LEVELS labels of each tree, the first one highest. Sets aren't empty."""
    x = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    a, b = multipliers(trees * LEVELS)
    out = np.zeros((len(sets), trees), U64)
    for t in range(trees):
        for j in range(t * LEVELS, (t + 1) * LEVELS):
            low = np.minimum.reduceat((x ^ b[j]) * a[j], at)
            out[:, t] = out[:, t] << U64(8) | mix(low.astype(U64)) & U64(255)
    return out


def identities(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, which identify it together."""
    node, check = np.zeros(len(sets), U64), np.zeros(len(sets), U64)
    n = np.array([len(s) for s in sets])
    if n.any():
        at = np.concatenate([[0], np.cumsum(n[n > 0])[:-1]])
        flat = np.concatenate([s for s in sets if len(s)])
        node[n > 0] = np.add.reduceat(mix(flat + U64(1)), at)
        check[n > 0] = np.add.reduceat(mix(flat ^ U64(BASE)), at)
    return node, check


def signatures(docs: DataFrame, trees: int) -> DataFrame:
    """(doc_id, node, check, n, keys) of each text, and the other columns of docs: node and check identify the shingle set (128 bits together)."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                sets = shingle_sets(pc.fill_null(b.column("text"), ""))
                n = np.array([len(s) for s in sets], np.int32)
                keys = np.zeros((len(sets), trees), U64)
                if n.any():
                    keys[n > 0] = tree_keys([s for s in sets if len(s)], trees)
                node, check = identities(sets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * trees), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.array(n), lists, *(b.column(c) for c in more)], ["doc_id", "node", "check", "n", "keys", *more])

    layout = ", ".join(["doc_id long, node long, check long, n int, keys array<long>", *(f"{c} {dict(docs.dtypes)[c]}" for c in more)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(run, layout)


# --- the tries -------------------------------------------------------------------------------------

#: A subtrie: rows that share a tree's first SHORTEST labels, by pairs of blocks where they are many.
GROUP = ["tree", "prefix", "_i", "_j"]
#: The least XOR of two signatures that don't share so many labels; no two share LEVELS + 1.
DIFFER = np.array([0 if d > LEVELS else min(1 << 8 * (LEVELS - d), (1 << 64) - 1) for d in range(LEVELS + 2)], U64)


class Subtries:
    """Pairs of rows of the groups of a table to compare: those whose longest common prefix in any tree is in theirs (the first such
    tree), whose sizes and labels don't rule out the threshold."""

    def __init__(self, t: pa.Table, at: np.ndarray):
        self.keys = np.ascontiguousarray(t["keys"].combine_chunks().flatten().to_numpy().view(U64).reshape(t.num_rows, -1))
        self.labels = self.keys.view(np.uint8)
        self.n, self.block, self.tree = t["n"].to_numpy(), t["_block"].to_numpy(), t["tree"].to_numpy()
        self.apart = t["_i"].to_numpy() != t["_j"].to_numpy()
        self.starts, self.sizes = at[:-1], np.diff(at)

    def compared(self, a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs those to compare that share low to high labels in their tree, and the similarity that their labels suggest."""
        ok = np.minimum(self.n[a], self.n[b]) >= THRESHOLD * np.maximum(self.n[a], self.n[b])
        ok &= ~self.apart[a] | (self.block[a] != self.block[b])
        a, b = a[ok], b[ok]
        x = self.keys[a, self.tree[a]] ^ self.keys[b, self.tree[a]]
        depth = (x[:, None] < DIFFER[None, 1 : LEVELS + 1]).sum(1)
        ok = (depth >= low) & (depth <= high)
        a, b, depth = a[ok], b[ok], depth[ok]
        for k in range(self.keys.shape[1]):
            if not len(a):
                break
            x, mine = self.keys[a, k] ^ self.keys[b, k], self.tree[a]
            longer = x < DIFFER[depth + (k > mine)]  # as long a prefix in an earlier tree, or a longer one in a later tree
            ok = ~longer | (mine == k)
            a, b, depth = a[ok], b[ok], depth[ok]
        same = np.concatenate([(self.labels[a[i : i + 4096]] == self.labels[b[i : i + 4096]]).mean(1) for i in range(0, len(a), 4096)]) if len(a) else np.zeros(0)
        ok = same >= AGREEMENT
        return a[ok], b[ok], np.maximum((same[ok] - 1 / 256) / (1 - 1 / 256), THRESHOLD)

    def chunks(self, s: int, m: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of one group, 64 rows against those after them."""
        for i in range(0, m, 64):
            a, b = np.meshgrid(np.arange(i, min(i + 64, m)), np.arange(i, m), indexing="ij")
            later = b > a
            yield self.compared(s + a[later], s + b[later], low, high)

    def shortened(self, sure: int) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """(first row, rows, pairs) of each group, its prefixes shortened from LEVELS labels on.

        They are shortened to `sure` labels, where a pair at the threshold has met. A pair of similarity s among those found was found
        with the probability meeting(s, depth), so it stands for 1 / meeting - 1 pairs that were not; while these add up to MISSED or
        more, the group's prefixes lose another label.
        """
        two = self.starts[self.sizes == 2]
        if len(two):
            yield 0, 0, iter([self.compared(two, two + 1, sure, LEVELS)[:2]])  # one pair, so none beyond it
        for s, m in zip(self.starts[self.sizes > 2], self.sizes[self.sizes > 2], strict=True):

            def pairs(s: int = s, m: int = m) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                depth, found = sure, []
                for a, b, like in self.chunks(s, m, sure, LEVELS):
                    found.append(like)
                    yield a, b
                while depth > SHORTEST:
                    chance = meeting(np.concatenate(found), depth, self.keys.shape[1])
                    if (1 / chance - 1).sum() < MISSED:
                        break
                    depth -= 1
                    for a, b, like in self.chunks(s, m, depth, depth):
                        found.append(like)
                        yield a, b

            yield int(s), int(m), pairs()


def verified(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Which pairs reach the threshold exactly. Pairs come sorted by a; each a is compared with all its b at once."""
    ok = np.zeros(len(a), bool)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])), len(a)) if len(a) else np.zeros(1, int)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own, others = sets[a[lo]], [sets[j] for j in b[lo:hi]]
        flat = np.concatenate(others)
        found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        starts = np.concatenate([[0], np.cumsum([len(o) for o in others])[:-1]])
        both = np.add.reduceat(found.astype(np.int64), starts)
        ok[lo:hi] = both >= THRESHOLD * (len(own) + n[b[lo:hi]] - both) - 1e-9
    return ok


# --- the join --------------------------------------------------------------------------------------


def join(docs: DataFrame, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copies, kept.

    Documents link if the Jaccard similarity of their 5-word shingle sets is 0.8 or more; n_links counts the other
    documents linked directly, class_id is the smallest doc_id reachable, kept is doc_id = class_id. Equal sets are one
    node (told apart by 128 bits), so copies cost a row in an aggregation and are not paired. A pair of nodes is looked at in the tree of
    its longest common prefix and only there; its sets are compared whole, so texts may be of any length. Groups larger than a
    block, by rows or by shingles, meet block by block, so no task holds more than two blocks. What is emitted are sums and
    spanning edges, not pairs. An empty table gives an empty table.

    A text without words links with nothing. Null text is empty. A null doc_id stands for no document and has no row; rows that
    repeat a doc_id count as copies of each other if their texts are equal, and are nodes of their own if not; of ties for the smallest
    doc_id all rows of it are kept. Other columns are ignored, whatever their names.
    """
    out = classified(docs.select("doc_id", "text"), trees, recall)
    wordless = F.col("n") == 0
    class_id = F.when(wordless, F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.when(wordless, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).alias("n_links"), F.when(wordless, F.lit(1)).otherwise(F.col("copies")).alias("copies"), (F.col("doc_id") == class_id).alias("kept"))


def linked_nodes(docs: DataFrame, trees: int = TREES, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables: the documents (doc_id, node, check, n, others), their nodes (uid, node, check, rep, copies, n) and, for a node in a group
    where it has a link, (uid, links, root): linked documents there and the smallest uid that its links in the group reach."""
    sure = sure_depth(trees, recall=recall)
    signed = cut(signatures(docs, trees), "jaccard-signatures")
    # uid numbers the nodes: unique, and fixed once the table is written.
    nodes = signed.filter("n > 0").groupBy("node", "check").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = cut(nodes.withColumn("uid", F.monotonically_increasing_id()), "jaccard-nodes")
    # Sets of fewer than 4 shingles can't differ and still reach 0.8.
    placed = nodes.filter("n >= 4").select("uid", "n", F.posexplode("keys").alias("tree", "key"))
    placed = placed.select("uid", "n", "tree", F.shiftrightunsigned("key", 8 * (LEVELS - SHORTEST)).alias("prefix"))
    sizes = placed.groupBy("tree", "prefix").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).filter("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / F.lit(float(BLOCK))), F.least("m", F.ceil(F.col("shingles") / F.lit(float(BLOCK_SHINGLES)))))
    met = block_pairs(placed.drop("n").join(sizes, ["tree", "prefix"]), blocks, "uid").drop("m", "shingles")
    met = met.join(nodes.select("uid", "n", "keys"), "uid")
    parts = partitions(docs)

    def first_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a pair to verify in their group; the rest meet their pairs in other trees."""
        for t, at in whole_groups(batches, GROUP):
            need = np.zeros(t.num_rows, bool)
            for _, _, pairs in Subtries(t, at).shortened(sure):
                for a, b in pairs:
                    need[a], need[b] = True, True
            if need.any():
                for b in t.filter(pa.array(need)).to_batches():
                    yield b

    layout = "uid long, tree int, prefix long, _block int, _i int, _j int, n int, keys array<long>"
    order = [x.strip().split(" ")[0] for x in layout.split(",")]
    dealt = met.select(*order).repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "uid")
    need = cut(dealt.mapInArrow(first_meetings, layout), "jaccard-meetings")
    # The sets of the documents that have something to verify, from their texts once more.
    wanted = need.select("uid").distinct().join(nodes.select("uid", "node", "check", "rep", "copies"), "uid")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                sets = shingle_sets(pc.fill_null(b.column("text"), ""))
                # A doc_id that stands at several texts brings those of other nodes as well.
                node, check = identities(sets)
                same = (node.view(np.int64) == b.column("node").to_numpy()) & (check.view(np.int64) == b.column("check").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("copies"), pa.array([s.tobytes() for s in sets], pa.binary())], ["uid", "copies", "shingles"]).filter(pa.array(same))

    texts = docs.join(wanted, docs.doc_id == wanted.rep).select("uid", "node", "check", "copies", "text")
    sets = texts.mapInArrow(sets_of, "uid long, copies long, shingles binary").dropDuplicates(["uid"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Linked documents of each row's node, and the smallest node of its links in the group."""
        for t, at in whole_groups(batches, GROUP):
            sets = [np.frombuffer(x.as_py(), U64) for x in t["shingles"]]
            n, copies, uid = t["n"].to_numpy(), t["copies"].to_numpy(), t["uid"].to_numpy()
            links, ea, eb = np.zeros(t.num_rows, np.int64), [], []
            for s, m, pairs in Subtries(t, at).shortened(sure):
                label = np.arange(m)
                for a, b in pairs:
                    ok = verified(a, b, sets, n)
                    a, b = a[ok], b[ok]
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    if not m:
                        ea.append(a)
                        eb.append(b)
                    elif len(a):  # a spanning forest of the group's links
                        label = roots(m, np.concatenate([np.arange(m), a - s]), np.concatenate([label, b - s]))
                if m:
                    ea.append(s + np.arange(m))
                    eb.append(s + label)
            got = np.flatnonzero(links)
            if len(got):
                root = roots(t.num_rows, np.concatenate(ea), np.concatenate(eb))
                yield pa.RecordBatch.from_arrays([pa.array(uid[got]), pa.array(links[got]), pa.array(uid[root[got]])], ["uid", "links", "root"])

    dealt = need.join(sets, "uid").select(*order, "copies", "shingles").repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "uid")
    links = cut(dealt.mapInArrow(verify, "uid long, links long, root long"), "jaccard-links")
    return signed, nodes, links


def classified(docs: DataFrame, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per document of (doc_id, text, others): doc_id, node, check, n and the others; root, class_id, copies and links of its node, null without words."""
    with scratch(docs.sparkSession) as keep:
        signed, nodes, links = linked_nodes(docs.filter("doc_id is not null"), trees, recall)
        found = components(links.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "uid")
        sums = links.groupBy("uid").agg(F.sum("links").alias("links"))
        linked = cut(found.join(nodes.select("uid", "node", "check", "rep", "copies"), "uid").join(sums, "uid"), "jaccard-linked")
        lowest = cut(linked.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("m")), "jaccard-classes")
        classes = join_split(linked, lowest, ["root"], "m", linked.count()).select("node", "check", "uid", "root", "class_id", "copies", "links")
        alone = nodes.join(linked.select("uid"), "uid", "left_anti").select("node", "check", "uid", F.col("uid").alias("root"), F.col("rep").alias("class_id"), "copies", F.lit(0).cast("long").alias("links"))
        classes = keep(cut(classes.unionByName(alone).drop("uid"), "jaccard-nodes-classed"))
        keep(signed)
    signed = signed.drop("keys")
    wordless = signed.filter("n = 0").select("*", *[F.lit(None).cast("long").alias(c) for c in ("root", "class_id", "copies", "links")])
    return join_split(signed.filter("n > 0"), classes, ["node", "check"], "copies", signed.count()).unionByName(wordless)


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: of the smallest doc_id and, if that stands at several texts of the class, the least text hash.

    Texts of one doc_id that aren't near duplicates are classes of their own and all stay. Of rows with the same doc_id and text, a null text
    being empty, the one stays whose other columns are least, in their order, nulls first; null ids, which stand for no document, stay as they are.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = classified(docs.select("doc_id", "text", text.alias("_stage_text")))
    lowest = rows.filter("n > 0 and doc_id = class_id").groupBy("root").agg(F.min(F.struct("doc_id", "_stage_text")).alias("least")).select("least.*")
    kept = lowest.unionByName(rows.filter("n = 0").select("doc_id", "_stage_text")).distinct()
    named = docs.filter("doc_id is not null").withColumn("_stage_text", text).join(kept, ["doc_id", "_stage_text"], "left_semi")
    others = [*(c for c in docs.columns if c not in ("doc_id", "text")), "text"]
    least = named.groupBy("doc_id", "_stage_text").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_stage_row"))
    columns = [F.col("doc_id") if c == "doc_id" else F.col("_stage_row")[c].alias(c) for c in docs.columns]
    return least.select(*columns).unionByName(docs.filter("doc_id is null"))


def shared_shingles(docs: DataFrame, share: float) -> DataFrame:
    """(a, b, links, copies): exact links of a hashed share of the nodes. a is the asked node's hash, links whether b reaches the threshold.

    An inverted index of prefixes: two sets at the threshold share one of the least n - ceil(0.8 n) + 1 shingles of each in any fixed
    order, here that of the hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in steps(batch, "text"):
                sets = shingle_sets(pc.fill_null(b.column("text"), ""))
                heads = [s[: len(s) - int(np.ceil(THRESHOLD * len(s) - 1e-9)) + 1].view(np.int64) if len(s) else s.view(np.int64) for s in sets]
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in identities(sets)), pa.array([s.view(np.int64) for s in sets], lists), pa.array(heads, lists)], ["node", "check", "s", "head"])

    rows = docs.filter("doc_id is not null").select("text").mapInArrow(run, "node long, check long, s array<long>, head array<long>").filter("size(s) > 0")
    sets = cut(rows.groupBy("node", "check").agg(F.first("s").alias("s"), F.first("head").alias("head"), F.count("*").alias("copies")), "audit-sets")
    asked = sets.filter(F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.col("node").alias("a"), F.col("check").alias("ca"), F.col("s").alias("t"), F.col("head").alias("ahead"))
    index = sets.select(F.col("node").alias("b"), F.col("check").alias("cb"), F.explode("head").alias("shingle"))
    met = asked.select("a", "ca", F.explode("ahead").alias("shingle")).join(index, "shingle").filter("a <> b or ca <> cb").select("a", "ca", "b", "cb").distinct()
    pairs = met.join(sets.select(F.col("node").alias("b"), F.col("check").alias("cb"), "s", "copies"), ["b", "cb"]).join(asked.drop("ahead"), ["a", "ca"])
    both = F.size(F.array_intersect("s", "t"))
    return pairs.select("a", "ca", (both >= F.lit(THRESHOLD) * (F.size("s") + F.size("t") - both) - 1e-9).alias("links"), "copies")


def audit(docs: DataFrame, most: int = 2_000, trees: int = TREES, recall: float = RECALL) -> tuple[int, int]:
    """(links, found) of the nodes of a hashed sample of about `most` documents: linked documents by an exact join with all rows, and those
    that the forest finds."""
    with scratch(docs.sparkSession):
        exact = shared_shingles(docs, min(1.0, most / max(docs.count(), 1))).filter("links").groupBy("a", "ca").agg(F.sum("copies").alias("want"))
        _, nodes, links = linked_nodes(docs.filter("doc_id is not null").select("doc_id", "text"), trees, recall)
        got = links.groupBy("uid").agg(F.sum("links").alias("got")).join(nodes.select("uid", F.col("node").alias("a"), F.col("check").alias("ca")), "uid")
        sums = exact.join(got, ["a", "ca"], "left").agg(F.sum("want").alias("want"), F.sum("got").alias("got")).first()
    return sums.want or 0, sums.got or 0
