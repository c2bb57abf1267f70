"""Embedding near-duplicates: a flat graph of robust-pruned adjacency lists over overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlineage.llm.common import BASE, U64, block_pairs, components, cut, drop, fetch, free_shuffles, group_starts, join_split, mix, partitions, roots, scratch, whole_groups

THRESHOLD = 0.95
#: Vectors that a cell owns on average, and cells that a vector stands in.
CELL, OVERLAP = 300, 4
#: Rows of a block; larger cells are searched by pairs of blocks.
BLOCK = 3_000
#: The centres are fitted on at most so many rows and bytes; no two are nearer than APART, so that a group of near copies has one.
SAMPLE, SAMPLE_BYTES, CENTRES, APART = 40_000, 1 << 25, 4_096, 0.9
#: Lengths of vectors that get centres of their own, the most frequent ones; each other length is one cell.
LENGTHS = 8
#: Cells of more rows than SPLIT are cut by pivots of their own where the centres are too few; SLICE rows a task.
SPLIT, SLICE = 5_000, 50_000
#: Rows that a shard within a cell has without overlap, and shards that a row stands in.
SHARD, SHARDS = 125, 2
#: Candidates, near and far edges of a node, and the factor of the pruning; width of the beam, audited rows and share of their links to find.
NEAREST, NEAR, FAR, ALPHA, BEAM, AUDIT, RECALL = 24, 8, 4, 1.2, 12, 64, 1.0
#: Cosines in single precision are off by less.
SLACK = 1e-4
CELL_BITS = 33
#: Numbers that a vectorised step takes.
STEP = 1 << 20


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column without nulls and of one length, as doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def nearest(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest cosines of each row, from the highest down, ties by place."""
    n = s.shape[1]
    if k > 8 and s.size > STEP and len(s) > 1:
        step = max(1, STEP // n)
        return np.concatenate([nearest(s[i : i + step], k) for i in range(0, len(s), step)])
    if k > 8:
        # Cosines above -3 as numbers that sort alike, the place behind them: numbers are cut and sorted faster than places are.
        key = (s.astype(np.float32) + np.float32(4)).view(np.int32).astype(np.int64) << 32 | np.arange(n - 1, -1, -1)
        key = np.partition(key, n - k, axis=1)[:, n - k :] if k < n else key
        key.sort(axis=1)
        return n - 1 - (key[:, ::-1] & 0xFFFFFFFF)
    s, rows, out = s.copy(), np.arange(len(s)), []
    for _ in range(min(k, n)):
        out.append(s.argmax(1))
        s[rows, out[-1]] = -4
    return np.stack(out, 1)


def places(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix of few true places."""
    at = np.flatnonzero(m)
    return at // m.shape[1], at % m.shape[1]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(e: Column) -> Column:
    """Whether an embedding can link: no null or non-finite component, not zero."""
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(e, lambda v: v != 0), F.lit(False))


def hashes(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each embedding is usable, and 128 bits of it, as two words: of its components as doubles, -0.0 as 0.0, and their places."""
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.append(0, np.cumsum(size))
    v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # nulls are nan

    def sums(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, U64), np.cumsum(of, dtype=U64)])
        return total[ends[1:]] - total[ends[:-1]]

    good = (size > 0) & (sums(~np.isfinite(v)) == 0) & (sums(v != 0) > 0)
    place = np.arange(len(v)) - np.repeat(ends[:-1], size)
    word = mix(v.view(U64) ^ mix(np.arange(1, size.max(initial=0) + 1, dtype=U64))[place])
    return good, mix(sums(word) + size.astype(U64)).view(np.int64), mix(sums(mix(word + U64(BASE)))).view(np.int64)


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, h1, h2, embedding): hashes and components of usable embeddings, null for others and for those without a vec_id. Components are doubles, or floats where they were given so."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * STEP // max(1, len(whole.column("embedding").flatten())))
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                good, h1, h2 = hashes(b.column("embedding"))
                bad = ~good | b.column("vec_id").is_null().to_numpy(zero_copy_only=False)
                e = b.column("embedding").take(pa.array(np.arange(len(bad)), mask=bad))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(h1, mask=bad), pa.array(h2, mask=bad), e], ["vec_id", "h1", "h2", "embedding"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return rows.mapInArrow(run, f"vec_id long, h1 long, h2 long, embedding array<{kind}>")


def centres(x: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
        sums = np.zeros_like(c)
        sums[own[order][at]] = np.add.reduceat(x[order], at, axis=0)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def separated(x: np.ndarray, apart: float) -> np.ndarray:
    """Unit rows in order, without those nearer than `apart` to one already taken."""
    out = np.empty_like(x)
    n = 0
    for row in x:
        if not n or (out[:n] @ row).max() < apart:
            out[n] = row
            n += 1
    return out[:n]


# --- the graph of one set of rows ------------------------------------------------------------------


def pruned_edges(shards: list[np.ndarray]) -> list[tuple[np.ndarray, int]]:
    """Adjacency matrices of robust-pruned graphs of shards' rows, and their medoids, from the shards' cosines.

    Candidates of a node are its nearest rows and a spread of others, nearest first; one is kept if no kept neighbour is nearer
    to it, by ALPHA, than the node is. Parts that the medoid doesn't reach get an edge from it. All shards' nodes are pruned at once.
    """
    size = np.array([len(s) for s in shards])
    cos = np.concatenate([s.ravel() for s in shards])
    start = np.repeat(np.cumsum(size**2) - size**2, size)
    node = np.arange(size.sum())
    width = np.repeat(size, size)
    row = start + (node - np.repeat(np.cumsum(size) - size, size)) * width
    adj = np.zeros(len(cos), bool)
    for far, most in ((False, NEAR), (True, FAR)):
        found, sim = np.zeros((len(node), NEAREST), np.int64), np.full((len(node), NEAREST), -2, np.float32)
        lo = 0
        for s in shards:
            n, me = len(s), np.arange(len(s))
            t = s.copy()
            t[me, me] = -2
            some = np.random.default_rng(n).integers(0, n, (n, NEAREST)) if far else nearest(t, min(n, NEAREST))
            if far:
                some = np.take_along_axis(some, np.argsort(-t[me[:, None], some], axis=1, kind="stable"), 1)
            found[lo : lo + n, : some.shape[1]], sim[lo : lo + n, : some.shape[1]] = some, t[me[:, None], some]
            lo += n
        alive, most_cos, place = sim > -1.5, 1 - (1 - sim) / ALPHA**2, start[:, None] + found
        for _ in range(most):
            first = alive.argmax(1)
            some = alive[node, first]
            if not some.any():
                break
            c = found[node, first]
            adj[row[some] + c[some]] = True
            # By squared chords, 2 - 2 cos.
            alive &= cos.take(place + (c * width)[:, None]) < most_cos
            alive[node, first] = False
    out = []
    for s, end in zip(shards, np.cumsum(size**2), strict=True):
        n, medoid = len(s), int(s.sum(1).argmax())
        mine = adj[end - n * n : end].reshape(n, n)
        while True:
            reached = np.zeros(n, bool)
            front = np.array([medoid])
            while len(front):
                reached[front] = True
                front = np.flatnonzero(mine[front].any(0) & ~reached)
            if reached.all():
                break
            lost = np.flatnonzero(~reached)
            mine[medoid, lost[s[medoid, lost].argmax()]] = True
        out.append((mine, medoid))
    return out


def flat_graph(x: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency lists (n, widest), -1 where there is no more, and the medoids, of unit rows.

    Rows stand in their nearest cluster shards; each shard has a graph of its own, and the lists of a row, with the edges to it, are united. The
    cosines that a shard's graph is made from also say which of its rows are in range: known (n, n) gets them.
    """
    n = len(x)
    c = centres(x, -(-n // SHARD), rounds=3)
    best = nearest(x @ c.T, SHARDS)
    rows, shard = np.repeat(np.arange(n), best.shape[1]), best.ravel()
    order = np.lexsort((rows, shard))
    rows, shard = rows[order], shard[order]
    members = np.split(rows, np.flatnonzero(shard[1:] != shard[:-1]) + 1)
    shards = [x[mine] @ x[mine].T for mine in members]
    edges, medoids = np.zeros((n, n), bool), []
    for mine, s, (adj, medoid) in zip(members, shards, pruned_edges(shards), strict=True):
        if known is not None:
            a, b = places(s >= THRESHOLD - SLACK)
            known[mine[a], mine[b]] = True
        a, b = places(adj)
        edges.ravel()[mine[a] * n + mine[b]] = True
        medoids.append(mine[medoid])
    a, b = places(edges | edges.T)
    first = np.searchsorted(a, np.arange(n + 1))
    lists = np.full((n, max(1, int(np.diff(first).max()))), -1)
    lists[a, np.arange(len(a)) - first[a]] = b
    return lists, np.unique(medoids)


def cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), x.dtype)
    for i in range(0, len(a), 1 << 16):
        out[i : i + (1 << 16)] = np.einsum("ij,ij->i", x.take(a[i : i + (1 << 16)], 0), x.take(b[i : i + (1 << 16)], 0))
    return out


def search(x: np.ndarray, lists: np.ndarray, medoids: np.ndarray, queries: np.ndarray, beam: int, reach: float = THRESHOLD - SLACK, known: np.ndarray | None = None) -> np.ndarray:
    """(queries, rows) found in range, the query itself included.

    Greedy from the two nearest medoids with a beam; then the range expands: rows in range are walked from, those known beforehand too, until no new one
    appears. Cosines are computed of the rows that a walk meets.
    """
    q, n = len(queries), len(x)
    inside = np.zeros((q, n), bool) if known is None else known.copy()
    seen = inside.copy()
    nbr = medoids[nearest(x[queries] @ x[medoids].T, 2)]
    active = np.arange(q)
    kept, at, fresh = np.full((q, beam), -2.0, np.float32), np.zeros((q, beam), np.int64), np.zeros((q, beam), bool)  # the best rows that each query has seen; those not walked from
    met = np.zeros((q, n), bool)
    while True:
        ok = (nbr >= 0) & ~met[active[:, None], nbr]
        rows, cols = np.repeat(active, ok.sum(1)), nbr[ok]
        got = cosines(x, queries[rows], cols)
        met[rows, cols] = True
        inside[rows, cols] |= got >= reach
        wide = np.full(nbr.shape, -2.0, np.float32)
        wide[ok] = got
        merged = np.concatenate([kept[active], wide], 1)
        top = nearest(merged, beam)
        kept[active] = np.take_along_axis(merged, top, 1)
        at[active] = np.take_along_axis(np.concatenate([at[active], nbr], 1), top, 1)
        fresh[active] = np.take_along_axis(np.concatenate([fresh[active], ok], 1), top, 1)
        left = np.where(fresh[active], kept[active], np.float32(-2))
        best = left.argmax(1)
        go = left[np.arange(len(active)), best] > -1.5
        active, best = active[go], best[go]
        if not len(active):
            break
        fresh[active, best] = False
        nbr = lists[at[active, best]]
    seen |= met
    walked, graph = np.zeros((q, n), bool), None
    while True:
        rows, cols = places(inside & ~walked)
        if not len(rows):
            return inside
        walked[rows, cols] = True
        if len(rows) * lists.shape[1] <= 1 << 22:
            nbr = lists[cols]
            ok = (nbr >= 0) & ~seen[rows[:, None], nbr]
            key = np.unique(np.repeat(rows, nbr.shape[1])[ok.ravel()] * n + nbr.ravel()[ok.ravel()])
            rows, cols = key // n, key % n
        else:  # groups of many near copies: the neighbours of all by one product
            if graph is None:
                graph = np.zeros((n, n), np.float32)
                a, b = np.nonzero(lists >= 0)
                graph[a, lists[a, b]] = 1
            some = np.unique(rows)
            new = np.zeros((len(some), n), np.float32)
            new[np.searchsorted(some, rows), cols] = 1
            hit = (new @ graph > 0) & ~seen[some]
            rows, cols = places(hit)
            if len(rows) * 8 > hit.size:
                wide = np.flatnonzero(hit.any(0))
                block = x[queries[some]] @ x[wide].T
                seen[some[rows], cols] = True
                inside[some[rows], cols] = block[rows, np.searchsorted(wide, cols)] >= reach
                continue
            rows = some[rows]
        got = cosines(x, queries[rows], cols)
        seen[rows, cols] = True
        inside[rows, cols] = got >= reach


def linked_rows(x: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(queries, n) linked rows of one set, verified in double precision; queries link among themselves if either finds the other.

    The search is audited against all cosines of a spread of queries; while it finds too few, the beam doubles, at last over all rows.
    """
    n = len(x)
    u = unit(x)
    single = u.astype(np.float32)
    known = np.zeros((n, n), bool)
    lists, medoids = flat_graph(single, known)
    known = known[queries]
    audit = np.unique(np.linspace(0, len(queries) - 1, min(len(queries), AUDIT)).astype(int))
    truth = single[queries[audit]] @ single.T >= THRESHOLD - SLACK
    beam = min(BEAM, n)
    while True:
        found = np.concatenate([search(single, lists, medoids, queries[i : i + 1024], beam, known=known[i : i + 1024]) for i in range(0, len(queries), 1024)])
        if (found[audit] & truth).sum() >= RECALL * truth.sum() or beam >= n:
            break
        beam = min(2 * beam, n)
    among = found[:, queries]
    found[:, queries] = among | among.T
    found[np.arange(len(queries)), queries] = False
    # Doubles: a product where many links are to be verified, and the cosine as defined wherever it may matter how it is rounded.
    for i in range(0, len(queries), 256):
        mine = found[i : i + 256]
        a, b = places(mine)
        q = queries[i + a]
        cos = (u[queries[i : i + 256]] @ u.T)[a, b] if len(a) * 16 > mine.size else cosines(u, q, b)
        near = np.flatnonzero(np.abs(cos - THRESHOLD) < 1e-9)
        if len(near):
            p, r = x[q[near]], x[b[near]]
            cos[near] = np.einsum("ij,ij->i", p, r) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", r, r))
        mine[a, b] = cos >= THRESHOLD
    return found


# --- all vectors -----------------------------------------------------------------------------------


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal embeddings are one node (told apart by 128 bits), their copies linked. Centres of cells are fitted on a bounded sample; every vector is indexed, in the
    cells of its OVERLAP nearest centres, the nearest of which owns it. Where there are more vectors than the centres make cells of CELL for, cells
    are cut again by pivots of their own. A cell's rows, by pairs of blocks if they are many, are one task's: cluster shards that overlap,
    a robust-pruned graph of each, their adjacency lists united, and a range-expanding search for every row that the cell owns, audited and
    verified in doubles. A link is counted for a vector by its owner or, if the other vector doesn't stand there, by the other's; so
    counts and spanning edges are all that travels, however large a group of near copies is. `audit` measures the recall over all cells.

    Vectors that are null, zero or hold null or non-finite components have no link and their own id; vectors of different lengths never link. Rows that repeat a vec_id
    with equal embeddings count as copies, with unlike ones they are nodes of their own. A null vec_id has a row of its own: no link, a null component, not kept. An empty table gives an
    empty table; other columns are ignored.
    """
    ids = keyed(vectors)
    with scratch(vectors.sparkSession) as keep:
        nodes = ids.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        nodes = cut(nodes.withColumns({"d": F.size("embedding"), "node": F.monotonically_increasing_id()}), "vector-nodes")
        free_shuffles(vectors.sparkSession)
        links = node_links(nodes)
        free_shuffles(vectors.sparkSession)
        found = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
        linked = cut(found.join(nodes.select("node", "h1", "h2", "rep", "copies"), "node"), "vectors-linked")
        lowest = cut(linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("m")), "vector-classes")
        rooted = join_split(linked, lowest, ["root"], "m", linked.count())
        sums = links.groupBy("node").agg(F.sum("links").alias("n"))
        known = rooted.join(sums, "node", "left").select("h1", "h2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        alone = nodes.join(linked.select("node"), "node", "left_anti").select("h1", "h2", "copies", (F.col("copies") - 1).alias("n_links"), F.col("rep").alias("component_id"))
        known = keep(cut(known.unionByName(alone), "vectors-known"))
    rows = ids.select("vec_id", "h1", "h2")
    useless = rows.filter("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = join_split(rows.filter("h1 is not null"), known, ["h1", "h2"], "copies", known.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n)
    out = out.select("vec_id", "n_links", "component_id").unionByName(useless)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def refined(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """placed with each cell of more than SPLIT rows cut into cells of about CELL, by pivots from its own rows.

    Pivots are a hashed share of the rows, CENTRES a cell on average at most, and stand apart: a group of near copies has
    room for one of them, stays together and meets by pairs of blocks. Each row stands with its OVERLAP nearest pivots,
    the nearest of a row that the cell owns owns it. A cell's rows are dealt in slices, each with all pivots ahead of
    its rows, so a task holds the pivots and a batch. A cell's number becomes cell * (2 * CENTRES + 1), plus 1 + the pivot's place.
    """
    width, most, apart, mask = 2 * CENTRES + 1, OVERLAP, APART, (1 << CELL_BITS) - 1
    plan = sizes.withColumn("_want", F.when(F.col("m") > SPLIT, F.least(F.lit(float(CENTRES)), F.col("m") / F.lit(float(CELL)))).otherwise(F.lit(0.0)))
    plan = plan.withColumn("_slices", F.ceil(F.col("m") / F.lit(float(SLICE))).cast("int"))
    rows = placed.join(F.broadcast(plan), "cell")  # as many rows of the plan as first centres and rare lengths
    chance = F.pmod(F.xxhash64(F.lit("pivot"), "node"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    names = ["cell", "_slice", "_kind", "own", "node", "copies", "embedding"]
    pivots = rows.filter(chance < F.col("_want") / F.col("m")).withColumns({"_slice": F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)), "_kind": F.lit(0)})
    members = rows.withColumns({"_slice": F.pmod(F.xxhash64(F.lit("slice"), "node"), F.col("_slices")).cast("int"), "_kind": F.lit(1)})
    dealt = pivots.select(*names).unionByName(members.select(*names)).repartition(partitions(placed), "cell", "_slice").sortWithinPartitions("cell", "_slice", "_kind", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, c = None, [], None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            starts = group_starts(t, ["cell", "_slice", "_kind"])
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                p = t.slice(lo, hi - lo).combine_chunks()
                cell, kind = p["cell"][0].as_py(), p["_kind"][0].as_py()
                if (key := (cell, p["_slice"][0].as_py())) != at:
                    at, held, c = key, [], None
                x = unit(matrix(p["embedding"]))
                if kind == 0:
                    held.append(x)
                    continue
                if c is None and held:
                    c, held = separated(np.concatenate(held), apart)[: width - 1], []
                if c is None:  # a small cell, or one that drew no pivot
                    best = np.full((len(x), 1), -1)
                else:
                    best = np.concatenate([nearest(x[i : i + 4096] @ c.T, most) for i in range(0, len(x), 4096)])
                n = best.shape[1]
                take = pa.array(np.repeat(np.arange(len(x)), n))
                own = np.repeat(p["own"].to_numpy(), n) & np.tile(np.arange(n) == 0, len(x))
                cols = [p[k].combine_chunks().take(take) for k in ("node", "copies", "embedding")]
                yield pa.RecordBatch.from_arrays([pa.array((cell & ~mask) + (cell & mask) * width + 1 + best.ravel()), pa.array(own), *cols], ["cell", "own", "node", "copies", "embedding"])

    return dealt.mapInArrow(run, f"cell long, own boolean, node long, copies long, embedding {placed.schema['embedding'].dataType.simpleString()}")


def fitted_centres(nodes: DataFrame, n: int, d: int) -> np.ndarray:
    """Centres for n nodes of length d, from a hashed sample of bounded rows and bytes."""
    k = max(1, min(CENTRES, -(-n // CELL)))
    most = max(k, min(SAMPLE, 64 * k, SAMPLE_BYTES // (8 * max(d, 1))))
    sample = nodes.select("node", "embedding")
    if most < n:
        sample = sample.filter(F.pmod(F.xxhash64(F.lit("sample"), "node"), F.lit(1 << 30)) < max(1, int(most / n * (1 << 30))))
    t = fetch(sample).sort_by("node")
    if not t.num_rows:
        t = fetch(nodes.select("node", "embedding").limit(k)).sort_by("node")
    return separated(centres(unit(matrix(t["embedding"])), k), APART)


def placed_nodes(nodes: DataFrame, names: list[str]) -> DataFrame:
    """The columns named, of every node in its cells, with the numbers of all of them where its owner has it, for each pair of blocks (_i <= _j) that it belongs to there; a cell's number begins with the length.

    Centres say the cells, so a node's are found again where they are read, and no table holds its copies.
    """
    lengths = nodes.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()
    fitted = {r.d: fitted_centres(nodes.filter(F.col("d") == r.d), r.n, r.d).astype(np.float32) for r in lengths}
    overlap, bits, component = OVERLAP, CELL_BITS, nodes.schema["embedding"].dataType.simpleString()

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for b in batches:
            d = b.column("d").to_numpy()
            for length in np.unique(d).tolist():
                mine = b.filter(pa.array(d == length))
                for lo in range(0, mine.num_rows, 4096):
                    p = mine.slice(lo, 4096)
                    if length in fitted:
                        best = nearest(unit(matrix(p.column("embedding"))).astype(np.float32) @ fitted[length].T, overlap)
                    else:
                        best = np.zeros((p.num_rows, 1), np.int64)
                    yield p, best + (length << bits)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, best in cells_of(batches):
            cell, m = np.unique(best, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(m)], ["cell", "m"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, best in cells_of(batches):
            most = best.shape[1]
            row, own = np.repeat(np.arange(p.num_rows), most), np.tile(np.arange(most) == 0, p.num_rows)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(p.num_rows + 1, dtype=np.int32) * most), pa.array(best.ravel()))
            columns = {"cell": pa.array(best.ravel()), "own": pa.array(own), "owner": pa.array(best[row, 0]), "cells": cells.take(pa.array(row, mask=~own))}
            columns |= {c: p.column(c).take(pa.array(row)) for c in ("node", "copies", "embedding")}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"cell long, own boolean, owner long, cells array<long>, node long, copies long, embedding {component}"
    placed = nodes.select("d", "node", "copies", "embedding").mapInArrow(assign, schema)
    if any(r.n > CELL * CENTRES for r in lengths):
        first = cut(placed.drop("owner", "cells"), "vector-cells")
        placed = cut(refined(first, first.groupBy("cell").agg(F.count("*").alias("m"))), "vector-subcells")
        drop(first)
        places = placed.groupBy("node").agg(F.max(F.when(F.col("own"), F.col("cell"))).alias("owner"), F.collect_set("cell").alias("cells"))
        placed = placed.join(places, "node").withColumn("cells", F.when(F.col("own"), F.col("cells")))
        sizes = placed.groupBy("cell").agg(F.count("*").alias("m"))
    else:
        sizes = nodes.select("d", "embedding").mapInArrow(counted, "cell long, m long").groupBy("cell").agg(F.sum("m").alias("m"))
    large = fetch(sizes.filter(F.col("m") > BLOCK))  # at most OVERLAP nodes in BLOCK
    if not large.num_rows:
        return placed.withColumns({c: F.lit(0) for c in ("_i", "_j", "_block")}).select(*names)
    known = F.broadcast(placed.sparkSession.createDataFrame(large))
    met = block_pairs(placed.join(known, "cell", "left"), F.ceil(F.coalesce("m", F.lit(1)) / F.lit(float(BLOCK))), "node")
    return met.select(*names)


GROUP = ["cell", "_i", "_j"]


def node_links(nodes: DataFrame) -> DataFrame:
    """(node, links, root), a row or more for each node with links: copies linked, and the smallest node that its links of a task reach."""
    names = ["cell", "_i", "_j", "_block", "own", "node", "copies", "owner", "cells", "embedding"]
    dealt = placed_nodes(nodes, names).repartition(partitions(nodes), *GROUP).sortWithinPartitions(*GROUP, "node")

    def counted(t: pa.Table) -> pa.RecordBatch | None:
        own, owner, node, copies = (t[c].to_numpy() for c in ("own", "owner", "node", "copies"))
        queries = np.flatnonzero(own)
        if not len(queries):
            return None
        linked = linked_rows(matrix(t["embedding"]), queries)
        block = t["_block"].to_numpy()
        if t["_i"][0].as_py() != t["_j"][0].as_py():
            linked &= block[queries][:, None] != block[None, :]  # pairs of one block are another group's
        links = np.zeros(t.num_rows, np.int64)
        links[queries] = linked @ copies
        # Rows that other cells own, linked to rows that don't stand there.
        guests = np.flatnonzero(~own & linked.any(0))
        cells = t["cells"].combine_chunks().take(pa.array(queries))
        size = pc.list_value_length(cells).to_numpy()
        stands = np.full((len(queries), int(size.max())), -1)
        stands[np.repeat(np.arange(len(queries)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = cells.flatten().to_numpy()
        for i in range(0, len(guests), 64):
            g = guests[i : i + 64]
            links[g] = (linked[:, g] & (stands[:, None, :] != owner[g][None, :, None]).all(2)).T @ copies[queries]
        a, b = places(linked)
        label = roots(t.num_rows, queries[a], b)
        got = np.flatnonzero((links > 0) | (label != np.arange(t.num_rows)))
        return pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(links[got]), pa.array(node[label[got]])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, at in whole_groups(batches, GROUP):
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if (out := counted(whole.slice(lo, hi - lo).combine_chunks())) is not None and out.num_rows:
                    yield out

    return cut(dealt.mapInArrow(run, "node long, links long, root long"), "vector-links")


def audit(vectors: DataFrame, result: DataFrame, most: int = 256) -> tuple[int, int]:
    """(links, found) of a hashed sample of about `most` vectors: n_links by all cosines with every row, in blocks, and by a result of
    near_duplicates. vec_ids are to be unique."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", e.alias("embedding"))
    n = max(rows.count(), 1)
    asked = fetch(rows.filter(F.pmod(F.xxhash64(F.lit("audit"), "vec_id"), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30)))).sort_by("vec_id")
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(asked["embedding"]):
        by_length.setdefault(len(v), []).append(i)
    known = {d: (asked["vec_id"].to_numpy()[i], unit(matrix(asked["embedding"].take(pa.array(i))))) for d, i in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("embedding")).to_numpy()
            for d, (ids, u) in known.items():
                b = batch.filter(pa.array(size == d))
                if b.num_rows:
                    s = u @ unit(matrix(b.column("embedding"))).T >= THRESHOLD
                    s &= ids[:, None] != b.column("vec_id").to_numpy()[None, :]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(s.sum(1))], ["vec_id", "want"])

    want = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, want long").groupBy("vec_id").agg(F.sum("want").alias("want"))
    sums = want.join(result.select("vec_id", "n_links"), "vec_id").agg(F.coalesce(F.sum("want"), F.lit(0)).alias("w"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("g")).first()
    return sums.w, sums.g
