"""Similar pairs of documents in different years of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Entries of an inverted list in a row.
LIST = 4_096


def postings(vectors: DataFrame, most: int = LIST) -> DataFrame:
    """(yr, term_id, part, n_docs, docs, max_w): inverted lists, ordered by document, in numbered parts of about `most` entries by a hash of the
    document, so that no row holds the whole list of a frequent term. n_docs and max_w are the whole list's."""
    sizes = vectors.groupBy("yr", "term_id").agg(F.count("*").alias("n_docs"), F.max("w").alias("max_w"))
    rows = vectors.join(sizes, ["yr", "term_id"]).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n_docs") / F.lit(float(most)))).cast("int"))
    return rows.groupBy("yr", "term_id", "part").agg(F.first("n_docs").alias("n_docs"), F.array_sort(F.collect_list(F.struct("id", "w"))).alias("docs"), F.first("max_w").alias("max_w"))


def entries(lists: DataFrame) -> DataFrame:
    """(id, yr, term_id, w): the rows that inverted lists were made of."""
    return lists.select("yr", "term_id", F.explode("docs").alias("d")).select("d.id", "yr", "term_id", "d.w")


def posting_max(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("yr", "term_id").agg(F.max("w").alias("max_w"))


def year_pairs(years: DataFrame, window: int) -> DataFrame:
    """(yr_x, yr_y): present years with x < y <= x + window. Each year generates its window, then an equi-join."""
    ahead = years.select(F.col("yr").alias("yr_x"), F.explode(F.sequence(F.col("yr") + 1, F.col("yr") + window)).alias("yr_y")) if window > 0 else years.select(F.col("yr").alias("yr_x"), F.col("yr").alias("yr_y")).limit(0)
    return ahead.join(years.select(F.col("yr").alias("yr_y")), "yr_y").select("yr_x", "yr_y")


#: Products of a term in one year and those before it that a task computes at most, and terms that are split at most.
PRODUCTS, MOST_SPLIT = 1 << 26, 100_000
KEYS = ["yr_y", "term_id"]


def split_keys(x: DataFrame, y: DataFrame, on: list[str], most: int = PRODUCTS) -> tuple[DataFrame, DataFrame, list[str]]:
    """x, y and the keys to join them by, so that no key has more than about `most` products.

    The products of each key are counted beforehand, in a job of its own, from the numbers of rows of either side. A key with more is cut into
    blocks of x and blocks of y by a hash of the document; a row goes to all blocks of the other side. With a total of MOST_SPLIT * most products and more the
    bound is their share, total / MOST_SPLIT; so fewer than MOST_SPLIT keys are split, and their list is broadcast.
    """
    met = x.groupBy(*on).agg(F.count("*").alias("nx")).join(y.groupBy(*on).agg(F.count("*").alias("ny")), on).withColumn("n", F.col("nx") * F.col("ny"))
    known = met.agg(F.sum(F.col("n").cast("double")).alias("total"), F.max("n").alias("top")).first()
    limit = max(most, int((known.total or 0) // MOST_SPLIT))
    if (known.top or 0) <= limit:
        return x, y, on
    parts = F.ceil(F.col("n") / F.lit(limit))
    bx = F.least(parts, F.greatest(F.lit(1), F.ceil(F.sqrt(parts * F.col("nx") / F.col("ny")))))
    heavy = met.filter(F.col("n") > limit).withColumn("bx", bx).select(*on, "bx", F.ceil(parts / F.col("bx")).alias("by"))
    own = lambda i, n: F.coalesce(F.pmod(F.xxhash64(i), F.col(n)), F.lit(0))
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), F.lit(1)) - 1))
    cut = lambda df, i, mine, theirs: df.join(F.broadcast(heavy), on, "left").withColumns({f"_{mine}": own(i, mine)}).withColumn(f"_{theirs}", other(theirs)).drop("bx", "by")
    return cut(x, "id_x", "bx", "by"), cut(y, "id_y", "by", "bx"), [*on, "_bx", "_by"]


def joined(x: DataFrame, y: DataFrame, years: DataFrame, most: int = PRODUCTS) -> DataFrame:
    """Rows of documents that share a term, x in the earlier year of a pair.

    x goes to each year that it is compared with, so the shuffle key is year and term: no pair of years is met that isn't wanted, a key of a
    frequent term holds one year of it, and one whose products are more than a task's is split by `split_keys`. A row a pair of years is broadcast.
    """
    x, y, keys = split_keys(x.join(F.broadcast(years), "yr_x"), y, KEYS, most)
    return x.join(y, keys)


def sides_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    x = vectors.select(F.col("id").alias("id_x"), F.col("yr").alias("yr_x"), "term_id", F.col("w").alias("w_x"))
    return x, vectors.select(F.col("id").alias("id_y"), F.col("yr").alias("yr_y"), "term_id", F.col("w").alias("w_y"))


PAIR = ["yr_x", "yr_y", "id_x", "id_y"]


def summed(products: DataFrame, *more: str) -> DataFrame:
    return products.groupBy(*PAIR, *more).agg(F.count("*").alias("n_terms"), F.sum(F.col("w_x") * F.col("w_y")).alias("sim"))


def pair_similarity(vectors: DataFrame, window: int, most: int = PRODUCTS) -> DataFrame:
    """(yr_x, yr_y, id_x, id_y, n_terms, sim) of every pair that shares a stored term, the earlier document as x."""
    x, y = sides_of(vectors)
    return summed(joined(x, y, year_pairs(vectors.select("yr").distinct(), window), most))


def list_similarity(lists: DataFrame, window: int, most: int = PRODUCTS) -> DataFrame:
    """pair_similarity of the vectors that inverted lists, as `postings` makes them, were made of.

    Lists, not documents, are joined, by term alone, each with those of the later years in the window, and their products are made where they meet. A table in buckets
    by term (textlineage.sources.artifacts.write_bucketed) is thus joined without a shuffle; the only one left adds up pairs. Terms with more
    products than a task's, counted from the lists' sizes in a job of its own, go document by document through `joined`, which splits them; as
    by split_keys there are fewer than MOST_SPLIT of them.
    """
    sizes = lists.groupBy("term_id", "yr").agg(F.max("n_docs").alias("n"))
    later = sizes.select("term_id", F.col("yr").alias("yr_y"), F.col("n").alias("n_y"))
    met = sizes.join(later, "term_id").filter(F.col("yr_y").between(F.col("yr") + 1, F.col("yr") + window)).groupBy("term_id").agg(F.sum(F.col("n") * F.col("n_y")).alias("n"))
    known = met.agg(F.sum(F.col("n").cast("double")).alias("total"), F.max("n").alias("top")).first()
    limit = max(most, int((known.total or 0) // MOST_SPLIT))
    heavy = F.broadcast(met.filter(F.col("n") > limit).select("term_id")) if (known.top or 0) > limit else None
    light = lists if heavy is None else lists.join(heavy, "term_id", "left_anti")
    x = light.select("term_id", F.col("yr").alias("yr_x"), F.col("docs").alias("docs_x"))
    y = light.select("term_id", F.col("yr").alias("yr_y"), F.col("docs").alias("docs_y"))
    both = x.hint("merge").join(y, "term_id").filter(F.col("yr_y").between(F.col("yr_x") + 1, F.col("yr_x") + window))
    both = both.select("yr_x", "yr_y", "docs_y", F.inline("docs_x").alias("id_x", "w_x")).select("yr_x", "yr_y", "id_x", "w_x", F.inline("docs_y").alias("id_y", "w_y"))
    if heavy is not None:
        split = entries(lists.join(heavy, "term_id", "left_semi"))
        both = both.unionByName(joined(*sides_of(split), year_pairs(lists.select("yr").distinct(), window), most).select(*both.columns))
    return summed(both)


def verified(found: DataFrame, vectors: DataFrame, *more: str) -> DataFrame:
    """(yr_x, yr_y, id_x, id_y, n_terms, sim) of given pairs, over all terms that they share; `more` columns of a pair stay."""
    x, y = sides_of(vectors)
    return summed(found.join(x.drop("yr_x"), "id_x").join(y.drop("yr_y"), ["id_y", "term_id"]), *more)


def prefix_similarity(vectors: DataFrame, window: int, threshold: float, most: int = PRODUCTS) -> DataFrame:
    """Candidates of prefix filtering with their similarities, as pair_similarity gives them; all hits are among them, for weights of any sign.

    Terms of a document are ordered from rare to frequent. What a term can add to a similarity is at most its weight times the largest or, if the
    weight is negative, the smallest of its term, or nothing. The longest tail whose bounds sum to less than the threshold can't reach it
    alone, so a hit shares a term of the head. Heads are joined for candidates and those are verified over all terms. A threshold that isn't
    above 0 has every pair that shares a term as candidate.
    """
    if threshold <= 0:
        return pair_similarity(vectors, window, most)
    span = vectors.groupBy("term_id").agg(F.max("w").alias("_max"), F.min("w").alias("_min"), F.count("*").alias("_n"))
    bound = F.greatest(F.col("w") * F.col("_max"), F.col("w") * F.col("_min"), F.lit(0.0))
    tail = F.sum(bound).over(Window.partitionBy("id").orderBy(F.col("_n").desc(), "term_id").rowsBetween(Window.unboundedPreceding, 0))
    heads = vectors.join(span, "term_id").withColumn("_tail", tail).filter(F.col("_tail") >= threshold * (1 - 1e-9))
    x, y = sides_of(heads)[0], sides_of(vectors)[1]
    found = joined(x, y, year_pairs(vectors.select("yr").distinct(), window), most).select(*PAIR).distinct()
    return verified(found, vectors)


#: Levels of positive weights, each half of the one before, that blocks of an inverted list are made by; negative weights are one more.
LEVELS = 8


def level(w: Column) -> Column:
    """Block of a weight in its inverted list."""
    return F.when(w < 0, F.lit(-1)).otherwise(F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.floor(-F.log2(w)).cast("int"))))


def bounded_similarity(vectors: DataFrame, window: int, threshold: float, most: int = PRODUCTS) -> DataFrame:
    """The pairs that the bounded join looks at, as pair_similarity gives them, n_terms being the products computed; sim is null where a bound ruled a pair out.
    All hits are among them, for weights of any sign.

    An inverted list (year, term) has blocks by levels of weight, with their largest and smallest weights. What a term can add to a document's similarities
    with a year is its weight times an extreme of the list, or nothing. A document's terms go from the one that can add most down:

    1. The first terms, up to the one from which on the rest together stays below the threshold, meet the lists; of each list only blocks
       whose extreme, with all that the other terms can add, reaches the threshold, and in them only such rows.
    2. What a pair has so far and what is left can add decide whether it is dropped.
    3. Those that stay are verified over all terms that they share.

    Hits alone need the first steps once; a reader of dropped pairs too, as `pair_sides` is, computes them twice.
    """
    if threshold <= 0:
        return pair_similarity(vectors, window, most)
    least = threshold * (1 - 1e-9)
    years = year_pairs(vectors.select("yr").distinct(), window)
    x, y = sides_of(vectors.filter("w <> 0"))
    y = y.withColumn("level", level(F.col("w_y")))
    blocks = y.groupBy("yr_y", "term_id", "level").agg(F.max("w_y").alias("hi"), F.min("w_y").alias("lo"))
    lists = blocks.groupBy("yr_y", "term_id").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.collect_list(F.struct("level", "hi", "lo")).alias("blocks"))  # LEVELS + 1 at most
    can = lambda hi, lo: F.greatest(F.col("w_x") * hi, F.col("w_x") * lo, F.lit(0.0))
    terms = x.join(F.broadcast(years), "yr_x").join(lists, KEYS).withColumn("bound", can(F.col("hi"), F.col("lo")))
    one = Window.partitionBy("id_x", "yr_y")
    order = one.orderBy(F.col("bound").desc(), "term_id")
    terms = terms.withColumns({"total": F.sum("bound").over(one), "onward": F.sum("bound").over(order.rowsBetween(0, Window.unboundedFollowing))})
    terms = terms.withColumn("rest", F.sum(F.when(F.col("onward") < least, F.col("bound")).otherwise(0.0)).over(one)).filter(F.col("onward") >= least)
    reach = F.filter("blocks", lambda b: can(b["hi"], b["lo"]) + F.col("total") - F.col("bound") >= least)
    heads = terms.select("id_x", "yr_x", "yr_y", "term_id", "w_x", "rest", (F.col("total") - F.col("bound")).alias("others"), F.explode(reach).alias("b"))
    heads = heads.withColumn("level", F.col("b.level")).drop("b")
    heads, y, keys = split_keys(heads, y, [*KEYS, "level"], most)
    met = heads.join(y, keys).filter(F.col("w_x") * F.col("w_y") + F.col("others") >= least)
    seen = met.groupBy(*PAIR).agg(F.count("*").alias("n"), F.sum(F.col("w_x") * F.col("w_y")).alias("has"), F.max("rest").alias("rest"))
    stays = F.col("has") + F.col("rest") >= least
    kept = verified(seen.filter(stays).select(*PAIR, "n"), vectors, "n")
    dropped = seen.filter(~stays).select(*PAIR, F.col("n").alias("n_terms"), F.lit(None).cast("double").alias("sim"))
    return kept.withColumn("n_terms", F.col("n_terms") + F.col("n")).select(*dropped.columns).unionByName(dropped)


def hits(sims: DataFrame, threshold: float) -> DataFrame:
    return sims.filter(F.col("sim") >= threshold)


def contributions(found: DataFrame, side: str) -> DataFrame:
    """(yr_x, yr_y, id, contrib): hit similarities of each document of one side ("x" or "y") by pair of years."""
    return found.groupBy("yr_x", "yr_y", F.col(f"id_{side}").alias("id")).agg(F.sum("sim").alias("contrib"))


def pair_sides(sims: DataFrame, threshold: float) -> DataFrame:
    """(yr_x, yr_y, side, id, contrib, hits, touched, ops): of each document of either side its hit similarities, hits, candidates and
    products, as the pair strategy had them. One pass over the pairs serves scores, meta and diagnostics."""
    hit = F.coalesce(F.col("sim") >= threshold, F.lit(False))
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"id_{name}").alias("id"))
    rows = sims.select("yr_x", "yr_y", "n_terms", hit.alias("hit"), F.when(hit, F.col("sim")).otherwise(F.lit(0.0)).alias("s"), F.inline(F.array(side("x"), side("y"))))
    return rows.groupBy("yr_x", "yr_y", "side", "id").agg(F.sum("s").alias("contrib"), F.count_if("hit").alias("hits"), F.count("*").alias("touched"), F.sum("n_terms").alias("ops"))


def side_scores(docs: DataFrame, sides: DataFrame) -> DataFrame:
    """(id, yr, bs, fs) from pair_sides: what a document gets as the later side is its bs, as the earlier its fs; 0 without hits."""
    got = lambda side: F.sum(F.when(F.col("side") == side, F.col("contrib")).otherwise(0.0))
    sums = sides.groupBy("id").agg(got("y").alias("bs"), got("x").alias("fs"))
    return docs.join(sums, "id", "left").select("id", "yr", F.coalesce("bs", F.lit(0.0)).alias("bs"), F.coalesce("fs", F.lit(0.0)).alias("fs"))


def year_sizes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(yr_x, yr_y, nx, ny)."""
    n = docs.groupBy("yr").agg(F.count("*").alias("n"))
    return pairs.join(n.select(F.col("yr").alias("yr_x"), F.col("n").alias("nx")), "yr_x").join(n.select(F.col("yr").alias("yr_y"), F.col("n").alias("ny")), "yr_y")


def pair_meta(sides: DataFrame, docs: DataFrame, pairs: DataFrame, **settings) -> DataFrame:
    """One row per pair of years: document counts, candidates touched per x document, hits, and the settings given as columns."""
    got = sides.filter("side = 'x'").groupBy("yr_x", "yr_y").agg(F.sum("touched").alias("touched"), F.max("touched").alias("max_touched"), F.sum("hits").alias("hits"), F.sum("ops").alias("ops"))
    out = year_sizes(docs, pairs).join(got, ["yr_x", "yr_y"], "left").na.fill(0, ["touched", "max_touched", "hits", "ops"])
    out = out.select("yr_x", "yr_y", "nx", "ny", (F.col("touched") / F.greatest(F.lit(1), F.col("nx"))).alias("avg_touched"), "max_touched", "hits", "ops")
    return out.withColumns({k: F.lit(v) for k, v in settings.items()})


def pair_diagnostics(sides: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """By pair of years, over all x documents, those without a candidate included: touched mean, P90 and max; posting steps total and mean."""
    every = docs.select("id", F.col("yr").alias("yr_x")).join(F.broadcast(pairs), "yr_x")
    per_x = every.join(sides.filter("side = 'x'").select("yr_x", "yr_y", "id", "touched", "ops"), ["yr_x", "yr_y", "id"], "left").na.fill(0, ["touched", "ops"])
    return per_x.groupBy("yr_x", "yr_y").agg(
        F.avg("touched").alias("touched_avg"), F.percentile("touched", F.lit(0.9)).alias("touched_p90"), F.max("touched").alias("touched_max"),
        F.sum("ops").alias("ops_total"), F.avg("ops").alias("ops_avg"),
    )


def bounded_terms(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(yr_x, yr_y, id, term_id, w, k, n, total, remain): each document's terms by what they can add to a similarity with a document of the
    other year, the most first (ties by term), and what the terms after it can add together."""
    top = posting_max(vectors).select(F.col("yr").alias("yr_y"), "term_id", "max_w")
    x = vectors.select("id", F.col("yr").alias("yr_x"), "term_id", "w").join(F.broadcast(pairs), "yr_x").join(top, ["yr_y", "term_id"], "left")
    x = x.withColumn("bound", F.round(F.col("w") * F.coalesce("max_w", F.lit(0.0)), 12))
    one = Window.partitionBy("yr_x", "yr_y", "id")
    order = one.orderBy(F.col("bound").desc(), "term_id")
    x = x.withColumns({"k": F.row_number().over(order), "n": F.count("*").over(one), "total": F.sum("bound").over(one), "_sum": F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return x.withColumn("remain", F.when(F.col("k") == F.col("n"), F.lit(0.0)).otherwise(F.round(F.col("total") - F.col("_sum"), 9))).drop("max_w", "bound", "_sum")


def pair_bounds(bounds: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """By pair of years, over all x documents, from blocks.bounds: what is left to add at first and after 1, 3, 5 and 10 terms, and the
    share of candidates that the bound rules out on the way, mean and P90."""
    every = docs.select("id", F.col("yr").alias("yr_x")).join(F.broadcast(pairs), "yr_x")
    rows = every.join(bounds, ["yr_x", "yr_y", "id"], "left").na.fill(0)
    rows = rows.withColumn("ratio", F.when(F.col("touched") > 0, F.col("dead") / F.col("touched")).otherwise(F.lit(0.0)))
    names = ["remain_init", "remain_k1", "remain_k3", "remain_k5", "remain_k10"]
    return rows.groupBy("yr_x", "yr_y").agg(F.avg("ratio").alias("pruned_avg"), F.percentile("ratio", F.lit(0.9)).alias("pruned_p90"), *[F.avg(c).alias(c) for c in names])
