"""Queries of the subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textlineage.llm import bilinear, jaccard, neighbours, packing, quality, toxicity, winnowing
from textlineage.llm.common import table
from textlineage.llm.divergence import divergence
from textlineage.llm.mixing import mix
from textlineage.llm.sharding import shard_documents
from textlineage.llm.throttling import throttle
from textlineage.llm.toolcalls import link
from textlineage.llm.topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash_forest_join(spark, d):
    return jaccard.join(table(spark, d, "documents"))


@query
def op2_nonnegative_pu_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, d, "labels"))).select("doc_id", "held_out", "score", "predicted")


@query
def op3_temperature_mixing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return mix(docs).drop("text")


@query
def op4_pruned_graph_dedup(spark, d):
    return neighbours.near_duplicates(table(spark, d, "embeddings"))


@query
def op5_quadratic_discriminant_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return quality.score_quality(docs, quality.fit(docs, table(spark, d, "labels"))).select("doc_id", "held_out", "score", "predicted")


@query
def op6_tool_call_linking(spark, d):
    return link(table(spark, d, "conversations"))


@query
def op7_log_bilinear_scores(spark, d):
    return bilinear.score_documents(table(spark, d, "documents"))


@query
def op8_bounded_hash_ring(spark, d):
    return shard_documents(table(spark, d, "documents"))


@query
def op9_winnowing_fingerprints(spark, d):
    return winnowing.fingerprints(table(spark, d, "documents").select("doc_id", "text"))


@query
def op10_configuration_lp_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents").select("doc_id", "text"))


@query
def op11_norm_sorted_top_k(spark, d):
    return top_k(table(spark, d, "embeddings"))


@query
def op12_token_bucket_throttling(spark, d):
    return throttle(table(spark, d, "clicks"))


@query
def op13_source_divergence(spark, d):
    return divergence(table(spark, d, "documents"))


#: Without tool calls in JSON texts, of which the tables have none; tests compare those with a plain version.
ORACLES["op6_tool_call_linking"] = """
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(coalesce(role, '') || ':' || coalesce(text, '')) AS place FROM conversations),
c AS (SELECT conv_id, turn AS call_turn, min(place) AS c_place FROM m WHERE role = 'user' GROUP BY conv_id, turn),
r AS (SELECT conv_id, turn - 1 AS call_turn, min(place) AS r_place FROM m WHERE role = 'assistant' GROUP BY conv_id, turn)
SELECT conv_id, turn AS level, CAST(0 AS BIGINT) AS depth, turn, CAST(0 AS INTEGER) AS step, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BOOLEAN) AS linked, CAST(NULL AS BOOLEAN) AS valid,
    CAST(NULL AS VARCHAR) AS status, CAST(json_object('content', text, 'role', role) AS VARCHAR) AS json FROM m WHERE role <> 'assistant'
UNION ALL
SELECT m.conv_id, m.turn, 0, m.turn, 1, 'call', 'turn-' || m.turn, 'reply', m.place = c_place AND r_place IS NOT NULL, true,
    CASE WHEN m.place <> c_place THEN 'repeated' WHEN r_place IS NOT NULL THEN 'answered' ELSE 'unanswered' END, CAST(json_object('id', 'turn-' || m.turn, 'name', 'reply') AS VARCHAR)
FROM m JOIN c ON c.conv_id IS NOT DISTINCT FROM m.conv_id AND c.call_turn = m.turn LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.call_turn = m.turn WHERE role = 'user'
UNION ALL
SELECT m.conv_id, m.turn, CASE WHEN c_place IS NULL THEN 0 ELSE 1 END, m.turn, 0, 'result', 'turn-' || (m.turn - 1), CASE WHEN c_place IS NOT NULL THEN 'reply' END, c_place IS NOT NULL AND m.place = r_place, CASE WHEN c_place IS NOT NULL THEN true END,
    CASE WHEN c_place IS NULL THEN 'orphan' WHEN m.place = r_place THEN 'answers' ELSE 'repeated' END, CAST(json_object('content', text, 'id', 'turn-' || (m.turn - 1), 'role', role) AS VARCHAR)
FROM m LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM m.conv_id AND c.call_turn = m.turn - 1 LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.call_turn = m.turn - 1 WHERE role = 'assistant'
"""

ORACLES["op11_norm_sorted_top_k"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.r <> q.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 5
"""

#: The crc32 of an id's digits by a table of 256 remainders; each client's clicks in order by recursion.
ORACLES["op12_token_bucket_throttling"] = """
WITH RECURSIVE bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT click_id, client_id, epoch_us(ts) AS t, CAST(floor(epoch_us(arrived_at) / 3600000000) AS BIGINT) AS h FROM (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL)),
e AS (SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(click_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, bits.t[(xor(a, b) & 255) + 1]))) AS crc FROM d, bits),
f AS (SELECT click_id, client_id, t, CAST(least(7, coalesce((h - lo) * 8 // (hi - lo + 1), 0) + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS b FROM e, (SELECT min(h) AS lo, max(h) AS hi FROM e)),
w AS (SELECT CAST(k AS INTEGER) AS k, (SELECT max(t) FROM f WHERE b < k) - 168 * 3600000000 AS w FROM range(8) r(k)),
g AS (SELECT f.*, coalesce(t < w.w, false) AS late FROM f JOIN w ON w.k = f.b),
s AS (SELECT click_id, client_id, t, coalesce((SELECT min(k) FROM w WHERE k > g.b AND w.w > g.t), 7) AS b, row_number() OVER (PARTITION BY client_id ORDER BY t, click_id NULLS FIRST) AS n FROM g WHERE NOT late),
r AS (
    SELECT client_id, n, click_id, b, t, CAST(3600000000 AS BIGINT) AS credit, CAST(NULL AS BIGINT) AS penalty, true AS admitted FROM s WHERE n = 1
    UNION ALL
    SELECT s.client_id, s.n, s.click_id, s.b, s.t, c.credit - CASE WHEN c.credit >= 900000000 THEN 900000000 ELSE 0 END, CASE WHEN c.credit < 900000000 THEN coalesce(r.penalty, s.t) END, c.credit >= 900000000
    FROM r JOIN s ON s.client_id = r.client_id AND s.n = r.n + 1, LATERAL (SELECT least(4500000000, r.credit + s.t - r.t) AS credit) c
)
SELECT click_id, CASE WHEN admitted THEN 'admitted' ELSE 'throttled' END AS outcome, b AS batch, credit AS credit_after, penalty AS penalty_start_us, CASE WHEN NOT admitted THEN t + 900000000 - credit END AS penalty_end_us FROM r
UNION ALL
SELECT click_id, 'late', b, NULL, NULL, NULL FROM g WHERE late
"""

ORACLES["op13_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) USING (lang, source, term)),
p AS (SELECT *, CAST(1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM c),
l AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM c GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
u AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u QUALIFY part = 'pair' OR rank <= 10
"""
