"""The registered queries as SQL for an independent engine, over the same tables."""

from __future__ import annotations

import re

#: Common table expressions by name; `sql` adds those that a query needs, in this order.
CTES = {
    "docs": "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(2010 + doc_id % 8 AS INTEGER) AS yr, source AS title, coalesce(text, '') AS text, lang FROM documents",
    "tok": "SELECT id, yr, title, lang, regexp_extract_all(lower(text), '[a-z]+') AS tokens FROM docs",
    "flat": "SELECT id, yr, unnest(tokens) AS term FROM tok",
    "counts": "SELECT id, yr, term, count(*) AS tf FROM flat GROUP BY ALL",
    "dpy": "SELECT yr, count(*) AS docs FROM tok WHERE len(tokens) > 0 GROUP BY yr",
    "tdf": "SELECT yr, term, count(*) AS df FROM counts GROUP BY ALL",
    "gdf": "SELECT term, CAST(sum(df) AS BIGINT) AS df FROM tdf GROUP BY term",
    "vocab": "SELECT term, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id FROM gdf WHERE df >= 5 AND df / (SELECT greatest(1, sum(docs)) FROM dpy) <= 0.5",
    "prior": "SELECT yr, docs, CAST(coalesce(sum(docs) OVER (ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_prior FROM dpy",
    "cum": "SELECT yr, term, term_id, tdf.df, CAST(coalesce(sum(tdf.df) OVER (PARTITION BY term ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS df_prior FROM tdf JOIN vocab USING (term)",
    "idf": "SELECT yr, term, term_id, cum.df, df_prior, n_prior, CASE WHEN n_prior = 0 THEN 0.0::DOUBLE ELSE ln(n_prior / (1.0::DOUBLE + df_prior)) END AS idf FROM cum JOIN prior USING (yr)",
    "tfidf": "SELECT id, yr, term, term_id, tf, tf * idf AS w FROM counts JOIN idf USING (yr, term)",
    "normed": "SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS nrm FROM tfidf",
    "vec": "SELECT id, yr, term, term_id, CASE WHEN nrm > 0 THEN w / nrm ELSE 0.0 END AS w FROM normed",
    "vdocs": "SELECT DISTINCT id, yr FROM vec",
    "stop": "SELECT unnest(['the', 'of', 'and', 'to', 'in']) AS term",
    "ratio": "SELECT yr, term, tdf.df FROM tdf JOIN dpy USING (yr) JOIN vocab USING (term) WHERE tdf.df / docs >= 0.20",
    "quota": "SELECT yr, floor(count(*) * CAST(0.002 AS DOUBLE)) AS quota FROM tdf GROUP BY yr",
    "topdf": "SELECT yr, term, df FROM (SELECT yr, term, tdf.df, quota, row_number() OVER (PARTITION BY yr ORDER BY tdf.df DESC, term) AS rn FROM tdf JOIN vocab USING (term) JOIN quota USING (yr) WHERE (yr, term) NOT IN (SELECT (yr, term) FROM ratio)) WHERE rn <= quota",
    "cut": "SELECT * FROM vec WHERE w <> 0 AND term NOT IN (SELECT term FROM stop) AND NOT EXISTS (SELECT 1 FROM ratio r WHERE r.yr = vec.yr AND r.term = vec.term) AND NOT EXISTS (SELECT 1 FROM topdf t WHERE t.yr = vec.yr AND t.term = vec.term)",
    "flt": "SELECT id, yr, term, term_id, w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 12) DESC, term) AS rn FROM cut) WHERE rn <= 30 AND w <> 0",
    "top": "SELECT id, yr, term, term_id, w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 12) DESC, term) AS rn FROM vec) WHERE rn <= 30 AND w <> 0",
    "sims": "SELECT a.yr AS yr_x, b.yr AS yr_y, a.id AS id_x, b.id AS id_y, count(*) AS n_terms, sum(a.w * b.w) AS sim FROM flt a JOIN flt b ON a.term_id = b.term_id AND b.yr > a.yr AND b.yr <= a.yr + 5 GROUP BY ALL",
    "hits": "SELECT * FROM sims WHERE sim >= 0.05",
    "sides": "SELECT id_x AS id, 0.0 AS bs, sim AS fs FROM hits UNION ALL SELECT id_y, sim, 0.0 FROM hits",
    "sums": "SELECT id, sum(bs) AS bs, sum(fs) AS fs FROM sides GROUP BY id",
    "scores": "SELECT id, yr, coalesce(bs, 0.0) AS bs, coalesce(fs, 0.0) AS fs FROM vdocs LEFT JOIN sums USING (id)",
    "years": "SELECT DISTINCT yr FROM vdocs",
    "ypairs": "SELECT a.yr AS yr_x, b.yr AS yr_y FROM years a JOIN years b ON b.yr > a.yr AND b.yr <= a.yr + 5",
    "perx": "SELECT yr_x, yr_y, id_x, count(*) AS touched, sum(CASE WHEN sim >= 0.05 THEN 1 ELSE 0 END) AS hits, sum(n_terms) AS ops FROM sims GROUP BY ALL",
    "everyx": "SELECT id, yr_x, yr_y FROM vdocs JOIN ypairs ON yr = yr_x",
    "bound": "SELECT yr_x, yr_y, f.id, f.term_id, f.w, round(f.w * coalesce(max_w, 0), 12) AS bound FROM flt f JOIN ypairs ON f.yr = yr_x LEFT JOIN (SELECT yr AS my, term_id AS mt, max(w) AS max_w FROM flt GROUP BY ALL) ON my = yr_y AND mt = f.term_id",
    "ranked": "SELECT *, row_number() OVER o AS k, count(*) OVER p AS n, sum(bound) OVER p AS total, sum(bound) OVER (o ROWS UNBOUNDED PRECEDING) AS upto FROM bound WINDOW p AS (PARTITION BY yr_x, yr_y, id), o AS (PARTITION BY yr_x, yr_y, id ORDER BY bound DESC, term_id)",
    "border": "SELECT yr_x, yr_y, id, term_id, w, k, n, total, CASE WHEN k = n THEN 0.0::DOUBLE ELSE round(total - upto, 9) END AS remain FROM ranked",
    "metk": "SELECT b.yr_x, b.yr_y, b.id, y.id AS id_y, b.k, b.n, b.w * y.w AS part FROM border b JOIN flt y ON y.yr = b.yr_y AND y.term_id = b.term_id",
    # Checked after every term from the first shared one on.
    "checks": "SELECT m.yr_x, m.yr_y, m.id, m.id_y, b.k, any_value(b.remain) AS remain, sum(m.part) AS acc FROM metk m JOIN border b ON b.yr_x = m.yr_x AND b.yr_y = m.yr_y AND b.id = m.id AND b.k >= m.k GROUP BY m.yr_x, m.yr_y, m.id, m.id_y, b.k",
    "ratios": "SELECT yr_x, yr_y, id, count(*) AS touched, count(*) FILTER (WHERE dead) AS dead FROM (SELECT yr_x, yr_y, id, id_y, bool_or(remain > 0 AND round(acc + remain, 9) < 0.05) AS dead FROM checks GROUP BY ALL) GROUP BY ALL",
    "left_over": "SELECT yr_x, yr_y, id, max(total) AS r0, max(CASE WHEN k = 1 THEN remain END) AS r1, max(CASE WHEN k = 3 THEN remain END) AS r3, max(CASE WHEN k = 5 THEN remain END) AS r5, max(CASE WHEN k = 10 THEN remain END) AS r10 FROM border GROUP BY ALL",
    "removed": "SELECT yr, term_id, min(step) AS step FROM (SELECT yr, term_id, 2 AS step FROM ratio JOIN vocab USING (term) UNION ALL SELECT yr, term_id, 3 FROM topdf JOIN vocab USING (term) UNION ALL SELECT yr, term_id, 1 FROM tdf JOIN vocab USING (term) JOIN stop USING (term)) GROUP BY ALL",
    "lens": "SELECT id, yr, (SELECT count(*) FROM flt WHERE flt.id = vdocs.id) AS n FROM vdocs",
    "vtdf": "SELECT yr, term, tdf.df FROM tdf SEMI JOIN vocab USING (term)",
    "topdfs": "SELECT yr, term_id, count(*) AS df FROM top GROUP BY ALL",
    "pairsum": "SELECT a.yr AS yr_1, b.yr AS yr_2, CAST(coalesce((SELECT sum(x.df * y.df) FROM vtdf x JOIN vtdf y ON x.term = y.term WHERE x.yr = a.yr AND y.yr = b.yr), 0) AS BIGINT) AS s FROM dpy a JOIN dpy b ON abs(a.yr - b.yr) <= 5",
    "bins": "SELECT * FROM (VALUES (0, 1), (1, 5), (5, 10), (10, 20), (20, 50), (50, 100), (100, 1000)) AS t(lo, hi)",
}


def sql(body: str) -> str:
    """body after the expressions that it needs, directly or not."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                visit(CTES[name])

    visit(body)
    parts = ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in need)
    return f"WITH {parts} {body}" if parts else body


R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)

BODIES = {
    "q_scan": "SELECT CAST(doc_id AS VARCHAR) AS id, lang, source AS title, n_chars FROM documents",
    "q_clean_docs": "SELECT id, yr, text FROM docs",
    "q_titled_docs": "SELECT id, yr, title, text, lang FROM docs",
    "q_years": "SELECT DISTINCT yr FROM docs",
    "q_stopwords": "SELECT DISTINCT trim(term) AS term FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE ' ' || source || '  ' END AS term FROM documents UNION ALL SELECT lang || ' ' FROM documents) WHERE trim(term) <> ''",
    "q_filter_type": "SELECT doc_id, source FROM documents WHERE lang = 'en'",
    "q_parse_year": "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders WHERE o_orderkey % 6 <> 5",
    "q_concat_text": "SELECT p_partkey, coalesce(p_name, '') || coalesce(nullif(p_brand, 'Brand#11'), '') || coalesce(p_type, '') AS text FROM part",
    "q_tokenize": "SELECT id, CAST(generate_subscripts(tokens, 1) - 1 AS INTEGER) AS pos, unnest(tokens) AS token FROM tok",
    "q_stop_antijoin": "SELECT id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS token FROM (SELECT id, list_filter(tokens, lambda x: x NOT IN ('the', 'of', 'and', 'to', 'in')) AS t FROM tok)",
    "q_dedup_first": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) = 1",
    "q_docs_per_year": "SELECT yr, docs FROM dpy",
    "q_docs_per_year_all": "SELECT yr, count(*) AS docs FROM docs GROUP BY yr",
    "q_term_df_year": "SELECT yr, term, df FROM tdf",
    "q_global_df": "SELECT term, df FROM gdf",
    "q_vocab": "SELECT term, df, term_id FROM vocab",
    "q_tf": "SELECT id, yr, term, term_id, tf FROM counts JOIN vocab USING (term)",
    "q_prior_docs": "SELECT yr, docs, n_prior FROM prior",
    "q_retro_idf": f"SELECT yr, term, df_prior, n_prior, {R('idf')} FROM idf",
    "q_tfidf": f"SELECT id, yr, term, tf, {R('w')} FROM tfidf",
    "q_tfidf_l2": f"SELECT id, yr, term, {R('w')} FROM vec",
    "q_prune_stop": f"SELECT id, term, {R('w')} FROM vec WHERE w <> 0 AND term NOT IN (SELECT term FROM stop)",
    "q_df_ratio_cols": "SELECT yr, term, df FROM ratio",
    "q_top_df_cols": "SELECT yr, term, df FROM topdf",
    "q_topk_terms": f"SELECT id, yr, term, {R('w')} FROM flt",
    "q_tokens_json": "SELECT yr, CAST(to_json({'id': id, 'title': title, 'tokens': tokens, 'lang': lang}) AS VARCHAR) AS line FROM tok",
    "q_postings_scan": f"SELECT id, yr, term_id, {R('w')} FROM flt",
    "q_prune_counts": """SELECT yr, nnz_before, nnz_stop, nnz_ratio, nnz_top, coalesce(nnz_after, 0) AS nnz_after FROM (SELECT yr, count(*) AS nnz_before, count(*) FILTER (WHERE w <> 0 AND coalesce(step, 9) > 1) AS nnz_stop, count(*) FILTER (WHERE w <> 0 AND coalesce(step, 9) > 2) AS nnz_ratio,
        count(*) FILTER (WHERE w <> 0 AND coalesce(step, 9) > 3) AS nnz_top FROM vec LEFT JOIN removed USING (yr, term_id) GROUP BY yr) LEFT JOIN (SELECT yr, count(*) AS nnz_after FROM flt GROUP BY yr) USING (yr)""",
    "q_postings": "SELECT yr, term_id, CAST(0 AS INTEGER) AS part, count(*) AS n_docs, string_agg(id, ',' ORDER BY id) AS ids, round(max(w), 6) AS max_w FROM flt GROUP BY yr, term_id",
    "q_posting_max": "SELECT yr, term_id, round(max(w), 6) AS max_w FROM vec GROUP BY yr, term_id",
    "q_year_pairs": "SELECT a.yr AS yr_x, b.yr AS yr_y FROM (SELECT DISTINCT yr FROM docs) a JOIN (SELECT DISTINCT yr FROM docs) b ON b.yr > a.yr AND b.yr <= a.yr + 5",
    "q_pair_sim": f"SELECT yr_x, yr_y, id_x, id_y, n_terms, {R('sim')} FROM sims",
    "q_pair_hits": f"SELECT yr_x, yr_y, id_x, id_y, {R('sim')} FROM hits",
    "q_pair_hits_prefix": f"SELECT yr_x, yr_y, id_x, id_y, {R('sim')} FROM hits",
    "q_pair_hits_bounded": f"SELECT yr_x, yr_y, id_x, id_y, {R('sim')} FROM hits",
    "q_contrib_x": "SELECT yr_x, yr_y, id_x AS id, round(sum(sim), 6) AS contrib FROM hits GROUP BY ALL",
    "q_contrib_y": "SELECT yr_x, yr_y, id_y AS id, round(sum(sim), 6) AS contrib FROM hits GROUP BY ALL",
    "q_pair_meta": """SELECT yr_x, yr_y, nx, ny, round(coalesce(touched, 0) / greatest(1, nx), 6) AS avg_touched, CAST(coalesce(max_touched, 0) AS BIGINT) AS max_touched, CAST(coalesce(h, 0) AS BIGINT) AS hits, CAST(0.05 AS DOUBLE) AS thr, CAST(5 AS INTEGER) AS window_size, 'v1' AS method_version
        FROM ypairs JOIN (SELECT yr AS yr_x, count(*) AS nx FROM vdocs GROUP BY yr) USING (yr_x) JOIN (SELECT yr AS yr_y, count(*) AS ny FROM vdocs GROUP BY yr) USING (yr_y)
        LEFT JOIN (SELECT yr_x, yr_y, sum(touched) AS touched, max(touched) AS max_touched, sum(hits) AS h FROM perx GROUP BY yr_x, yr_y) USING (yr_x, yr_y)""",
    "q_pair_sides": """SELECT yr_x, yr_y, side, id, round(sum(s), 6) AS contrib, CAST(sum(h) AS BIGINT) AS hits, count(*) AS touched, CAST(sum(n_terms) AS BIGINT) AS ops FROM (
        SELECT yr_x, yr_y, 'x' AS side, id_x AS id, CASE WHEN sim >= 0.05 THEN sim ELSE 0 END AS s, CASE WHEN sim >= 0.05 THEN 1 ELSE 0 END AS h, n_terms FROM sims
        UNION ALL SELECT yr_x, yr_y, 'y', id_y, CASE WHEN sim >= 0.05 THEN sim ELSE 0 END, CASE WHEN sim >= 0.05 THEN 1 ELSE 0 END, n_terms FROM sims) GROUP BY ALL""",
    "q_pair_diag": """SELECT yr_x, yr_y, round(avg(t), 6) AS touched_avg, round(quantile_cont(t, 0.9), 6) AS touched_p90, max(t) AS touched_max, CAST(sum(o) AS BIGINT) AS ops_total, round(avg(o), 6) AS ops_avg
        FROM (SELECT e.yr_x, e.yr_y, coalesce(touched, 0) AS t, coalesce(ops, 0) AS o FROM everyx e LEFT JOIN perx p ON p.yr_x = e.yr_x AND p.yr_y = e.yr_y AND p.id_x = e.id) GROUP BY yr_x, yr_y""",
    "q_bound_order": f"SELECT yr_x, yr_y, id, term_id, CAST(k AS INTEGER) AS k, {R('remain')} FROM border",
    "q_pair_bounds": """SELECT yr_x, yr_y, round(avg(ratio), 6) AS pruned_avg, round(quantile_cont(ratio, 0.9), 6) AS pruned_p90, round(avg(coalesce(r0, 0)), 6) AS remain_init, round(avg(coalesce(r1, 0)), 6) AS remain_k1, round(avg(coalesce(r3, 0)), 6) AS remain_k3,
        round(avg(coalesce(r5, 0)), 6) AS remain_k5, round(avg(coalesce(r10, 0)), 6) AS remain_k10
        FROM (SELECT *, CASE WHEN touched > 0 THEN dead / touched ELSE 0.0 END AS ratio FROM everyx LEFT JOIN ratios USING (yr_x, yr_y, id) LEFT JOIN left_over USING (yr_x, yr_y, id)) GROUP BY yr_x, yr_y""",
    "q_bs_fs": f"SELECT id, yr, {R('bs', 'fs')} FROM scores",
    "q_bs_fs_year": f"SELECT id, yr, {R('bs', 'fs')} FROM scores WHERE yr = 2014",
    "q_quality": f"SELECT id, yr, {R('bs', 'fs')}, CASE WHEN bs > 0 THEN round(fs / (bs + 1e-8), 4) ELSE round(fs / (bs + 1e-8) / 1e8, 6) END AS q FROM scores",
    "q_final": "SELECT id, CAST(yr AS VARCHAR) AS yr, title, printf('%.8f', b) AS BS, printf('%.8f', f) AS FS, printf('%.8f', f / (b + 1.0)) AS Quality_q, lang FROM (SELECT id, yr, title, lang, round(bs, 6) AS b, round(fs, 6) AS f FROM scores JOIN tok USING (id, yr))",
    "q_avg_vocab_usage": "SELECT yr, count(*) AS docs, round(avg(n), 6) AS avg_terms FROM (SELECT id, yr, count(*) AS n FROM vec GROUP BY ALL) GROUP BY yr",
    "q_row_len_profile": "SELECT yr, count(*) AS n_rows, round(avg(n), 6) AS avg_len, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS max_len FROM lens GROUP BY yr",
    "q_row_len_hist": "SELECT yr, lo, hi, (SELECT count(*) FROM lens l WHERE l.yr = y.yr AND l.n >= lo AND (l.n < hi OR hi = 1000 AND l.n = 1000)) AS n, round((SELECT count(*) FROM lens l WHERE l.yr = y.yr AND l.n >= lo AND (l.n < hi OR hi = 1000 AND l.n = 1000)) / (SELECT count(*) FROM lens l WHERE l.yr = y.yr) * 100, 6) AS pct FROM years y CROSS JOIN bins",
    "q_topk_weight_stats": "SELECT yr, count(*) AS docs, round(avg(coalesce(s, 0)), 6) AS mean_sum, round(avg(coalesce(s2, 0)), 6) AS mean_sum_sq FROM vdocs LEFT JOIN (SELECT id, sum(w) AS s, sum(w * w) AS s2 FROM top GROUP BY id) USING (id) GROUP BY yr",
    "q_topk_df": "SELECT yr, term_id, df FROM topdfs",
    "q_topk_df_pair_sum": "SELECT a.yr AS yr_1, b.yr AS yr_2, CAST(coalesce((SELECT sum(x.df * y.df) FROM topdfs x JOIN topdfs y ON x.term_id = y.term_id WHERE x.yr = a.yr AND y.yr = b.yr), 0) AS BIGINT) AS s FROM years a JOIN years b ON abs(a.yr - b.yr) <= 5",
    "q_df_pair_sum": "SELECT yr_1, yr_2, s FROM pairsum",
    "q_df_pair_total": "SELECT CAST(sum(s) AS BIGINT) AS total FROM pairsum",
    "q_yearly_top_vocab": "SELECT yr, CAST(rn AS INTEGER) AS rank, term, df, round(df / docs * 100, 6) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY df DESC, term) AS rn FROM tdf) JOIN dpy USING (yr) WHERE rn <= 50",
    "q_yearly_vocab_size": "SELECT yr, count(*) AS terms FROM vtdf GROUP BY yr",
    "q_vocab_union": "SELECT count(DISTINCT term) AS terms FROM tdf",
    "q_row_count": "SELECT count(*) AS n_rows FROM events",
    "q_preview": "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 20",
}

ORACLES = {name: sql(body) for name, body in BODIES.items()}
