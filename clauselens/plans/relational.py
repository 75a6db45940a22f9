"""SQL of relational operators over the mapped schema (`framed` has most of them in DataFrame code): company = nation, product = supplier, coverage = (supplier, part),
benefit = line of an order, plan = order, document and clause = documents and their lines."""

from clauselens.registry import sql_query

STAR = "lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey"
MONEY = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

QUERIES = {
    # filters and predicates
    "filter_in": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_in_null": "SELECT doc_id, CASE WHEN lang IN ('fr', NULL) THEN 1 WHEN NOT (lang IN ('fr', NULL)) THEN 0 END AS verdict FROM documents",
    "filter_between_open": "SELECT p_partkey, p_size FROM part WHERE (p_size >= 10 OR p_size IS NULL) AND p_size BETWEEN 5 AND 30",
    "filter_length": "SELECT doc_id, LENGTH(text) AS n FROM documents WHERE LENGTH(text) >= 50",
    "like_all": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_name LIKE '%e%'",
    "like_any": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' OR p_name LIKE '%bolt'",
    "not_like_except": "SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE '%M%' OR p_type LIKE '%MEDIUM%'",
    "min_or_null": "SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0.0) AS discount FROM lineitem WHERE NULLIF(l_discount, 0.0) >= 0.05 OR NULLIF(l_discount, 0.0) IS NULL",
    # joins
    "join_star": f"SELECT l.l_orderkey, l.l_linenumber, s.s_name, n.n_name, p.p_name FROM {STAR}",
    "join_left_enrich": "SELECT d.doc_id, b.quality, b.toxic FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id",
    "join_anti": "SELECT d.doc_id FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id WHERE b.doc_id IS NULL",
    "join_semi_multi": "SELECT s_suppkey, s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_discount >= 0.1)",
    "join_name_only": "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_name IS NOT NULL",
    "join_pairs": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE a.s_acctbal > 5000 AND b.s_acctbal > 5000",
    "join_two_company": f"WITH t AS (SELECT n.n_name AS company, p.p_brand AS brand, MAX(l.l_extendedprice) AS best FROM {STAR} GROUP BY n.n_name, p.p_brand) SELECT a.brand, a.company AS company_a, b.company AS company_b, a.best AS best_a, b.best AS best_b FROM t a JOIN t b ON a.brand = b.brand AND a.company < b.company",
    "join_codes": "SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    "update_from_join": "SELECT d.doc_id, COALESCE(b.quality, 0) AS quality, COALESCE(b.toxic, 0) AS toxic FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id",
    # aggregations
    "agg_link_stats": f"SELECT l_shipmode, n, total / n AS mean FROM (SELECT l_returnflag AS l_shipmode, COUNT(*) AS n, {MONEY.format('l_quantity')} AS total FROM lineitem GROUP BY l_returnflag) t",
    "agg_by_type": "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type",
    "agg_having_top": "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey HAVING COUNT(o.o_orderkey) > 0 ORDER BY n DESC, c.c_custkey LIMIT 10",
    "agg_document_stats": "SELECT lang, COUNT(DISTINCT source) AS sources, COUNT(CASE WHEN LENGTH(text) > 1000 THEN 1 END) AS long_docs, CAST(SUM(n_chars) AS DOUBLE) / COUNT(*) AS mean_chars FROM documents GROUP BY lang",
    "agg_cond_distinct": f"SELECT n.n_name, COUNT(DISTINCT CASE WHEN l.l_returnflag = 'R' THEN l.l_partkey END) AS returned, COUNT(DISTINCT CASE WHEN l.l_discount > 0.05 THEN l.l_partkey END) AS reduced FROM {STAR} GROUP BY n.n_name",
    "agg_max_company": f"SELECT n.n_name, MAX(l.l_extendedprice) AS most FROM {STAR} WHERE p.p_type LIKE '%A%' AND p.p_type NOT LIKE 'SMALL%' GROUP BY n.n_name",
    "agg_doc_list": "SELECT d.doc_id, COUNT(b.doc_id) AS n_labels FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id GROUP BY d.doc_id",
    "agg_table_counts": "SELECT 'documents' AS name, COUNT(*) AS n FROM documents UNION ALL SELECT 'labels', COUNT(*) FROM labels UNION ALL SELECT 'orders', COUNT(*) FROM orders UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem",
    "agg_embedding_stats": "SELECT label, COUNT(*) AS n, COUNT(embedding) AS filled FROM embeddings GROUP BY label",
    "agg_mode": "SELECT lang, source FROM (SELECT lang, source, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY n DESC, first_id) AS rn FROM (SELECT lang, source, COUNT(*) AS n, MIN(doc_id) AS first_id FROM documents GROUP BY lang, source) c) t WHERE rn = 1",
    "agg_eval_sets": "SELECT lang, source, COUNT(*) AS total, SUM(quality) AS success, CAST(SUM(quality) AS DOUBLE) / COUNT(*) AS accuracy FROM (SELECT d.lang, d.source, b.quality FROM documents d JOIN labels b ON d.doc_id = b.doc_id) t GROUP BY GROUPING SETS ((), (lang), (source))",
    "agg_amount_type": f"SELECT p.p_type, COUNT(l.l_extendedprice) AS n, MAX(l.l_extendedprice) AS most, {MONEY.format('l.l_extendedprice')} / COUNT(*) AS mean FROM {STAR} GROUP BY p.p_type",
    "agg_two_level": "SELECT r.r_name, COUNT(DISTINCT n.n_nationkey) AS parents, COUNT(s.s_suppkey) AS children FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY r.r_name",
    "agg_fill_rate": "SELECT COUNT(*) AS total, COUNT(NULLIF(l_discount, 0.0)) AS filled, 100.0E0 * COUNT(NULLIF(l_discount, 0.0)) / COUNT(*) AS rate FROM lineitem",
    "distinct_rows": "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem",
    # windows, ranking, top-k
    "win_dedupe_prefix": "SELECT doc_id FROM (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY source, SUBSTRING(text, 1, 200) ORDER BY doc_id) AS rn FROM documents) t WHERE rn = 1",
    "topk_per_group": f"SELECT company, l_orderkey, l_linenumber, rank_no FROM (SELECT n.n_name AS company, l.l_orderkey, l.l_linenumber, ROW_NUMBER() OVER (PARTITION BY n.n_name ORDER BY l.l_extendedprice DESC, l.l_orderkey, l.l_linenumber) AS rank_no FROM {STAR}) t WHERE rank_no <= 5",
    "interleave": "SELECT s_suppkey, rank_no, s_nationkey FROM (SELECT s_suppkey, s_nationkey, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank_no FROM supplier) t ORDER BY rank_no, s_nationkey LIMIT 20",
    "dedupe_first": "SELECT user_id, event_id FROM (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) t WHERE rn = 1",
    "rank_weighted": "SELECT doc_id, n_chars * CASE lang WHEN 'en' THEN 1.2E0 WHEN 'fr' THEN 1.15E0 WHEN 'de' THEN 1.1E0 ELSE 1.0E0 END AS weighted FROM documents",
    "citations": "SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS citation FROM conversations WHERE role = 'assistant'",
    "sources_dedupe": "SELECT source, doc_id FROM (SELECT source, doc_id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM (SELECT source, MIN(doc_id) AS doc_id FROM documents GROUP BY source, SUBSTRING(text, 1, 100)) u) t WHERE place <= 3",
    "top1_priority": "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type LIKE '%ECONOMY%' THEN 0 ELSE 1 END, LENGTH(p_name), p_retailprice DESC NULLS LAST, p_partkey) AS rn FROM part) t WHERE rn = 1",
    "top5_case": "SELECT p_brand, p_partkey, rn FROM (SELECT p_brand, p_partkey, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type LIKE '%PROMO%' THEN 1 WHEN p_type LIKE '%MEDIUM%' THEN 2 ELSE 3 END, p_partkey) AS rn FROM part) t WHERE rn <= 5",
    "win_gap": "SELECT o_custkey, o_totalprice - following AS gap FROM (SELECT o_custkey, o_totalprice, LEAD(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS following, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn = 1 AND following IS NOT NULL",
    "candidate_merge": "SELECT doc_id, origin FROM (SELECT doc_id, origin, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY origin) AS rn FROM (SELECT doc_id, 1 AS origin FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 2 FROM labels WHERE toxic = 0 UNION ALL SELECT doc_id, 3 FROM documents WHERE lang = 'es') u) t WHERE rn = 1",
    "topn_amount": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice IS NOT NULL ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
    "carry_last_topic": "SELECT conv_id, turn, MAX(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user_turn FROM conversations",
    # set operations
    "set_except": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "set_intersect": "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'",
    # graph as node and edge tables
    "graph_path3": "SELECT r.r_name, n.n_name, s.s_name FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey",
    "graph_orphans": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL",
    "graph_dupes": "SELECT l_orderkey, l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING COUNT(*) > 1",
    "graph_counts": "SELECT n.n_name, p.p_brand, COUNT(DISTINCT l.l_partkey) AS n FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey GROUP BY n.n_name, p.p_brand",
    "graph_neighbors": "SELECT s.s_suppkey, 'out' AS direction, l.l_partkey AS neighbour FROM supplier s JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) l ON l.l_suppkey = s.s_suppkey UNION ALL SELECT s.s_suppkey, 'in', CAST(s.s_nationkey AS BIGINT) FROM supplier s",
    # data quality
    "dq_reconcile": "SELECT COALESCE(a.source, b.source) AS source, COALESCE(a.n, 0) AS left_n, COALESCE(b.n, 0) AS right_n, COALESCE(a.n, 0) = COALESCE(b.n, 0) AS matches FROM (SELECT source, COUNT(*) AS n FROM documents GROUP BY source) a FULL OUTER JOIN (SELECT d.source, COUNT(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source) b ON a.source = b.source",
    "dq_amount_outlier": f"SELECT n.n_name, COUNT(CASE WHEN l.l_extendedprice < 2000 THEN 1 END) AS low, 100.0E0 * COUNT(CASE WHEN l.l_extendedprice < 2000 THEN 1 END) / COUNT(*) AS share FROM {STAR} GROUP BY n.n_name",
    "dq_gate": "SELECT 100.0E0 * SUM(CASE WHEN ok THEN 1 ELSE 0 END) / COUNT(*) AS pass_rate FROM (SELECT COUNT(*) > 0 AS ok FROM documents UNION ALL SELECT COUNT(*) = COUNT(DISTINCT doc_id) FROM documents UNION ALL SELECT SUM(CASE WHEN l_quantity < 0 THEN 1 ELSE 0 END) = 0 FROM lineitem) t",
    # composite jobs and documented use cases
    "list_companies": "SELECT DISTINCT n.n_nationkey, n.n_name FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey",
    "list_products": "SELECT DISTINCT s.s_suppkey, s.s_name, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "plan_validate": "SELECT l.l_orderkey, l.l_linenumber, CASE WHEN p.p_partkey IS NULL THEN 'missing' WHEN l.l_extendedprice > 30 * p.p_retailprice THEN 'mismatch' ELSE 'ok' END AS verdict FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey",
}

for _name, _sql in QUERIES.items():
    sql_query(_name, _sql)
