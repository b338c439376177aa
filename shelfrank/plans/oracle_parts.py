"""Longer parts of the queries' SQL."""

from __future__ import annotations

from shelfrank.sources.testdata import with_sql

TOKENS = r"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+')) AS term FROM documents) """

BM25 = r"""WITH t0 AS (SELECT doc_id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM documents),
dl AS (SELECT doc_id, len(w) AS dl FROM t0), tok AS (SELECT doc_id, unnest(w) AS term FROM t0), postings AS (SELECT term, doc_id, COUNT(*) AS tf FROM tok GROUP BY 1, 2),
d AS (SELECT term, COUNT(*) AS df FROM postings GROUP BY 1), r AS (SELECT term, df, ln(((SELECT COUNT(*) FROM dl) - df + 0.5) / (df + 0.5)) AS raw FROM d),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT AVG(raw) FROM r) ELSE raw END AS idf FROM r) """

_REASON = """CASE WHEN len(tags) > 0 AND NOT list_bool_or(list_transform(tags, lambda x: contains(lower(category), x))) THEN 'category_mismatch'
 WHEN (min_price IS NOT NULL OR max_price IS NOT NULL) AND price IS NULL THEN 'price_missing' WHEN price < min_price THEN 'price_below_min' WHEN price > max_price THEN 'price_above_max'
 WHEN len(brands) > 0 AND NOT list_contains(brands, lower(brand)) THEN 'brand_mismatch' WHEN list_contains(excluded, lower(brand)) THEN 'brand_excluded'"""

FUSION = with_sql("items") + f""", req AS (SELECT CAST(c_custkey AS VARCHAR) AS request_id, c_custkey % 2 = 0 AS known_user,
 CASE c_custkey % 4 WHEN 1 THEN ['small'] WHEN 2 THEN ['eco', 'promo'] ELSE [] END AS tags, CASE WHEN c_custkey % 3 = 0 THEN 900.0::DOUBLE + abs(c_acctbal) / 100 END AS min_price,
 CASE WHEN c_custkey % 5 = 0 THEN 1500.0::DOUBLE END AS max_price, CASE WHEN c_custkey % 7 = 0 THEN ['brand#1', 'brand#2', 'brand#3'] ELSE [] END AS brands,
 CASE WHEN c_custkey % 6 = 0 THEN ['brand#4', 'brand#5'] ELSE [] END AS excluded, CASE WHEN c_custkey % 8 = 1 THEN ['red', 'blue'] ELSE [] END AS colors FROM customer),
lines AS (SELECT CAST(o_custkey AS VARCHAR) AS request_id, CAST(l_partkey AS VARCHAR) AS parent_asin, l_quantity, l_extendedprice, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
own AS (SELECT request_id, parent_asin, MAX(l_quantity) AS a, MAX(l_extendedprice) AS b, MAX(epoch(l_shipdate)) AS c FROM lines GROUP BY 1, 2),
pop AS (SELECT parent_asin, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, parent_asin) AS rank FROM lines GROUP BY 1 QUALIFY rank <= 30),
cand AS (SELECT 'dense' AS channel, 1 AS o, request_id, parent_asin, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY a DESC, parent_asin) AS rank FROM own QUALIFY rank <= 30
 UNION ALL SELECT 'bm25', 2, request_id, parent_asin, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY b DESC, parent_asin) AS rank FROM own QUALIFY rank <= 30
 UNION ALL SELECT 'lightgcn', 3, request_id, parent_asin, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY c DESC, parent_asin) AS rank FROM own QUALIFY rank <= 30
 UNION ALL SELECT 'popularity', 4, req.request_id, pop.parent_asin, pop.rank FROM req, pop),
merged AS (SELECT request_id, parent_asin, list(channel ORDER BY o) AS sources, MIN(rank) AS best_rank, bool_or(o <= 2) AS search,
 SUM(CASE channel WHEN 'dense' THEN 0.45 WHEN 'bm25' THEN 0.25 WHEN 'lightgcn' THEN 0.25 ELSE 0.05 END::DOUBLE / (60 + rank)) AS known_score,
 SUM(CASE channel WHEN 'dense' THEN 0.65 WHEN 'bm25' THEN 0.30 WHEN 'popularity' THEN 0.05 END::DOUBLE / (60 + rank)) AS cold_score FROM cand GROUP BY 1, 2),
facts AS (SELECT m.*, r.* EXCLUDE (request_id), i.* EXCLUDE (parent_asin) FROM merged m JOIN req r ON r.request_id = m.request_id LEFT JOIN items i ON i.parent_asin = m.parent_asin),
judged AS (SELECT *, CASE WHEN search THEN 'search' ELSE 'personalized' END AS policy, {_REASON} WHEN len(colors) > 0 AND NOT list_contains(colors, color) THEN 'color_mismatch' END AS full_reason,
 CASE WHEN NOT search AND len(tags) = 0 THEN 'missing_category_constraint' WHEN search THEN {_REASON} END ELSE {_REASON} WHEN len(colors) > 0 AND NOT list_contains(colors, color) THEN 'color_mismatch' END END AS reason FROM facts),
ranked AS (SELECT *, CASE WHEN known_user THEN known_score ELSE cold_score END AS score, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY ROUND(CASE WHEN known_user THEN known_score ELSE cold_score END, 12) DESC, best_rank, parent_asin) AS rank
 FROM judged WHERE reason IS NULL AND CASE WHEN known_user THEN known_score ELSE cold_score END IS NOT NULL) """

_DOT = "list_sum(list_transform(list_zip(p.v, c.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"

EVIDENCE = with_sql("chunks") + f""", pairs AS (SELECT parent_asin, arg_min(embedding, vec_id) AS v FROM chunks GROUP BY 1),
scored AS (SELECT c.parent_asin, c.chunk_id, c.review_id, c.rating, {_DOT} AS score FROM chunks c JOIN pairs p ON p.parent_asin = c.parent_asin),
found AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY parent_asin ORDER BY ROUND(score, 9) DESC, chunk_id) AS rank FROM scored),
low AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY parent_asin ORDER BY ROUND(score, 9) DESC, chunk_id) AS lrank FROM scored WHERE rating <= 3 QUALIFY lrank <= 20),
few AS (SELECT parent_asin, COUNT(DISTINCT review_id) AS n FROM found WHERE rank <= 10 GROUP BY 1),
kept AS (SELECT f.* FROM found f JOIN few ON few.parent_asin = f.parent_asin WHERE rank <= 10 OR (rank <= 20 AND n < 5)),
began AS (SELECT *, MIN(rank) OVER (PARTITION BY parent_asin, review_id) AS b FROM kept),
chosen AS (SELECT *, DENSE_RANK() OVER (PARTITION BY parent_asin ORDER BY b) AS place FROM began QUALIFY place <= 5),
state AS (SELECT parent_asin, MAX(place) AS places FROM chosen GROUP BY 1 HAVING COUNT(*) FILTER (rating <= 3) = 0),
best AS (SELECT l.*, least(places + 1, 5) AS place FROM low l JOIN state s ON s.parent_asin = l.parent_asin ANTI JOIN chosen c ON c.parent_asin = l.parent_asin AND c.review_id = l.review_id QUALIFY ROW_NUMBER() OVER (PARTITION BY l.parent_asin ORDER BY lrank) = 1),
final AS (SELECT c.parent_asin, c.chunk_id, c.review_id, c.rating, c.rank, c.place, false AS added FROM chosen c LEFT JOIN best b ON b.parent_asin = c.parent_asin WHERE b.place IS NULL OR c.place < b.place
 UNION ALL SELECT parent_asin, chunk_id, review_id, rating, lrank, place, true FROM best) """

GRAPH = with_sql("interactions", "splits") + """, e AS (SELECT 'u:' || user_id AS a, 'i:' || parent_asin AS b FROM splits WHERE split = 'train'), edges AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
deg AS (SELECT a AS node, COUNT(*) AS d FROM edges GROUP BY 1), w AS (SELECT e.a, e.b, 1 / sqrt(x.d * y.d) AS w FROM edges e JOIN deg x ON x.node = e.a JOIN deg y ON y.node = e.b),
n0 AS (SELECT node, CASE WHEN node LIKE 'u:%' THEN CAST(substr(node, 3) AS DOUBLE) / 1000 ELSE -CAST(substr(node, 3) AS DOUBLE) / 2000 END AS x, CAST(substr(node, 3) AS DOUBLE) % 7 AS y FROM deg),
n1 AS (SELECT w.b AS node, SUM(w * x) AS x, SUM(w * y) AS y FROM w JOIN n0 ON n0.node = w.a GROUP BY 1), n2 AS (SELECT w.b AS node, SUM(w * x) AS x, SUM(w * y) AS y FROM w JOIN n1 ON n1.node = w.a GROUP BY 1),
final AS (SELECT n0.node, n0.x AS x0, n1.x AS x1, n2.x AS x2, n0.y AS y0, n1.y AS y1, n2.y AS y2 FROM n0 JOIN n1 ON n1.node = n0.node JOIN n2 ON n2.node = n0.node) """
