"""Registered queries on requests, tags, explanations, labels and payloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfrank.functions import text as t
from shelfrank.operators import blocks, chunking, constraints, dense, evidence, fusion, lexical, popularity, preprocess, profile, recommend
from shelfrank.plans import catalogue as c
from shelfrank.plans.catalogue import query
from shelfrank.plans.oracle_parts import BM25, EVIDENCE, FUSION, GRAPH
from shelfrank.sources import testdata as td
from shelfrank.sources.shared import cut, shared_dir
from shelfrank.sources.testdata import with_sql
from shelfrank.streaming import evidence_index

# Requests and tags.

_ASKED = "CASE c_custkey % 4 WHEN 0 THEN '红色' || c_mktsegment WHEN 1 THEN ' 蓝 ' || c_mktsegment WHEN 2 THEN '  ' ELSE ' ' || c_name || ' ' END"


def _asked(spark, root):
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    text = F.when(key % 4 == 0, F.concat(F.lit("红色"), segment)).when(key % 4 == 1, F.concat(F.lit(" 蓝 "), segment)).when(key % 4 == 2, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    requests = td.read_table(spark, root, "customer").select(key.cast("string").alias("request_id"), text.alias("query"))
    english = td.read_table(spark, root, "customer").select(F.concat(F.lit("红色"), segment).alias("query"), F.concat(F.lit(" red "), F.lower(segment)).alias("english")).distinct()
    return constraints.prepare_search_query(requests, english)


@query("SELECT CAST(c_custkey AS VARCHAR) AS request_id, CASE WHEN c_custkey % 4 = 0 THEN 'red ' || lower(c_mktsegment) ELSE c_name END AS search_query FROM customer WHERE c_custkey % 4 IN (0, 3)")
def search_queries(spark, root):
    return _asked(spark, root).ok.select("request_id", "search_query")


@query("SELECT CAST(c_custkey AS VARCHAR) AS request_id, CASE WHEN c_custkey % 4 = 1 THEN 'no translation' ELSE 'blank query' END AS error FROM customer WHERE c_custkey % 4 IN (1, 2)")
def search_query_errors(spark, root):
    return _asked(spark, root).errors.select("request_id", "error")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, [lower(p_type)] AS category_tags, CASE WHEN p_partkey % 4 = 0 THEN [] ELSE [split_part(p_name, ' ', 1)] END AS color_tags,
CASE WHEN p_partkey % 4 = 0 THEN [] ELSE ['m' || p_size, 'steel'] END AS material_tags FROM part""")
def item_tags(spark, root):
    details = F.concat(F.lit('{"Color": "'), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit('", "Color Name": 7, "Material": [" M'), "p_size", F.lit('", [" Steel "], null], "Size": 3'), F.when(F.col("p_partkey") % 4 == 0, "").otherwise("}"))
    tags = constraints.category_tags(F.array("p_type", F.concat(F.lower("p_type"), F.lit(" ")), F.lit("  ")))
    return td.read_table(spark, root, "part").select(F.col("p_partkey").cast("string").alias("parent_asin"), tags.alias("category_tags"), constraints.color_tags(details).alias("color_tags"), constraints.material_tags(details).alias("material_tags"))


def _priced(spark, root):
    key = F.col("c_custkey")
    low = F.when(key % 5 == 0, float("inf")).when(key % 5 == 1, 900.0).when(key % 5 == 2, F.col("c_acctbal"))
    high = F.when(key % 7 == 0, float("nan")).when(key % 7 != 1, F.lit(500.0))
    return constraints.validate_constraints(td.read_table(spark, root, "customer").select(key.cast("string").alias("request_id"), low.alias("min_price"), high.alias("max_price")))


@query("""WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS request_id, c_custkey % 5 = 0 OR c_custkey % 7 = 0 AS odd, CASE c_custkey % 5 WHEN 1 THEN 900.0::DOUBLE WHEN 2 THEN c_acctbal END AS low, CASE WHEN c_custkey % 7 <> 1 THEN 500.0::DOUBLE END AS high FROM customer)
SELECT request_id, CASE WHEN odd THEN 'not a finite price' WHEN low > high THEN 'min_price is greater than max_price' ELSE 'ok' END AS verdict FROM p""")
def constraint_verdicts(spark, root):
    checked = _priced(spark, root)
    return checked.ok.select("request_id", F.lit("ok").alias("verdict")).unionByName(checked.errors.select("request_id", F.col("error").alias("verdict")))


@query(FUSION + "SELECT channel, COUNT(*) AS kept FROM cand SEMI JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) p ON CAST(p.p_partkey AS VARCHAR) = cand.parent_asin GROUP BY channel")
def known_candidates(spark, root):
    catalog = td.items(spark, root).where(F.col("parent_asin").cast("long") % 5 != 0)
    return recommend.only_known_items(c._candidates(spark, root), catalog).groupBy("channel").agg(F.count("*").alias("kept"))


@query("""WITH x AS (SELECT CAST(c_custkey AS VARCHAR) AS request_id, c_custkey AS k, CAST(c_custkey % 40 AS VARCHAR) AS item FROM customer),
r AS (SELECT request_id, item, 'dense' AS channel, CASE WHEN k % 3 = 0 THEN 2 WHEN k % 3 = 1 THEN 1 END AS rank FROM x UNION ALL SELECT request_id, item, 'bm25', CASE WHEN k % 4 = 0 THEN 3 ELSE 7 END FROM x)
SELECT request_id, list(channel ORDER BY channel DESC) AS sources, list(coalesce(rank, 1) ORDER BY channel DESC) AS ranks FROM r GROUP BY request_id""")
def merged_ranks(spark, root):
    """Ranks that are absent, zero or negative become places of the list, and the last of repeats counts."""
    key = F.col("c_custkey")
    one = lambda name, rank, place: F.struct(F.lit(name).alias("channel"), rank.cast("int").alias("rank"), F.lit(place).alias("place"))
    dense_rank = F.when(key % 3 == 0, 0).when(key % 3 == 1, -60)
    rows = F.array(one("dense", F.lit(9), 1), one("dense", dense_rank, 2), one("bm25", F.lit(7), 1), one("bm25", F.when(key % 4 == 0, None).otherwise(7), 3))
    dense_one = F.filter(rows, lambda x: (x["channel"] == "bm25") | (x["place"] == F.when(key % 3 == 0, 2).otherwise(1)))
    base = td.read_table(spark, root, "customer").select(key.cast("string").alias("request_id"), key, (key % 40).cast("string").alias("parent_asin"), F.explode(dense_one).alias("x"))
    listed = base.select("request_id", F.concat(F.lit(" "), "parent_asin").alias("parent_asin"), "x.*", F.lit(0.5).alias("score"))
    fixed = F.when((F.col("channel") == "dense") & (F.col("place") == 1), F.when(F.col("request_id").cast("long") % 3 == 1, -1)).otherwise(F.col("rank"))
    found = fusion.merge(listed.withColumn("rank", fixed))
    return found.select("request_id", "sources", F.transform("e", lambda e: e["rank"]).alias("ranks"))


# Recommendations end to end: requests of every twentieth customer, half of them with a user.

_TAIL = lambda sql, *names: sql[len(with_sql(*names)) :].rstrip()
_LEXICAL = BM25.removeprefix("WITH ").replace("SELECT doc_id, regexp", "SELECT CAST(p_partkey AS VARCHAR) AS doc_id, regexp").replace("coalesce(text, '')", "coalesce(p_name, '')").replace("FROM documents", "FROM part").rstrip()
_DOT = "list_sum(list_transform(list_zip(q.vector, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_SEARCH = f"""asked AS (SELECT CAST(c_custkey AS VARCHAR) AS request_id, p_name AS query, embedding AS vector FROM customer JOIN part ON p_partkey = c_custkey LEFT JOIN embeddings ON vec_id = c_custkey WHERE c_custkey % 20 = 0),
qt AS (SELECT request_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM asked),
bs AS (SELECT request_id, p.doc_id AS parent_asin, SUM(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT AVG(dl) FROM dl)))) AS score FROM qt JOIN postings p ON p.term = qt.term JOIN terms ON terms.term = p.term JOIN dl ON dl.doc_id = p.doc_id GROUP BY 1, 2),
b30 AS (SELECT request_id, parent_asin, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY ROUND(score, 9) DESC, parent_asin) AS rank FROM bs QUALIFY rank <= 30),
d30 AS (SELECT q.request_id, CAST(v.vec_id AS VARCHAR) AS parent_asin, ROW_NUMBER() OVER (PARTITION BY q.request_id ORDER BY ROUND({_DOT}, 9) DESC, CAST(v.vec_id AS VARCHAR)) AS rank FROM asked q, embeddings v WHERE q.vector IS NOT NULL QUALIFY rank <= 30)"""
_KNOWN = "(c_custkey % 40 = 0 AND CAST(c_custkey AS VARCHAR) IN (SELECT user_id FROM splits WHERE split = 'train'))"
_REQUESTS, _, _REST = _TAIL(FUSION, "items").partition("lines AS (")
_REQUESTS = _REQUESTS.replace("c_custkey % 2 = 0 AS known_user", f"{_KNOWN} AS known_user").replace("FROM customer)", "FROM customer WHERE c_custkey % 20 = 0)").rstrip().rstrip(",")
_FUSED = with_sql("items", "interactions", "splits") + _TAIL(GRAPH, "interactions", "splits").replace("final AS (", "layers AS (") + _REQUESTS + ", " + _LEXICAL + ", " + _SEARCH + """,
v AS (SELECT node, (x0 + x1 + x2) / 3 AS a, (y0 + y1 + y2) / 3 AS b FROM layers), history AS (SELECT user_id, parent_asin FROM splits WHERE split = 'train'),
g30 AS (SELECT q.request_id, substr(i.node, 3) AS parent_asin, ROW_NUMBER() OVER (PARTITION BY q.request_id ORDER BY ROUND(u.a * i.a + u.b * i.b, 9) DESC, substr(i.node, 3)) AS rank FROM req q JOIN v u ON q.known_user AND u.node = 'u:' || q.request_id, v i
 WHERE i.node LIKE 'i:%' AND NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = q.request_id AND h.parent_asin = substr(i.node, 3)) QUALIFY rank <= 30),
counted AS (SELECT parent_asin, COUNT(*) AS n FROM history GROUP BY 1),
p30 AS (SELECT q.request_id, counted.parent_asin, ROW_NUMBER() OVER (PARTITION BY q.request_id ORDER BY n DESC, counted.parent_asin) AS rank FROM req q, counted
 WHERE NOT q.known_user OR NOT EXISTS (SELECT 1 FROM history h WHERE h.user_id = q.request_id AND h.parent_asin = counted.parent_asin) QUALIFY rank <= 30),
cand AS (SELECT 'dense' AS channel, 1 AS o, * FROM d30 UNION ALL SELECT 'bm25', 2, * FROM b30 UNION ALL SELECT 'lightgcn', 3, * FROM g30 UNION ALL SELECT 'popularity', 4, * FROM p30), merged AS (""" + _REST.partition("merged AS (")[2]


def _batch(spark, root):
    key = F.col("c_custkey")
    names = td.read_table(spark, root, "part").select(F.col("p_partkey").alias("c_custkey"), F.col("p_name").alias("search_query"))
    vectors = td.read_table(spark, root, "embeddings").select(F.col("vec_id").alias("c_custkey"), F.col("embedding").alias("vector"))
    asked = td.read_table(spark, root, "customer").where(key % 20 == 0)  # the stated queries
    return asked.join(names, "c_custkey").join(vectors, "c_custkey", "left").select(key.cast("string").alias("request_id"), "search_query", "vector", F.when(key % 40 == 0, F.concat(F.lit(" "), key)).alias("user_id"), F.lit(10).alias("top_k"))


def _search_tables(spark, root):
    index = lexical.build_lexical_index(td.read_table(spark, root, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.col("p_name").alias("text")))
    return index, td.read_table(spark, root, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))


@query(_FUSED + "SELECT request_id, parent_asin, CAST(rank AS INTEGER) AS rank, ROUND(score, 6) AS score, array_to_string(sources, ',') AS sources FROM ranked")
def recommend_batch(spark, root):
    train = cut(td.splits(spark, root).where("split = 'train'").select("user_id", "parent_asin"))
    index, vectors = _search_tables(spark, root)
    wanted = c._requests(spark, root).drop("known_user", "top_k")
    fused = recommend.recommend_batch(cut(_batch(spark, root)), wanted, c._items(spark, root), index, vectors, train, cut(c._propagated(train)))
    return fused.ranked.select("request_id", "parent_asin", "rank", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"))


@query("WITH " + _LEXICAL + ", " + _SEARCH + """, both_ AS (SELECT 0.65::DOUBLE AS w, * FROM d30 UNION ALL SELECT 0.30::DOUBLE, * FROM b30),
m AS (SELECT request_id, parent_asin, SUM(w / (60 + rank)) AS score, MIN(rank) AS best FROM both_ SEMI JOIN part ON CAST(p_partkey AS VARCHAR) = parent_asin GROUP BY 1, 2)
SELECT request_id, parent_asin, ROUND(score, 6) AS score, CAST(ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY ROUND(score, 12) DESC, best, parent_asin) AS INTEGER) AS rank FROM m QUALIFY rank <= 10""")
def search_only_batch(spark, root):
    index, vectors = _search_tables(spark, root)
    fused = recommend.search_only_batch(cut(_batch(spark, root)), c._items(spark, root), index, vectors)
    return fused.final.select("request_id", "parent_asin", F.round("score", 6).alias("score"), "rank")


_STAGES = """CASE c_custkey % 20 WHEN 3 THEN 'translation' WHEN 4 THEN 'intent' WHEN 5 THEN 'intent' ELSE 'request' END AS stage,
CASE c_custkey % 20 WHEN 1 THEN 'blank query' WHEN 2 THEN 'top_k out of range' WHEN 3 THEN 'no translation' WHEN 4 THEN 'not a JSON object' WHEN 5 THEN 'no intent' ELSE 'repeated id' END AS detail"""


@query(_FUSED + f"""SELECT request_id, 'answer' AS stage, parent_asin AS detail, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10 UNION ALL
SELECT CAST(c_custkey AS VARCHAR), {_STAGES}, NULL FROM (SELECT c_custkey FROM customer WHERE c_custkey % 20 BETWEEN 1 AND 6 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 20 = 6)""")
def recommend_requests(spark, root):
    """From raw text: every twentieth customer has a request with an answer, half of them in Chinese; others fail in each way, one of them twice."""
    key = F.col("c_custkey")
    kind = key % 20
    customers = td.read_table(spark, root, "customer").select("c_custkey").where(kind <= 6)
    names = td.read_table(spark, root, "part").select(F.col("p_partkey").alias("c_custkey"), "p_name")
    chinese = F.concat(F.lit("红色"), key)
    query_ = F.when(kind == 1, "  ").when((kind == 3) | (key % 40 == 20), chinese).otherwise(F.concat(F.lit(" "), F.coalesce("p_name", F.lit("x"))))
    rows = customers.unionByName(customers.where(kind == 6)).join(names, "c_custkey", "left")
    asked = rows.select(key.cast("string").alias("request_id"), query_.alias("query"), F.when(key % 40 == 0, F.concat(F.lit(" "), key)).alias("user_id"), F.when(kind == 2, 99).alias("top_k"))
    english = rows.where(key % 40 == 20).select(chinese.alias("query"), F.col("p_name").alias("english"))
    terms = c._requests(spark, root).withColumnRenamed("category_tags", "product_terms")
    payload = F.when(F.col("request_id").cast("long") % 20 == 4, "[1]").otherwise(F.to_json(F.struct(*constraints.INTENT_LISTS, *constraints.INTENT_PRICES)))
    payloads = terms.where(F.col("request_id").cast("long") % 20 != 5).select("request_id", payload.alias("payload"))
    same = lambda *names: spark.createDataFrame([(n, n) for n in names], "alias string, canonical string")
    stored = td.read_table(spark, root, "embeddings").select(F.col("vec_id").cast("string").alias("request_id"), F.col("embedding").alias("vector"))
    train = cut(td.splits(spark, root).where("split = 'train'").select("user_id", "parent_asin"))
    index, vectors = _search_tables(spark, root)
    found = recommend.recommend_requests(asked, english, payloads, same("small", "eco", "promo"), same(*(f"brand#{i}" for i in range(1, 6))), lambda df, text, out: df.join(stored.withColumnRenamed("vector", out), "request_id", "left"), c._items(spark, root), index, vectors, train, cut(c._propagated(train)))
    answers = found.fused.final.select("request_id", F.lit("answer").alias("stage"), F.col("parent_asin").alias("detail"), "rank")
    return answers.unionByName(found.errors.select("request_id", "stage", F.col("error").alias("detail"), F.lit(None).cast("int").alias("rank")))


# The graph model's metrics.


@query(GRAPH + """, v AS (SELECT node, (x0 + x1 + x2) / 3 AS a, (y0 + y1 + y2) / 3 AS b FROM final), tg AS (SELECT user_id, parent_asin FROM splits WHERE split = 'test'), h AS (SELECT user_id, parent_asin FROM splits WHERE split IN ('train', 'valid')),
s AS (SELECT substr(u.node, 3) AS user_id, substr(i.node, 3) AS parent_asin, u.a * i.a + u.b * i.b AS score FROM v u JOIN tg ON u.node = 'u:' || tg.user_id, v i WHERE i.node LIKE 'i:%'),
r AS (SELECT s.user_id, s.parent_asin, ROW_NUMBER() OVER (PARTITION BY s.user_id ORDER BY ROUND(score, 9) DESC, s.parent_asin) AS rk FROM s ANTI JOIN h ON h.user_id = s.user_id AND h.parent_asin = s.parent_asin QUALIFY rk <= 10)
SELECT 'lightgcn' AS model, 'test' AS split, 10 AS k, COUNT(*) AS users, ROUND(AVG(CASE WHEN rk IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE, 6) AS recall, ROUND(AVG(CASE WHEN rk IS NULL THEN 0.0::DOUBLE ELSE 1.0 / LOG2(rk + 1) END), 6) AS ndcg,
ROUND(AVG(CASE WHEN rk IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE, 6) AS hit_rate FROM tg LEFT JOIN r ON r.user_id = tg.user_id AND r.parent_asin = tg.parent_asin""")
def graph_metrics(spark, root):
    splits = cut(td.splits(spark, root).select("user_id", "parent_asin", "split"))
    return popularity.evaluate_graph(c._propagated(splits.where("split = 'train'")), splits, "test")


# Evidence and explanations.


@query("SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'wanted' || chr(10) END || p_name || chr(10) || p_type || ' ' || split_part(p_name, ' ', 1) AS query FROM part")
def review_queries(spark, root):
    english = F.when(F.col("parent_asin").cast("long") % 3 == 0, "  ").otherwise(" wanted ")
    return td.items(spark, root).select("parent_asin", evidence.review_query(english, F.col("title"), F.array("category", "color")).alias("query"))


def _gathered(spark, root):
    return evidence.gather(c._pairs(spark, root), td.chunks(spark, root))


@query(EVIDENCE + """, x AS (SELECT f.*, s.score, row_number() OVER (PARTITION BY f.parent_asin ORDER BY place, f.rank) AS n, repeat(f.chunk_id || ' ', CASE WHEN f.rank % 2 = 0 THEN 2 ELSE 60 END) AS body FROM final f JOIN scored s ON s.chunk_id = f.chunk_id AND s.parent_asin = f.parent_asin QUALIFY n <= 3)
SELECT parent_asin, string_agg('[' || n || '] rating=' || rating || ' score=' || printf('%.4f', score) || ' id=' || review_id || ': ' || CASE WHEN length(body) > 500 THEN rtrim(substr(body, 1, 500)) || '...' ELSE body END, chr(10) ORDER BY n) AS snippets FROM x GROUP BY 1""")
def evidence_snippets(spark, root):
    body = F.repeat(F.concat("chunk_id", F.lit(" ")), F.when(F.col("rank") % 2 == 0, 2).otherwise(60))
    return evidence.evidence_snippets(_gathered(spark, root).withColumn("body", body), "body").select("parent_asin", "snippets")


@query(EVIDENCE + "SELECT parent_asin, chunk_id, CAST(ROW_NUMBER() OVER (PARTITION BY parent_asin ORDER BY CASE WHEN place > 1 THEN -place END NULLS LAST, place, rank) AS INTEGER) AS place FROM final")
def cited_first(spark, root):
    """The reviews are cited backwards but for the first, which isn't cited."""
    found = cut(_gathered(spark, root))
    cited = F.reverse(F.transform(F.array_sort(F.collect_set(F.when(F.col("review_place") > 1, F.struct("review_place", "review_id")))), lambda x: x["review_id"]))
    return evidence.order_cited_first(found.groupBy("request_id", "parent_asin").agg(cited.alias("cited_review_ids")), found).select("parent_asin", "chunk_id", "place")


@query(with_sql("reviews") + """, r AS (SELECT asin, CAST(substr(asin, 2) AS BIGINT) AS i, parent_asin, user_id, text FROM reviews)
SELECT asin AS review_id, CASE WHEN i % 3 = 0 THEN NULL ELSE i / 2.0 END::DOUBLE AS rating, CASE WHEN i % 5 = 0 THEN NULL ELSE i END AS helpful_vote, i % 2 = 0 AS verified_purchase FROM r WHERE i % 11 <> 0 AND regexp_replace(text, '\\s', '', 'g') <> ''""")
def coerced_evidence(spark, root):
    i = F.substring("asin", 2, 20).cast("long")
    rows = td.reviews(spark, root).select(
        F.concat(F.lit(" "), "parent_asin").alias("parent_asin"), F.concat("asin", F.lit(" ")).alias("review_id"), F.when(i % 11 == 0, " ").otherwise(F.col("asin")).alias("chunk_id"), F.col("text").alias("chunk_text"),
        F.when(i % 3 == 0, "none").otherwise((i / 2).cast("string")).alias("rating"), F.when(i % 5 == 0, "x").otherwise(i.cast("string")).alias("helpful_vote"),
        F.lit("12").alias("timestamp"), F.when(i % 2 == 0, "true").otherwise("false").alias("verified_purchase"), F.lit(None).cast("string").alias("score"),
    )
    return evidence.coerce_evidence(rows)[0].select("review_id", "rating", "helpful_vote", "verified_purchase")


@query(EVIDENCE + "SELECT parent_asin, chunk_count AS foreign_chunks FROM (SELECT CAST(CAST(parent_asin AS INT) - 1 AS VARCHAR) AS parent_asin, COUNT(*) AS chunk_count FROM final WHERE CAST(parent_asin AS INT) % 2 = 1 GROUP BY 1)")
def evidence_scope(spark, root):
    """Evidence whose odd products are moved to the request before: those chunks are foreign there."""
    found = cut(_gathered(spark, root))
    number = F.col("parent_asin").cast("int")
    moved = found.withColumn("request_id", F.concat(F.lit("q"), (number - number % 2).cast("string")))
    foreign = evidence.check_scope(moved, c._pairs(spark, root))
    return foreign.select(F.substring("request_id", 2, 9).alias("parent_asin"), F.col("foreign").alias("foreign_chunks"))


@query(EVIDENCE + """, x AS (SELECT parent_asin, CAST(parent_asin AS INT) % 3 AS kind, list(DISTINCT review_id) AS ids, COUNT(DISTINCT review_id) AS n, MIN(place) AS p, arg_min(review_id, place) AS one FROM final GROUP BY 1)
SELECT parent_asin, CASE WHEN kind = 0 THEN 'good' ELSE 'Product ' || parent_asin || ' 符合当前需求；已检索到 ' || n || ' 条可追溯评论证据。' END AS reason, kind <> 0 AS fallback, CASE WHEN kind = 0 THEN 1 ELSE n END AS cited FROM x""")
def explain_batch(spark, root):
    """A third of the products has a sound explanation, a third cites what isn't there, a third has none."""
    pairs = c._pairs(spark, root)
    chunks = td.chunks(spark, root)
    first = evidence.gather(pairs, chunks).where("review_place = 1").groupBy("request_id", "parent_asin").agg(F.first("review_id").alias("one"))
    kind = F.col("parent_asin").cast("int") % 3
    cited = F.when(kind == 0, F.col("one")).otherwise("r-none")
    body = F.concat(F.lit('{"items": [{"parent_asin": "'), "parent_asin", F.lit('", "reason": "good", "potential_cons": "few", "cited_review_ids": ["'), cited, F.lit('"]}]}'))
    payloads = first.where(kind < 2).select("request_id", body.alias("payload"))
    found = evidence.explain_batch(pairs.unionByName(pairs.withColumn("title", F.lit("A"))), chunks, payloads)
    return found.select("parent_asin", "reason", "fallback", F.size("cited_review_ids").cast("long").alias("cited"))


# Labels, payloads, counters.

_LABELS = """, l AS (SELECT l_orderkey AS query_id, CASE WHEN l_linenumber % 2 = 0 THEN 'v' ELSE '' END || l_partkey AS product_id, CASE l_linenumber % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'es' ELSE 'jp' END AS product_locale,
CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, substr('ESCI', CAST(floor(l_quantity) AS INT) % 4 + 1, 1) AS label,
CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS VARCHAR) END WHEN l_partkey % 7 <> 0 AND l_partkey IN (SELECT p_partkey FROM part) THEN CAST(l_partkey AS VARCHAR) END AS parent_asin FROM lineitem) """


def _labelled(spark, root):
    key, number = F.col("l_partkey"), F.col("l_linenumber")
    lines = td.read_table(spark, root, "lineitem")
    labels = lines.select(
        F.col("l_orderkey").alias("query_id"), F.concat(F.when(number % 2 == 0, "v").otherwise(""), key).alias("product_id"), F.when(number % 3 == 0, "us").when(number % 3 == 1, "es").otherwise("jp").alias("product_locale"),
        F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("split"), F.substring(F.lit("ESCI"), F.col("l_quantity").cast("int") % 4 + 1, F.lit(1)).alias("label"),
    )
    variants = profile.variant_map(lines.where(key % 3 == 0).select(F.concat(F.lit("v"), key).alias("asin"), key.cast("string").alias("parent_asin")))
    items = td.items(spark, root).where(F.col("parent_asin").cast("long") % 7 != 0)
    return profile.resolve_products(labels, variants, items), items


@query("WITH" + _LABELS.removeprefix(",") + """SELECT product_locale, split, COUNT(*) AS rows, COUNT(DISTINCT query_id) AS queries, COUNT(DISTINCT product_id) AS products, COUNT(parent_asin) AS matched_rows, COUNT(DISTINCT CASE WHEN parent_asin IS NOT NULL THEN query_id END) AS matched_queries,
COUNT(DISTINCT CASE WHEN parent_asin IS NOT NULL THEN product_id END) AS matched_products, COUNT(DISTINCT parent_asin) AS matched_items, """ + ", ".join(f"COUNT(*) FILTER (label = '{x}' AND parent_asin IS NOT NULL) AS \"matched_{x}\"" for x in profile.LABELS) + """,
ROUND(COUNT(DISTINCT CASE WHEN parent_asin IS NOT NULL THEN query_id END) / COUNT(DISTINCT query_id), 6) AS query_coverage FROM l GROUP BY 1, 2""")
def label_overlap(spark, root):
    return profile.label_overlap_report(_labelled(spark, root)[0])


@query("WITH" + _LABELS.removeprefix(",") + """, h AS (SELECT split, parent_asin FROM l WHERE product_locale = 'us' AND parent_asin IS NOT NULL), u AS (SELECT * FROM h UNION ALL SELECT 'union', parent_asin FROM h)
SELECT split, COUNT(DISTINCT parent_asin) AS items, ROUND(COUNT(DISTINCT parent_asin) / (SELECT COUNT(*) FROM part WHERE p_partkey % 7 <> 0), 6) AS share FROM u GROUP BY split""")
def matched_items(spark, root):
    return profile.matched_items(*_labelled(spark, root))


@query("SELECT CAST(l_partkey AS VARCHAR) || '-' || l_linenumber AS asin, CAST(MIN(l_suppkey % 2) AS VARCHAR) AS parent_asin FROM lineitem GROUP BY 1 HAVING COUNT(DISTINCT l_suppkey % 2) = 1")
def variant_parents(spark, root):
    rows = td.read_table(spark, root, "lineitem").select(F.concat_ws("-", "l_partkey", "l_linenumber").alias("asin"), (F.col("l_suppkey") % 2).cast("string").alias("parent_asin"))
    return profile.variant_map(rows)


@query(with_sql("items") + "SELECT parent_asin, title, brand, category, color, price, CASE WHEN CAST(parent_asin AS BIGINT) % 4 = 0 THEN NULL ELSE price END AS list_price, '2020-01-02' AS listed, title || '!' AS document FROM items")
def product_payloads(spark, root):
    odd = F.when(F.col("parent_asin").cast("long") % 4 == 0, F.when(F.col("price").isNull(), float("nan")).otherwise(float("-inf"))).otherwise(F.col("price"))
    return t.product_payload(td.items(spark, root).withColumns({"list_price": odd, "listed": F.lit("2020-01-02").cast("date")}), F.concat("title", F.lit("!")))


@query(with_sql("items") + """SELECT parent_asin, 'Title: ' || title || chr(10) || 'Brand: ' || brand || chr(10) || 'Main Category: ' || chr(10) || 'Categories: ' || category || ' | ' || color || chr(10) || 'Features: ' || chr(10)
|| 'Details: Color: {"a": "x, y: z", "b": [1, 2]} | Size: "' || color || ':' || category || '"' || chr(10) || 'Description: d' AS document FROM items""")
def nested_documents(spark, root):
    """Blank entries of lists go, scalars are trimmed, nested details have a space behind commas and colons."""
    details = F.concat(F.lit('{"Size": "'), "color", F.lit(":"), "category", F.lit('", "Color": {"b": [1,2], "a": "x, y: z"}}'))
    document = t.product_document(F.concat(F.lit(" "), "title"), F.col("brand"), F.lit("  "), F.array("category", F.lit(" "), F.concat("color", F.lit(" "))), F.array(F.lit("")), details, F.lit(" d "), spaced=True)
    return td.items(spark, root).select("parent_asin", document.alias("document"))


@query(with_sql("reviews") + r""", u AS (SELECT len(regexp_extract_all('Review title: ' || title || chr(10) || 'Rating: ' || rating || chr(10) || 'Review text: ' || text, '\S+')) AS w FROM reviews WHERE CAST(substr(asin, 2) AS BIGINT) % 6 <> 0)
SELECT (SELECT COUNT(*) FROM reviews) AS reviews, (SELECT COUNT(*) FROM reviews) - COUNT(*) AS skipped, COUNT(*) FILTER (w > 384) AS split, CAST(SUM(greatest(ceil((w - 64) / 320), 1)) AS BIGINT) AS chunks FROM u""")
def chunk_counters(spark, root):
    i = F.substring("asin", 2, 20).cast("long")
    return evidence_index.chunk_stats(td.reviews(spark, root).withColumns({"review_id": F.when(i % 6 == 0, " ").otherwise(F.col("asin"))}))


_BLANK = " || ".join(f"chr({c})" for c in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents),
p AS (SELECT doc_id, i, CASE WHEN i = 1 THEN length(w[i]) ELSE length(w[i]) + 1 END AS l FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d) WHERE i > 1 OR w[i] <> ''),
o AS (SELECT *, SUM(l) OVER (PARTITION BY doc_id ORDER BY i) - l AS pos, l >= 384 AS huge, SUM(CASE WHEN l >= 384 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
s AS MATERIALIZED (SELECT doc_id, run, i, pos, l FROM o WHERE NOT huge),
ends AS (SELECT doc_id, run, MAX(pos + l) AS stop FROM s GROUP BY 1, 2),
e AS (SELECT doc_id, run, pos FROM s UNION ALL SELECT doc_id, run, stop FROM ends),
fits AS MATERIALIZED (SELECT s.doc_id, s.run, s.pos, e.pos AS stop FROM s ASOF JOIN e ON s.doc_id = e.doc_id AND s.run = e.run AND s.pos + 384 >= e.pos),
back AS MATERIALIZED (SELECT s.doc_id, s.run, s.pos AS stop, e.pos AS next FROM s ASOF JOIN e ON s.doc_id = e.doc_id AND s.run = e.run AND least(s.pos, greatest(s.pos - 64, s.pos + s.l - 384)) <= e.pos),
steps AS MATERIALIZED (SELECT f.doc_id * 1000000000 + f.pos AS id, f.doc_id, f.pos, f.stop, f.doc_id * 1000000000 + b.next AS next FROM fits f LEFT JOIN back b ON f.doc_id = b.doc_id AND f.run = b.run AND f.stop = b.stop),
walk(id) AS (SELECT MIN(doc_id * 1000000000 + pos) FROM s GROUP BY doc_id, run UNION ALL SELECT next FROM walk JOIN steps USING (id) WHERE next IS NOT NULL),
c AS (SELECT doc_id, pos, stop, TRUE AS strip FROM walk JOIN steps USING (id) UNION ALL SELECT doc_id, pos, pos + l, FALSE FROM o WHERE huge)
SELECT doc_id, pos, CAST(md5(chunk) AS VARCHAR) AS chunk FROM (SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, chunk FROM (SELECT c.doc_id, pos, CASE WHEN strip THEN trim(substr(text, CAST(pos AS BIGINT) + 1, CAST(stop - pos AS BIGINT)), {_BLANK}) ELSE substr(text, CAST(pos AS BIGINT) + 1, CAST(stop - pos AS BIGINT)) END AS chunk FROM c JOIN d ON d.doc_id = c.doc_id) WHERE chunk <> '')""")
def recursive_chunks(spark, root):
    """Whole documents, cut at blanks into chunks of 384 characters that overlap by up to 64."""
    splitter = chunking.Splitter(384, 64, chunking.characters, (" ",))
    cut_up = chunking.split_text(td.read_table(spark, root, "documents", ["doc_id", "text"]), "text", splitter)
    return cut_up.select("doc_id", F.posexplode("chunks").alias("pos", "chunk")).withColumn("chunk", F.md5("chunk"))


@query(with_sql("reviews") + "SELECT COUNT(*) AS reviews, COUNT(DISTINCT user_id) AS users, (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM reviews GROUP BY parent_asin)) AS most_per_item, COUNT(DISTINCT parent_asin) AS items FROM reviews")
def quality_totals(spark, root):
    return profile.quality_totals(td.reviews(spark, root))


@query(with_sql("reviews") + """, inside AS (SELECT *, CAST(substr(asin, 2) AS BIGINT) AS seq FROM reviews WHERE CAST(parent_asin AS BIGINT) % 7 <> 0), u AS (SELECT * FROM inside WHERE trim(text) <> ''),
low AS (SELECT *, 0 AS block, ROW_NUMBER() OVER (PARTITION BY parent_asin ORDER BY verified_purchase DESC, helpful_vote DESC, ts DESC, seq DESC) AS place FROM u WHERE rating <= 3 QUALIFY place <= 2),
top AS (SELECT *, 1 AS block, ROW_NUMBER() OVER (PARTITION BY parent_asin ORDER BY verified_purchase DESC, helpful_vote DESC, ts DESC, seq DESC) AS place FROM u QUALIFY place <= 5),
once AS (SELECT * FROM (SELECT * FROM low UNION ALL SELECT * FROM top) QUALIFY ROW_NUMBER() OVER (PARTITION BY parent_asin, asin, user_id, ts, title, text ORDER BY block, place) = 1),
kept AS (SELECT * FROM once QUALIFY ROW_NUMBER() OVER (PARTITION BY parent_asin ORDER BY block, place) <= 5)
SELECT (SELECT COUNT(*) FROM reviews) AS source_rows, (SELECT COUNT(*) FROM inside) AS catalog_source_rows, (SELECT COUNT(*) FROM inside) - (SELECT COUNT(*) FROM u) AS missing_text_rows, (SELECT COUNT(*) FROM u) AS eligible_text_rows,
COUNT(*) AS retained_rows, (SELECT COUNT(*) FROM u) - COUNT(*) AS filtered_by_limit_or_duplicate_rows, COUNT(DISTINCT parent_asin) AS items_with_reviews, COUNT(*) FILTER (rating <= 3) AS low_rating_rows_retained, 3.0::DOUBLE AS low_rating_threshold FROM kept""")
def review_counters(spark, root):
    """Observed while the selected reviews are written."""
    rows = td.reviews(spark, root).withColumn("seq", F.substring("asin", 2, 20).cast("long"))
    catalog = rows.select("parent_asin").distinct().where(F.col("parent_asin").cast("long") % 7 != 0)
    stats = preprocess.write_reviews(rows, catalog, shared_dir(spark), 5, 2)
    return spark.createDataFrame([tuple(float(v) if k == "low_rating_threshold" else int(v) for k, v in stats.items())], ", ".join(f"{k} {'double' if k == 'low_rating_threshold' else 'long'}" for k in stats))


@query(c.ORACLES["dense_search"])
def dense_search_blocks(spark, root):
    """The same search over blocks of near vectors, of which only those are read that can hold one of the best."""
    rows = td.read_table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")  # the stated queries
    hidden = asked.select("query_id", F.col("query_id").alias("id"))
    found = blocks.search_blocks(blocks.cluster_blocks(rows), asked, 10, hidden).rows
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(with_sql("items") + "SELECT COUNT(*) AS items, COUNT(*) FILTER (CAST(parent_asin AS BIGINT) % 9 <> 0) AS named, COUNT(*) FILTER (CAST(parent_asin AS BIGINT) % 9 = 0) AS missing, COUNT(DISTINCT CASE WHEN CAST(parent_asin AS BIGINT) % 9 <> 0 THEN lower(brand) END) AS brands FROM items")
def brand_summary(spark, root):
    return profile.brand_summary(td.items(spark, root).withColumn("brand", F.when(F.col("parent_asin").cast("long") % 9 == 0, "  ").otherwise(F.col("brand"))))


@query("""SELECT vec_id, label + CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END AS label FROM embeddings UNION ALL SELECT vec_id + (SELECT MAX(vec_id) + 1 FROM embeddings), label FROM embeddings WHERE vec_id % 5 = 0""")
def upserted_vectors(spark, root):
    """The whole table, of which a third is replaced and a fifth comes again under new ids."""
    rows = td.read_table(spark, root, "embeddings", ["vec_id", "label"])
    shift = rows.agg(F.max("vec_id") + 1).first()[0]
    fresh = rows.where("vec_id % 5 = 0").withColumn("vec_id", F.col("vec_id") + shift)
    return dense.upsert_vectors(rows, rows.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100).unionByName(fresh), "vec_id")


@query(with_sql("interactions", "splits") + """, m AS (SELECT split, k, COUNT(*) AS users, ROUND(AVG(CASE WHEN CAST(parent_asin AS INT) % k = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS recall FROM splits, (VALUES (10), (20)) AS ks(k) WHERE split <> 'train' GROUP BY split, k)
SELECT 'parity' AS model, split, MAX(users) AS users, MAX(recall) FILTER (k = 10) AS recall_at_10, MAX(recall) FILTER (k = 20) AS recall_at_20, MAX(recall + 1) FILTER (k = 10) AS ndcg_at_10, MAX(recall + 1) FILTER (k = 20) AS ndcg_at_20, MAX(recall + 2) FILTER (k = 10) AS hit_rate_at_10, MAX(recall + 2) FILTER (k = 20) AS hit_rate_at_20
FROM m GROUP BY split""")
def merged_measures(spark, root):
    """The three measures differ, so that none can stand in another's place."""
    rows = td.splits(spark, root).where("split <> 'train'").select("split", "parent_asin", F.explode(F.array(F.lit(10), F.lit(20))).alias("k"))
    hit = (F.col("parent_asin").cast("int") % F.col("k") == 0).cast("double")
    one = rows.groupBy("split", "k").agg(F.count("*").alias("users"), F.round(F.avg(hit), 6).alias("recall"))
    return popularity.merge_metrics(one.select(F.lit("parity").alias("model"), "split", "k", "users", "recall", (F.col("recall") + 1).alias("ndcg"), (F.col("recall") + 2).alias("hit_rate")), [10, 20])
