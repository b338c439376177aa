import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.operators import evidence, graph


def test_a_popular_product_is_searched_in_a_grid(spark, monkeypatch):
    monkeypatch.setattr(evidence, "CHUNKS_MET", 50)
    monkeypatch.setattr(evidence, "PAIRS_MET", 20)
    rnd = np.random.default_rng(4)
    owners = ["hot"] * 400 + ["a"] * 30 + ["b"] * 3
    v, q = rnd.normal(size=(len(owners), 6)), rnd.normal(size=(130, 6))
    chunks = spark.createDataFrame([(p, f"c{i:04d}", f"r{i}", float(i % 5 + 1), [float(x) for x in row]) for i, (p, row) in enumerate(zip(owners, v))], "parent_asin string, chunk_id string, review_id string, rating double, embedding array<double>")
    wanted = [("hot" if i < 100 else ["a", "b", "none"][i % 3]) for i in range(130)]
    pairs = spark.createDataFrame([(f"q{i}", p, f"T{i}", [float(x) for x in row]) for i, (p, row) in enumerate(zip(wanted, q))], "request_id string, parent_asin string, title string, vector array<double>")
    for limit in (None, 3.0):
        found = evidence.evidence_search(pairs, chunks, 4, limit)
        got = sorted((r.request_id, r.chunk_id, r["rank"], r.title, r.review_id) for r in found.collect())
        expected = []
        for i, p in enumerate(wanted):
            able = [j for j, o in enumerate(owners) if o == p and (limit is None or j % 5 + 1 <= limit)]
            best = sorted((-round(float(v[j] @ q[i]), 9), f"c{j:04d}", f"r{j}") for j in able)[:4]
            expected += [(f"q{i}", c, n + 1, f"T{i}", r) for n, (_, c, r) in enumerate(best)]
        assert got == sorted(expected)
    assert "vector" not in found.columns and "embedding" not in found.columns


def test_an_index_in_folders_gives_the_same_and_reads_few_of_them(spark, tmp_path):
    from shelfrank.streaming.evidence_index import product_bucket

    rows = [(f"P{i % 40}", f"c{i}", f"r{i}", 5.0, [float(i % 7), 1.0]) for i in range(400)]
    chunks = spark.createDataFrame(rows, "parent_asin string, chunk_id string, review_id string, rating double, embedding array<double>")
    chunks.withColumn("bucket", product_bucket("parent_asin")).write.partitionBy("bucket").parquet(str(tmp_path / "base"))
    pairs = spark.createDataFrame([("q", "P3", [1.0, 0.0])], "request_id string, parent_asin string, vector array<double>")
    plain, folders = (sorted(tuple(r) for r in evidence.evidence_search(pairs, c, 3).select("chunk_id", "rank", "score").collect()) for c in (chunks, spark.read.parquet(str(tmp_path / "base"))))
    assert plain == folders and len(plain) == 3


def matrix(edges):
    names = sorted({r.src for r in edges})
    a = np.zeros((len(names), len(names)))
    for r in edges:
        a[names.index(r.src), names.index(r.dst)] = r.w
    d = np.diag(1 / np.sqrt(a.sum(1)))
    return names, d @ a @ d


def test_a_source_with_half_of_all_edges_is_split(spark, monkeypatch):
    monkeypatch.setattr(graph, "HEAD", 10)
    monkeypatch.setattr(graph, "SENT_VALUES", 0)
    train = spark.createDataFrame([(f"u{i}", "hub") for i in range(150)] + [(f"u{i}", f"p{i % 30}") for i in range(150)], "user_id string, parent_asin string")
    edges = graph.build_graph(train)
    walk = graph.walk_of(edges)
    sizes = walk.edges.groupBy("src", "part").count().agg(F.max("count")).first()[0]
    assert sizes <= 30 and walk.heads.count() == 1
    layer = edges.select(F.col("src").alias("node")).distinct().withColumn("x0", F.lit(1.0))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph._near(walk, layer)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Bucketed: true" in plan
    names, step = matrix(edges.collect())
    e = np.arange(2.0 * len(names)).reshape(-1, 2)
    nodes = spark.createDataFrame([(n, [float(x) for x in e[i]]) for i, n in enumerate(names)], "node string, vector array<double>")
    got = {r.node: r.vector for r in graph.propagate(walk, nodes, 2).collect()}
    assert np.allclose([got[n] for n in names], (e + step @ e + step @ step @ e) / 3)
    vectors, losses = graph.train_lightgcn(train.where("user_id < 'u3'"), dims=2, layers=1, epochs=2, lr=0.1)
    assert losses[1] < losses[0] and vectors.count() > 0


def test_a_user_who_lacks_one_item_draws_it(spark):
    items = spark.range(300).select(F.concat(F.lit("p"), "id").alias("parent_asin"))
    most = items.where("parent_asin <> 'p77'").select(F.lit("u").alias("user_id"), "parent_asin")
    pairs = most.unionByName(items.limit(3).select(F.lit("w").alias("user_id"), "parent_asin"))
    got = graph.sample_negatives(pairs, items, 1, 0).collect()
    assert len(got) == 302 and {r.negative for r in got if r.user_id == "u"} == {"p77"}
    assert not {(r.user_id, r.negative) for r in got} & {(r.user_id, r.parent_asin) for r in pairs.collect()}
    assert sorted(got) == sorted(graph.sample_negatives(pairs.repartition(5), items, 1, 0).collect())
    with pytest.raises(ValueError):
        graph.sample_negatives(items.select(F.lit("u").alias("user_id"), "parent_asin"), items, 1, 0)


def test_the_last_of_repeated_candidates_counts(spark):
    chunks = spark.createDataFrame([("P", "c", "r", 5.0, "t", [1.0])], "parent_asin string, chunk_id string, review_id string, rating double, chunk_text string, embedding array<double>")
    pairs = spark.createDataFrame([("q", " P ", "Zed", [1.0], 1), ("q", "P", "Able", [1.0], 2)], "request_id string, parent_asin string, title string, vector array<double>, place int")
    (row,) = evidence.explain_batch(pairs, chunks).collect()
    assert row.parent_asin == "P" and row.reason.startswith("Able ")
    (row,) = evidence.explain_batch(pairs.drop("place"), chunks).collect()
    assert row.reason.startswith("Zed ")
    with pytest.raises(ValueError):
        evidence.explain_batch(pairs.withColumn("parent_asin", F.lit(" ")), chunks)


def test_a_saved_model_keeps_its_configuration(spark, tmp_path):
    one = spark.createDataFrame([("u:1", [1.0])], "node string, vector array<double>")
    graph.save_embeddings(one, one, one, str(tmp_path / "m"), {"dims": 8, "lr": 0.1})
    assert graph.load_config(spark, str(tmp_path / "m")) == {"dims": 8, "lr": 0.1}


def test_copies_of_a_title_are_scored_once(spark):
    from shelfrank.operators.lexical import build_lexical_index, bm25_search

    texts = ["red bolt", "bolt red", "blue bolt bolt", "blue nut", ""]
    docs = spark.createDataFrame([(f"d{i:03d}", texts[i % 5]) for i in range(200)], "doc_id string, text string")
    index = build_lexical_index(docs)
    assert index.postings.count() == 6 and index.docs.count() == 200
    asked = spark.createDataFrame([(i, ["red bolt", "Bolt red", "nut"][i % 3]) for i in range(9)], "query_id int, query string")
    for k in (3, 100):
        got = {}
        for r in bm25_search(index, asked, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        red, bolts, nuts = ([f"d{i:03d}" for i in range(200) if i % 5 in of] for of in ((0, 1), (2,), (3,)))
        assert all(got[i] == ((red + bolts)[:k] if i % 3 < 2 else nuts[:k]) for i in range(9))


def test_scores_of_two_blocks_are_summed_in_memory(spark, monkeypatch):
    """No row a pair of question and bag is shuffled or spilled: blocks give no more than the best of each question."""
    import math

    from shelfrank.operators import lexical

    monkeypatch.setattr(lexical, "BAG_BLOCK", 7)
    monkeypatch.setattr(lexical, "ASK_BLOCK", 3)
    monkeypatch.setattr(lexical, "SUMMED", 5)
    rnd = np.random.default_rng(3)
    words = ["a", "b", "c", "d", "e", "f", "g"]
    texts = [" ".join(rnd.choice(words, rnd.integers(0, 9), p=[0.4, 0.2, 0.15, 0.1, 0.05, 0.05, 0.05])) for _ in range(60)]
    asks = [" ".join(rnd.choice([*words, "none"], rnd.integers(0, 6))) for _ in range(11)]
    docs = [t.split() for t in texts]
    df = {w: sum(w in d for d in docs) for w in words}
    raw = {w: math.log((60 - n + 0.5) / (n + 0.5)) for w, n in df.items() if n}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    average = sum(map(len, docs)) / 60
    expected = []
    for q, ask in enumerate(asks):
        score = {i: sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / average)) for w in ask.split() if w in d) for i, d in enumerate(docs) if set(d) & set(ask.split())}
        best = sorted(score, key=lambda i: (-round(score[i], 9), f"d{i:02d}"))[:5]
        expected += [(q, f"d{i:02d}", r + 1, round(score[i], 8)) for r, i in enumerate(best)]
    index = lexical.build_lexical_index(spark.createDataFrame([(f"d{i:02d}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(2))
    found = lexical.bm25_search(index, spark.createDataFrame(list(enumerate(asks)), "query_id int, query string"), 5)
    assert sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 8)) for r in found.collect()) == sorted(expected)


def test_terms_alone_need_no_index(spark):
    """The terms equal those of the index, and their counts are all that is written on the way."""
    from shelfrank.operators import lexical
    from shelfrank.sources.shared import recorded

    docs = spark.createDataFrame([("a", "Red bolt red"), ("b", "red BOLT red"), ("c", None), ("d", "nut")], "doc_id string, text string")
    with recorded() as paths:
        terms = lexical.lexical_terms(docs)
    assert len(paths) == 1
    assert sorted(terms.collect()) == sorted(lexical.build_lexical_index(docs).terms.collect())
    with pytest.raises(ValueError):
        lexical.lexical_terms(docs.unionByName(docs))


def test_edges_never_meet_degrees(spark):
    """Training rows are grouped once for both directions; a pass joins edges with a layer alone, whose rows are not sorted."""
    train = spark.createDataFrame([(f"u{i % 20}", f"p{i % 7}") for i in range(90)], "user_id string, parent_asin string")
    edges = graph.build_graph(train)
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        walk = graph.walk_of(edges)
        assert sorted(walk.edges.select("src", "dst", "w").collect()) == sorted(edges.collect())
        plan = graph._near(walk, walk.degrees)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    names, step = matrix(edges.collect())
    e = np.arange(2.0 * len(names)).reshape(-1, 2)
    nodes = spark.createDataFrame([(n, [float(x) for x in e[i]]) for i, n in enumerate(names)] + [("u:none", [3.0, 6.0])], "node string, vector array<double>")
    for given in (edges, walk):
        got = {r.node: r.vector for r in graph.propagate(given, nodes, 2).collect()}
        assert np.allclose([got[n] for n in names], (e + step @ e + step @ step @ e) / 3) and np.allclose(got["u:none"], [1.0, 2.0])


def test_pairs_of_blocks_need_one_worker(spark):
    """Blocks of vectors are written, so the task that scores them holds no second worker; ragged vectors are an error."""
    from shelfrank.operators import dense

    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(50, 4)).astype(np.float32)
    rows = spark.createDataFrame([(f"v{i:02d}", [float(x) for x in row]) for i, row in enumerate(v)] + [("none", None)], "id string, vector array<float>")
    asked = rows.where("id < 'v07'").withColumnRenamed("id", "query_id")
    found = dense.dense_search(rows, asked, 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    scores = v.astype(np.float64) @ v.astype(np.float64).T
    expected = [(f"v{i:02d}", f"v{j:02d}", r + 1) for i in range(7) for r, j in enumerate(np.argsort(-scores[i], kind="stable")[:3])]
    assert sorted((r.query_id, r.id, r["rank"]) for r in found.collect()) == sorted(expected)
    with pytest.raises(Exception, match="same number of dimensions"):
        dense.dense_search(rows.unionByName(rows.where("id = 'v01'").withColumn("vector", F.array(F.lit(1.0).cast("float")))).coalesce(1), asked, 3).collect()


def test_label_rows_are_not_sorted_or_expanded(spark):
    """One narrow grouping holds queries, products and items; null keys count as rows alone."""
    from shelfrank.operators import profile

    rows = [(1, "p1", "us", "train", "E"), (1, "p2", "us", "train", "S"), (2, "p2", "us", "train", "E"), (None, "p1", "us", "train", "I"), (3, None, "us", "train", "C"), (1, "p1", "es", "test", "E")]
    labels = spark.createDataFrame(rows, "query_id long, product_id string, product_locale string, split string, label string")
    variants = spark.createDataFrame([("p1", "A")], "asin string, parent_asin string")
    resolved = profile.resolve_products(labels, variants, spark.createDataFrame([("B",)], "parent_asin string"))
    report = profile.label_overlap_report(resolved)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "SortMergeJoin" not in plan
    assert sorted(tuple(r) for r in report.collect()) == [("es", "test", 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 1.0), ("us", "train", 5, 3, 2, 2, 1, 1, 1, 1, 0, 0, 1, 0.333333)]
