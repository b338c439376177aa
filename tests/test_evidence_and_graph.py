import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.operators import dense, evidence, graph, recommend
from shelfrank.operators.lexical import build_lexical_index

RANKED = "request_id string, parent_asin string, chunk_id string, review_id string, rating double, rank int, chunk_text string, score double"


def ranked(spark, rows):
    return spark.createDataFrame([("q", "P", f"{r}#{i}", r, x, i + 1, f"text {r}", 1.0 / (i + 1)) for i, (r, x) in enumerate(rows)], RANKED)


def order(df):
    return [r.review_id for r in df.orderBy("review_place", "rank").collect()]


def test_sparse_pairs_expand_and_later_chunks_stay(spark):
    rows = ranked(spark, [("r1", 5.0), ("r1", 5.0), ("r2", 4.0), ("r3", 5.0), ("r1", 5.0)])
    assert evidence.expand_if_sparse(rows, 2, 2).count() == 5
    assert evidence.expand_if_sparse(rows, 3, 2).count() == 3
    assert order(evidence.select_evidence(rows, 2)) == ["r1", "r1", "r1", "r2"]


def test_low_rating_replaces_the_last_or_follows(spark):
    chosen = evidence.select_evidence(ranked(spark, [("r1", 5.0), ("r2", 4.0), ("r3", 5.0)]), 3)
    low = ranked(spark, [("r2", 2.0), ("bad", 2.0)])
    assert order(evidence.add_low_rating(chosen, low, 3)) == ["r1", "r2", "bad"]
    assert order(evidence.add_low_rating(chosen, low, 5)) == ["r1", "r2", "r3", "bad"]
    has = evidence.select_evidence(ranked(spark, [("r1", 3.0), ("r2", 4.0)]), 3)
    assert order(evidence.add_low_rating(has, low, 3)) == ["r1", "r2"]


def test_explanations(spark):
    pairs = spark.createDataFrame([("q", "P", "Tuner"), ("q", "N", None)], "request_id string, parent_asin string, title string")
    found = evidence.select_evidence(ranked(spark, [("R1", 5.0), ("LOW", 2.0)]))
    rows = {r.parent_asin: r for r in evidence.template_explanations(pairs, found).collect()}
    assert rows["P"].cited_review_ids == ["R1", "LOW"] and "2 条" in rows["P"].reason and "LOW" in rows["P"].potential_cons
    assert rows["N"].cited_review_ids == [] and rows["N"].reason.startswith("N ") and rows["N"].fallback
    item = lambda p, cited: {"parent_asin": p, "reason": "a", "potential_cons": "b", "cited_review_ids": cited}
    check = lambda body: sorted((r.parent_asin, r.fallback) for r in evidence.validate_explanations(spark.createDataFrame([("q", json.dumps(body))], "request_id string, payload string"), pairs, found).collect())
    good = {"items": [item("P", ["R1", "R1"]), item("N", [])]}
    assert check(good) == [("N", False), ("P", False)]
    for bad in ({"items": [item("P", ["R9"]), item("N", [])]}, {"items": [item("P", ["R1"])]}, {"items": [item("P", ["R1"]), item("N", []), item("X", [])]}, {"items": [item("P", ["R1"]), {**item("N", []), "reason": " "}]}, []):
        assert check(bad) == [("N", True), ("P", True)]
    cited = spark.createDataFrame([("q", "P", ["LOW"])], "request_id string, parent_asin string, cited_review_ids array<string>")
    assert [r.review_id for r in evidence.order_cited_first(cited, found).orderBy("place").collect()] == ["LOW", "R1"]
    text = evidence.evidence_snippets(found, "chunk_text", 1, 4).first().snippets
    assert text == "[1] rating=5.0 score=1.0000 id=R1: text..."
    prompt = evidence.explanation_prompt("{query}|{evidence}", pairs.select("request_id", "parent_asin", F.lit("strings").alias("english"), F.struct("title").alias("item")), found).first().prompt
    assert prompt.startswith("strings|[") and "R1" in prompt


def test_evidence_rows_are_coerced(spark):
    cols = "parent_asin string, review_id string, chunk_id string, chunk_text string, rating string, helpful_vote string, timestamp string, verified_purchase string, score string"
    good, bad = evidence.coerce_evidence(spark.createDataFrame([(" P ", "r", "c", "t", "x", "3", None, "true", "0.5"), ("P", " ", "c", "t", None, None, None, None, None)], cols))
    row = good.first()
    assert (row.parent_asin, row.rating, row.helpful_vote, row.verified_purchase, row.score) == ("P", None, 3, True, 0.5) and bad.count() == 1


def test_encoder_and_token_lengths(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, None)], "i int, text string")
    rows = dense.embed(df, "text", dense.hashed_encoder(16)).orderBy("i").collect()
    assert np.linalg.norm(rows[0].vector) == pytest.approx(1) and len(rows[1].vector) == 16
    row = dense.token_length_stats(spark.createDataFrame([(1,), (3,), (6,), (10,)], "n_tokens int"), 5).first()
    assert (row.p50, row.p90, row.p99, row.truncated, row.truncated_ratio) == (3, 10, 10, 2, 0.5)


EDGES = [("U1", "P1"), ("U1", "P2"), ("U2", "P1"), ("U2", "P3"), ("U3", "P2"), ("U3", "P4"), ("U4", "P3"), ("U4", "P5")]


def test_propagation_equals_matrices(spark):
    train = spark.createDataFrame(EDGES, "user_id string, parent_asin string")
    edges = graph.build_graph(train)
    assert edges.count() == 16
    names = sorted({r.src for r in edges.collect()})
    a = np.zeros((len(names), len(names)))
    for r in edges.collect():
        a[names.index(r.src), names.index(r.dst)] = r.w
    d = np.diag(1 / np.sqrt(a.sum(1)))
    walk, e = d @ a @ d, np.arange(2.0 * len(names)).reshape(-1, 2)
    expected = (e + walk @ e + walk @ walk @ e) / 3
    nodes = spark.createDataFrame([(n, [float(x) for x in e[i]]) for i, n in enumerate(names)], "node string, vector array<double>")
    got = {r.node: r.vector for r in graph.propagate(edges, nodes, 2).collect()}
    assert np.allclose([got[n] for n in names], expected)
    assert sorted(graph.build_graph(train, repeats=False).collect()) == sorted(edges.collect())


def test_training_lowers_the_loss_and_recommends_unseen(spark, tmp_path):
    train = spark.createDataFrame(EDGES, "user_id string, parent_asin string")
    vectors, losses = graph.train_lightgcn(train, dims=4, layers=2, epochs=4, lr=0.1)
    assert len(losses) == 4 and losses[-1] < losses[0]
    users = spark.createDataFrame([("U1",), ("U1",), ("nobody",)], "user_id string")
    rows = graph.graph_top_k(vectors, users, train, 2, block=1).orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2] and {r.parent_asin for r in rows} <= {"P3", "P4", "P5"}
    assert graph.graph_top_k(vectors, users, train, 0).count() == 0
    with pytest.raises(ValueError):
        graph.graph_top_k(vectors, users, train, -1)
    negatives = graph.sample_negatives(train, train.select("parent_asin"), 1, 0).collect()
    assert len(negatives) == 8 and not {(r.user_id, r.negative) for r in negatives} & set(EDGES)
    with pytest.raises(ValueError):
        graph.sample_negatives(train, train.where("user_id = 'U1'").select("parent_asin"), 1, 0)
    graph.save_embeddings(vectors, train, graph.build_graph(train), str(tmp_path / "g"))
    assert graph.load_embeddings(spark, str(tmp_path / "g"))[0].count() == 9

    # one request from end to end
    items = spark.createDataFrame([(f"P{i}", "B", 10.0 * i, ["strings"], [], []) for i in range(1, 6)], "parent_asin string, brand string, price double, item_categories array<string>, item_colors array<string>, item_materials array<string>")
    docs = items.select(F.col("parent_asin").alias("doc_id"), F.concat(F.lit("strings "), F.col("parent_asin")).alias("text"))
    index, encode = build_lexical_index(docs), dense.hashed_encoder(8)
    base = encode(docs, "text", "vector").select(F.col("doc_id").alias("id"), "vector")
    requests = encode(spark.createDataFrame([("known", "strings P3", "U1", 2), ("cold", "strings P3", "nobody", 2)], "request_id string, search_query string, user_id string, top_k int"), "search_query", "vector")
    none = F.array().cast("array<string>")
    limits = requests.select("request_id", F.array(F.lit("strings")).alias("category_tags"), F.lit(None).cast("double").alias("min_price"), F.lit(40.0).alias("max_price"), none.alias("brands"), none.alias("excluded_brands"), none.alias("color_tags"), none.alias("material_tags"))
    out = recommend.recommend_batch(requests, limits, items, index, base, train, vectors)
    final = out.final.collect()
    assert {r.request_id for r in final} == {"known", "cold"} and all(r.rank <= 2 and r.parent_asin != "P5" for r in final)
    assert any("lightgcn" in r.sources for r in out.ranked.collect() if r.request_id == "known")
    assert not any("lightgcn" in r.sources for r in out.ranked.collect() if r.request_id == "cold")
    only = recommend.search_only_batch(requests, items, index, base).ranked.collect()
    assert {s for r in only for s in r.sources} <= {"dense", "bm25"}
