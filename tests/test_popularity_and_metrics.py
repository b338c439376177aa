import math

import pytest

from shelfrank.operators import audit, popularity
from shelfrank.sources import files

TRAIN = [("U1", "P1"), ("U2", "P1"), ("U3", "P1"), ("U2", "P2"), ("U3", "P2"), ("U3", "P3"), ("U4", "P4")]


@pytest.fixture()
def train(spark):
    return spark.createDataFrame(TRAIN, "user_id string, parent_asin string")


def recommended(train, users, k, exclude=None):
    spark = train.sparkSession
    asked = spark.createDataFrame([(u,) for u in users], "user_id string")
    rows = popularity.popularity_top_k(train, asked, k, exclude).orderBy("user_id", "rank").collect()
    return {u: [r.parent_asin for r in rows if r.user_id == u] for u in users}


def test_history_and_ties(train):
    assert recommended(train, ["U1", "new"], 3) == {"U1": ["P2", "P3", "P4"], "new": ["P1", "P2", "P3"]}


def test_exclusions_and_small_k(train, spark):
    gone = spark.createDataFrame([("new", "P1")], "user_id string, parent_asin string")
    assert recommended(train, ["new"], 3, gone) == {"new": ["P2", "P3", "P4"]}
    assert recommended(train, ["new"], 0) == {"new": []}
    with pytest.raises(ValueError):
        recommended(train, ["new"], -1)


def test_metrics_average_over_all_users(spark):
    targets = spark.createDataFrame([("a", "x"), ("b", "y")], "user_id string, parent_asin string")
    found = spark.createDataFrame([("a", "x", 1), ("b", "z", 1), ("b", "y", 2)], "user_id string, parent_asin string, rank int")
    row = popularity.ranking_metrics(targets, found, 10).first()
    assert (row.users, row.recall, row.hit_rate) == (2, 1.0, 1.0)
    assert row.ndcg == pytest.approx((1 + 1 / math.log2(3)) / 2, abs=1e-6)
    row = popularity.ranking_metrics(targets, found.where("user_id = 'a'"), 10).first()
    assert (row.users, row.recall) == (2, 0.5)
    assert popularity.ranking_metrics(targets.limit(0), found, 10).first().recall == 0.0


def test_metric_log_keeps_runs_and_refreshes_the_baseline(spark):
    cols = "model string, split string, k int, users long, recall double, ndcg double, hit_rate double"
    old = spark.createDataFrame([("popularity", "valid", 10, 5, 0.1, 0.1, 0.1, 0), ("graph", "valid", 10, 5, 0.2, 0.1, 0.2, 1)], cols + ", run long")
    base = spark.createDataFrame([("popularity", "valid", 10, 5, 0.3, 0.1, 0.3)], cols)
    run = spark.createDataFrame([("graph", "valid", 10, 5, 0.4, 0.1, 0.4, '{"lr": 0.1}', "[1.0]")], cols + ", parameters string, losses string")
    log = files.append_metrics(old, base, run).orderBy("run").collect()
    assert [(r.model, r.recall, r.run, r.parameters) for r in log] == [("popularity", 0.3, 0, "legacy"), ("graph", 0.2, 1, "legacy"), ("graph", 0.4, 2, '{"lr": 0.1}')]
    with pytest.raises(ValueError):
        files.append_metrics(old.drop("users"), base, run)
    assert files.run_parameters({"lr": 0.1, "k": 2}, {"lr": 0.01, "k": 2}, [1.0, 0.5]) == ('{"lr": 0.1}', "[1.0, 0.5]")


def scores(spark, rel, channel="bm25", query="Q1"):
    return spark.createDataFrame([(channel, query, i + 1, f"P{i}", r) for i, r in enumerate(rel)], "channel string, query_id string, rank int, parent_asin string, human_relevance int")


def test_audit_summary(spark):
    row = audit.audit_summary(scores(spark, [2, 2, 1, 1, 1, 0, 0, 0, 0, 0]), 10).first()
    assert (row.mean_relevance, row.excellent_rate, row.bad_rate, row.mrr_strict, row.ndcg) == (0.7, 0.2, 0.5, 1.0, 1.0)
    assert audit.audit_summary(scores(spark, [0, 0]), 2).first().ndcg == 0.0


def test_audit_checks(spark):
    good = scores(spark, [2, 1]).unionByName(scores(spark, [0, 1], "dense"))
    assert audit.validate_audit(good, 2).count() == 0
    lacking = good.unionByName(scores(spark, [1, 1], "dense", "Q2"))
    assert [tuple(r) for r in audit.validate_audit(lacking, 2).collect()] == [("bm25", "Q2", "query is missing")]
    twice = good.unionByName(good.where("rank = 1 and channel = 'bm25'"))
    assert audit.validate_audit(twice, 2).first().error == "repeated rank"
    assert audit.validate_audit(good.where("rank = 1"), 2).first().error == "not ranks 1 to k"
    raw = spark.createDataFrame([("x", "Q", "1", "P", "1"), ("bm25", " ", "1", "P", "1"), ("bm25", "Q", "0", "P", "1"), ("bm25", "Q", "1", "P", "3"), ("bm25", "Q", "1", "P", "2")], "channel string, query_id string, rank string, parent_asin string, human_relevance string")
    assert sorted(r.error for r in audit.validate_audit_scores(raw, ("bm25",)).collect()) == ["blank query_id", "rank is not positive", "relevance is not 0, 1 or 2", "unknown channel"]


def test_pairwise_wins(spark):
    rows = scores(spark, [2, 1]).unionByName(scores(spark, [1, 2], "dense")).unionByName(scores(spark, [1, 1], query="Q2")).unionByName(scores(spark, [1, 1], "dense", "Q2"))
    got = {(r.channel, r.against): (r.wins, r.losses, r.ties) for r in audit.pairwise_wins(rows, 2).collect()}
    assert got == {("bm25", "dense"): (1, 0, 1), ("dense", "bm25"): (0, 1, 1)}
