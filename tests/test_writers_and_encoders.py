import csv
import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.operators import dense, preprocess, recommend
from shelfrank.sources import files


def lines(path, pattern):
    return [line for name in sorted(glob.glob(f"{path}/{pattern}")) for line in open(name).read().splitlines()]


@pytest.mark.parametrize("size", ["134217728", "40"])
def test_lines_keep_their_order_over_many_files(spark, tmp_path, size):
    for f in range(4):
        (tmp_path / f"part{f}.jsonl").write_text("".join(json.dumps({"n": 10 * f + i}) + "\n" * (1 + (i == 2)) for i in range(10)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = files.read_jsonl(spark, str(tmp_path)).select("seq", F.variant_get("value", "$.n", "int").alias("n"))
        assert [r.n for r in rows.orderBy("seq").collect()] == list(range(40))
        first = preprocess.attach_metadata(spark.createDataFrame([("P",)], "parent_asin string"), rows.withColumn("parent_asin", F.lit("P")), ["seq"])
        assert first.first().n == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_review_counters_come_from_the_writes(spark, tmp_path):
    cols = "parent_asin string, asin string, user_id string, rating double, ts long, title string, text string, helpful_vote long, verified_purchase boolean, seq long"
    rows = [("P", "a", f"u{i}", float(i % 5 + 1), i, "t", "x" if i else " ", 0, True, i) for i in range(9)] + [("Q", "a", "u", 5.0, 1, "t", "y", 0, True, 9), ("Z", "a", "u", 5.0, 1, "t", "y", 0, True, 10)]
    catalog = spark.createDataFrame([("P",), ("Q",), ("W",)], "parent_asin string")
    stats = preprocess.write_reviews(spark.createDataFrame(rows, cols), catalog, str(tmp_path / "r"), 4, 1)
    kept = spark.read.parquet(str(tmp_path / "r"))
    assert stats == {"source_rows": 11, "catalog_source_rows": 10, "missing_text_rows": 1, "retained_rows": 5, "items_with_reviews": 2, "low_rating_rows_retained": kept.where("rating <= 3").count(), "eligible_text_rows": 9, "filtered_by_limit_or_duplicate_rows": 4, "low_rating_threshold": 3.0}
    assert kept.count() == 5 and kept.where("review_id like 'rvw_%'").count() == 5
    with pytest.raises(ValueError):
        preprocess.write_reviews(spark.createDataFrame(rows, cols), catalog, str(tmp_path / "x"), 0)


def test_metadata_counters(spark):
    catalog = spark.createDataFrame([("P",), ("Q",)], "parent_asin string")
    row = preprocess.metadata_stats(catalog, spark.createDataFrame([("P",), ("P",), ("Z",)], "parent_asin string")).first()
    assert (row.matched, row.missing, row.duplicate) == (1, 1, 1)


def test_writers(spark, tmp_path):
    out = lambda name: str(tmp_path / name)
    files.write_stats(spark.createDataFrame([(1, 2)], "a int, b int"), out("stats"))
    assert [json.loads(x) for x in lines(out("stats"), "*.json")] == [{"a": 1, "b": 2}]
    wide = spark.createDataFrame([("m", "test", 3, "p", 0.1, 0.2, 0.3)], "model string, split string, users int, parameters string, hit_rate_at_10 double, recall_at_10 double, ndcg_at_10 double")
    files.write_metrics(wide, out("metrics"))
    assert lines(out("metrics"), "*.csv") == ["model,split,users,recall_at_10,ndcg_at_10,hit_rate_at_10,parameters", "m,test,3,0.2,0.3,0.1,p"]
    overall = spark.createDataFrame([("b", 0.5), ("a", 0.25)], "channel string, ndcg double")
    by_query = spark.createDataFrame([("a", f"q{i}", 0.5) for i in range(30)], "channel string, query_id string, ndcg double")
    wins = spark.createDataFrame([("a", "b", 1)], "channel string, against string, wins int")
    files.write_audit(overall, by_query, wins, out("audit"))
    rows = [r for name in sorted(glob.glob(out("audit") + "/*.csv")) for r in csv.DictReader(open(name))]
    assert tuple(rows[0]) == files.AUDIT_COLUMNS and len(rows) == 33
    assert [(r["section"], r["channel"], r["query_id"]) for r in rows] == sorted((r["section"], r["channel"], r["query_id"]) for r in rows)
    ranked = spark.createDataFrame([("r", "P", 1)], "request_id string, parent_asin string, rank int")
    files.write_fusion_sidecars(ranked, ranked, spark.createDataFrame([("r", 5.0)], "request_id string, min_price double"), out("sidecars"))
    assert json.loads(lines(out("sidecars"), "filtered/*.json")[0]) == {"request_id": "r", "parent_asin": "P", "rank": 1, "min_price": 5.0}
    files.write_brand_vocabulary(spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "brand_key string, brand string, n int"), out("brands"))
    assert lines(out("brands"), "text/*.txt") == ["B", "A"] and lines(out("brands"), "csv/*.csv")[0] == "brand_key,brand,n"
    counted = files.write_observed(ranked, out("seen"), rows=F.count(F.lit(1)), best=F.min("rank"))
    assert counted == {"rows": 1, "best": 1}


def test_a_worker_opens_a_model_once_and_encodes_a_text_once(spark, tmp_path):
    folder = str(tmp_path)

    def opened():
        import uuid

        open(f"{folder}/open-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            with open(f"{folder}/texts-{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            return np.array([[len(t), 1.0, 0.0] for t in texts]).reshape(-1, 3)

        return model

    encoder = dense.model_encoder(f"lengths-{tmp_path}", opened, 3, batch=2)
    df = spark.range(40).select("id", F.repeat(F.lit("ab"), (F.col("id") % 4).cast("int")).alias("text"), F.lit(1).alias("v")).repartition(12)
    rows = dense.embed(df, "text", encoder, "v").collect()
    assert all(np.allclose(r.v, np.array([len(f"passage: {r.text}"), 1, 0]) / np.hypot(len(f"passage: {r.text}"), 1), atol=1e-6) for r in rows) and len(rows) == 40
    loads = [f.split("-")[1] for f in os.listdir(folder) if f.startswith("open")]
    assert len(loads) == len(set(loads)) < 12
    for f in glob.glob(f"{folder}/texts-*"):
        os.remove(f)
    again = dense.distinct_texts(encoder)(df.withColumn("text", F.when(F.col("id") % 5 > 0, F.col("text"))), "text", "v").collect()
    assert len(again) == 40 and all(r.v for r in again)
    met = [t for f in glob.glob(f"{folder}/texts-*") for t in open(f).read().split("\n")]
    assert set(met) == {"", "ab", "abab", "ababab"} and len(met) <= 5  # null and empty are two texts of the join
    empty = encoder(df.limit(0), "text", "v")
    assert empty.count() == 0 and empty.schema["v"].dataType.simpleString() == "array<float>"
    with pytest.raises(Exception, match="3 numbers|reshape"):
        dense.model_encoder("wrong", lambda: lambda texts: np.zeros((len(texts), 2)), 3)(df, "text", "v").collect()


def test_every_request_is_asked_or_an_error(spark):
    requests = spark.createDataFrame([("a", " strings ", None, None), ("b", " ", None, 1), ("c", "红色", None, 1), ("d", "红色吉他", "u", 50), ("e", "x", None, 51), ("f", "x", None, 1), ("f", "y", None, 1), (None, "x", None, 1), ("g", "x", None, 1), ("h", "x", None, 1), ("i", "x", None, 1), ("j", "x", None, 1)], "request_id string, query string, user_id string, top_k int")
    translations = spark.createDataFrame([("红色吉他", "red guitar"), ("红色", " ")], "query string, english string")
    good = json.dumps({"product_terms": ["Guitar", "none"], "brands": [" FENDER "], "min_price": 5})
    payloads = spark.createDataFrame([("a", good), ("d", "{}"), ("g", "nonsense"), ("h", good), ("h", good), ("i", json.dumps({"min_price": 9, "max_price": 1})), ("zz", good)], "request_id string, payload string")
    alias = lambda *pairs: spark.createDataFrame(pairs, "alias string, canonical string")
    out = recommend.prepare_requests(requests, translations, payloads, alias(("guitar", "guitars")), alias(("fender", "Fender")))
    errors = sorted((r.request_id or "", r.stage, r.error) for r in out.errors.collect())
    assert errors == [("", "request", "no id"), ("b", "request", "blank query"), ("c", "translation", "no translation"), ("e", "request", "top_k out of range"), ("f", "request", "repeated id"), ("f", "request", "repeated id"), ("g", "intent", "not a JSON object"), ("h", "intent", "several intents"), ("i", "intent", "min_price is greater than max_price"), ("j", "intent", "no intent")]
    ok = {r.request_id: r for r in out.ok.collect()}
    assert set(ok) == {"a", "d"} and len(errors) + len(ok) == requests.count()
    assert (ok["a"].category_tags, ok["a"].brands, ok["a"].min_price, ok["a"].top_k, ok["d"].search_query) == (["guitars"], ["Fender"], 5.0, 10, "red guitar")


def test_responses_hold_evidence_and_typed_fields(spark):
    bare = recommend.typed_candidates(spark.createDataFrame([("r", "P", "2", None)], "request_id string, parent_asin string, rank string, score double")).first()
    assert (bare["rank"], bare.fusion_score, bare.sources, bare.source_ranks, bare.source_scores) == (2, 0.0, [], {}, {})
    final = spark.createDataFrame([("r", "P", 1, 0.5, ["dense"]), ("r", "N", 2, 0.4, ["bm25"])], "request_id string, parent_asin string, rank int, score double, sources array<string>")
    items = spark.createDataFrame([("P", "T", "B", 1.0)], "parent_asin string, title string, brand string, price double")
    told = spark.createDataFrame([("r", "P", "why", "but", ["r1"], False)], "request_id string, parent_asin string, reason string, potential_cons string, cited_review_ids array<string>, fallback boolean")
    found = spark.createDataFrame([("r", "P", 2, 2, "r2", "c2", 4.0), ("r", "P", 1, 1, "r1", "c1", 5.0), ("r", "N", 1, 1, "r9", "c9", 5.0)], "request_id string, parent_asin string, review_place int, rank int, review_id string, chunk_id string, rating double")
    rows = {r.parent_asin: r for r in recommend.response_rows(final, items, told, found).collect()}
    assert [e.review_id for e in rows["P"].evidence] == ["r1", "r2"] and rows["N"].evidence == [] and rows["N"].fallback


def test_rows_of_stored_responses(spark):
    ok = {"success": True, "query_id": " Q1 ", "query": "x", "client_elapsed_seconds": 1.5, "response": {"latency_ms": 12, "results": [{"rank": "1", "product_id": "", "parent_asin": "P", "title": "T", "price": 3, "sources": ["dense", "bm25"], "evidence": [{"review_id": "r", "rating": 5.0, "text": "abcdef"}]}, {"rank": "one"}, {"title": "no rank"}]}}
    stored = spark.createDataFrame([("f/a.json", json.dumps(ok)), ("f/b.json", json.dumps({"success": False})), ("f/c.json", "{"), ("f/Q2.json", json.dumps({"success": True, "response": {"results": [{"rank": 2}]}}))], "name string, value string")
    rows, failed = recommend.response_file_rows(stored, max_chars=4)
    one, two = rows.orderBy("query_id").collect()
    assert (one.query_id, one["rank"], one.product_id, one.price, one.sources, one.evidence, one.latency_ms, one.elapsed_seconds, one.top_k) == ("Q1", 1, "P", 3.0, "dense, bm25", "[1] rating=5 id=r: abcd...", 12.0, 1.5, 3) or one.evidence.startswith("[1] rating=5.0")
    assert (two.query_id, two["rank"], two.title, two.evidence) == ("Q2", 2, "", "")
    assert sorted(r.name for r in failed.collect()) == ["f/b.json", "f/c.json"]
