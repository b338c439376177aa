import gzip
import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from shelfrank.functions import text as t
from shelfrank.operators import preprocess, profile
from shelfrank.sources import files
from shelfrank.streaming import evidence_index as ei


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_cleaning(spark):
    assert one(spark, ["  a ", "   ", None, ""], t.norm_text) == ["a", None, None, None]
    assert one(spark, ["\u3000\u00a0é\u2003x\u0085\t", "\u2028\u205f", "\u00e9", "\x1c a"], t.norm_text) == ["é\u2003x", None, "é", "\x1c a"]
    assert one(spark, ["$1,299.99", "12.5", None, "free", "about 7"], t.parse_price) == [1299.99, 12.5, None, None, 7.0]
    assert one(spark, [[" a", "", None], None], t.norm_list, "array<string>") == [["a"], []]
    assert one(spark, ["  Straße "], t.norm_key) == ["strasse"]
    assert one(spark, ["  Fender CD-60S_Guitar ", None], t.tokenize) == [["fender", "cd", "60s", "guitar"], []]
    assert one(spark, ["吉他", "guitar", None], t.is_cjk) == [True, False, False]


def test_ids(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    keys = ["rvw_a#chunk_0", "ü", ""]
    assert one(spark, keys, lambda c: t.point_id(ns, c)) == [str(uuid.uuid5(uuid.UUID(ns), k)) for k in keys]
    rows = [("P1", "A", "u", 5, 'say "hi"\n', "tab\tctrl\x1f ü /"), ("P1", None, "u", None, None, "x")]
    df = spark.createDataFrame(rows, "p string, a string, u string, ts long, ti string, te string")
    got = [r[0] for r in df.select(t.review_id(*(F.col(c) for c in ("p", "a", "u", "ts", "ti", "te")))).collect()]
    assert got == ["rvw_" + hashlib.sha256(json.dumps(list(r), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:32] for r in rows]
    assert t.index_name("Full Scope", "e5-base") == "full_scope_e5_base" and t.known_index_name("dev", "a", {"a": "Model/A"}) == "dev_model_a"
    for bad in (lambda: t.index_name("dev", "--"), lambda: t.known_index_name("dev", "b", {"a": "x"})):
        with pytest.raises(ValueError):
            bad()


def test_documents_and_chunks(spark):
    df = spark.createDataFrame([("T", None, ["a", "b"], '{"b": [1, "x"], "a": "y"}'), ("T", "B", [], "{broken"), ("T", "B", [], None)], "t string, b string, c array<string>, d string")
    got = [r[0].split("\n") for r in df.select(t.product_document(F.col("t"), F.col("b"), F.lit("M"), F.col("c"), F.col("c"), F.col("d"), F.lit(None).cast("string"))).collect()]
    assert got[0] == ["Title: T", "Brand: ", "Main Category: M", "Categories: a | b", "Features: a | b", 'Details: a: "y" | b: [1, "x"]', "Description: "]
    assert got[1][5] == "Details: {broken" and got[2][5] == "Details: "
    assert one(spark, ["a b c d e", "a", "", None], lambda c: t.word_windows(c, 3, 1)) == [["a b c", "c d e"], ["a"], [], None][:3] + [[]]
    with pytest.raises(ValueError):
        t.word_windows(F.col("v"), 3, 3)
    assert one(spark, [5.0], lambda c: t.review_text(F.lit(" x "), c, F.lit(" ")), "double") == ["Review title: x\nRating: 5.0"]
    df = spark.createDataFrame([(1, "aaa bbb. ccc ddd\n\neee"), (2, "x" * 25), (3, None)], "i int, v string")
    parts = {r.i: r.chunks for r in ei.split_text(df, "v", 10, 3).collect()}
    assert all(len(p) <= 10 for p in parts[1] + parts[2]) and "eee" in parts[1][-1] and parts[3] == []


def test_sources_and_sinks(spark, tmp_path):
    with gzip.open(tmp_path / "i.csv.gz", "wt") as f:
        f.write("user_id,parent_asin,rating,timestamp,history\nu,P,4.0,10,a b\n")
    assert [tuple(r)[:4] for r in files.read_interactions(spark, str(tmp_path / "i.csv.gz")).collect()] == [("u", "P", 4.0, 10)]
    with gzip.open(tmp_path / "m.jsonl.gz", "wt") as f:
        f.write('{"parent_asin": "P1", "title": " T ", "store": "S", "price": "$5", "details": {"Brand": " B ", "Z": 1}, "categories": ["a", ""], "description": ["x", "y"]}\n{"parent_asin": "P2", "details": {}}\n')
    v = files.read_jsonl(spark, str(tmp_path / "m.jsonl.gz"))
    get = lambda name, kind="string": F.try_variant_get("value", f"$.{name}", kind).alias(name)
    raw = v.select(get("parent_asin"), get("title"), get("store"), get("price"), get("main_category"), get("categories", "array<string>"), get("description", "array<string>"), get("features", "array<string>"), get("details", "variant"), get("bought_together", "array<string>"))
    a, b = preprocess.build_items(raw).orderBy("parent_asin").collect()
    assert (a.title, a.brand, a.price, a.categories, a.description, a.features, json.loads(a.details_json)) == ("T", "B", 5.0, ["a"], "x\ny", [], {"Brand": " B ", "Z": 1})
    assert (b.title, b.brand, b.price, b.categories) == (None, None, None, [])
    (tmp_path / "alias.json").write_text('{" Electric Guitar ": "Guitars", "": "x", "n": 3, "b": " "}')
    assert [tuple(r) for r in files.load_alias_table(spark, str(tmp_path / "alias.json")).collect()] == [("electric guitar", "Guitars")]
    assert files.load_alias_table(spark, str(tmp_path / "absent.json")).count() == 0
    (tmp_path / "broken.json").write_text("{")
    assert files.load_alias_table(spark, str(tmp_path / "broken.json")).count() == 0
    (tmp_path / "q.json").write_text('{"a-1": " strings "}')
    assert [tuple(r) for r in files.load_query_catalog(spark, str(tmp_path / "q.json")).collect()] == [("A-1", "strings")]
    (tmp_path / "q2.json").write_text('{"a 1": "strings"}')
    with pytest.raises(ValueError):
        files.load_query_catalog(spark, str(tmp_path / "q2.json"))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.csv").write_text("﻿channel,rank\nbm25,1\n")
    assert files.read_scores(spark, str(tmp_path / "s"), ("channel",)).columns == ["channel", "rank"]
    with pytest.raises(ValueError):
        files.read_scores(spark, str(tmp_path / "s"), ("relevance",))
    files.write_table(spark.createDataFrame([(1, "a", "z")], "n int, s string, other string"), str(tmp_path / "t"), "s string, n bigint")
    assert spark.read.parquet(str(tmp_path / "t")).dtypes == [("s", "string"), ("n", "bigint")]
    with pytest.raises(ValueError):
        files.preview(v, 0)


def test_preprocessing_rules(spark):
    rows = spark.createDataFrame([("u", "P", 5.0, 10, "train"), ("u", "P", 5.0, 10, "valid"), ("u", "Q", 5.0, 30, "train"), ("u", "Q", 1.0, 20, "valid")], "user_id string, parent_asin string, rating double, ts long, split string")
    assert preprocess.dedupe_interactions(rows, []).groupBy("split").count().orderBy("split").collect()[0]["count"] == 2
    assert [tuple(r) for r in preprocess.check_chronology(rows).collect()] == [("train", "valid", 1, 1)]
    with pytest.raises(ValueError):
        preprocess.select_catalog(rows, 0)
    cols = "parent_asin string, asin string, user_id string, rating double, ts long, title string, text string, helpful_vote long, verified_purchase boolean, seq long"
    reviews = spark.createDataFrame([("P1", "a", "u1", 5.0, 1, "t", "x", 9, True, 0), ("P1", "a", "u2", 5.0, 2, "t", "y", 5, True, 1), ("P1", "a", "u3", 1.0, 3, "t", "z", 0, False, 2), ("P2", "a", "u4", 2.0, 3, "t", "w", 0, False, 3), ("P2", "a", "u5", 4.0, 3, "t", " ", 0, False, 4)], cols)
    kept = preprocess.select_reviews(reviews, 2, 1).orderBy("parent_asin", "position").collect()
    assert [(r.parent_asin, r.user_id, r.low_list) for r in kept] == [("P1", "u3", True), ("P1", "u1", False), ("P2", "u4", True)]


def test_brand_stats(spark):
    items = spark.createDataFrame([(i, b, str(i)) for i, b in enumerate([" Fender ", "fender", "Shure", "", None])], "seq int, brand string, parent_asin string")
    got = {r.brand_key: (r.brand, r.example, r.n, r.share) for r in profile.brand_stats(items, "seq").collect()}
    assert got == {"fender": ("Fender", "0", 2, 0.4), "shure": ("Shure", "2", 1, 0.2)}


def test_label_overlap(spark):
    labels = spark.createDataFrame([(1, "v1", "us", "train"), (1, "P2", "us", "train"), (2, "zz", "us", "train"), (3, "P2", "es", "train")], "query_id int, product_id string, product_locale string, split string")
    variants = profile.variant_map(spark.createDataFrame([("v1", "P1"), ("v2", "P1"), ("v2", "P2")], "asin string, parent_asin string"))
    items = spark.createDataFrame([("P1",), ("P2",)], "parent_asin string")
    row = profile.label_overlap(profile.resolve_products(labels, variants, items)).first()
    assert (row.rows, row.queries, row.matched_rows, row.matched_queries, row.matched_items, row.query_coverage) == (3, 2, 2, 1, 2, 0.5)


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    from shelfrank.operators.dense import hashed_encoder

    source, target, state = str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "state")
    cols = "parent_asin string, review_id string, rating double, title string, text string, helpful_vote long, verified_purchase boolean, ts long"
    put = lambda rows: spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(source)
    put([("P1", "r1", 5.0, "t", "one two three", 0, True, 1), ("P1", None, 5.0, "t", "no id", 0, True, 1)])
    run = lambda **k: ei.build_evidence_incremental(spark, source, target, state, hashed_encoder(8), cols, 1, size=4, overlap=1, **k)
    first = run()
    assert first["reviews"] == 1 and run() == first
    put([("P2", "r2", 1.0, "t", "four", 0, True, 1)])
    assert run()["reviews"] == 2 and run(recreate=True)["items"] == 2
