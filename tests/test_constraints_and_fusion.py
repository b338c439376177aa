import pytest
from pyspark.sql import functions as F

from shelfrank.operators import constraints as c
from shelfrank.operators import fusion, recommend
from shelfrank.operators.lexical import build_lexical_index, bm25_search, check_ids, read_lexical_index, write_lexical_index

REQUEST = "request_id string, known_user boolean, top_k int, category_tags array<string>, min_price double, max_price double, brands array<string>, excluded_brands array<string>, color_tags array<string>, material_tags array<string>"
ITEM = "parent_asin string, brand string, price double, item_categories array<string>, item_colors array<string>, item_materials array<string>"


def request(rid="q", known=False, k=10, tags=(), low=None, high=None, brands=(), excluded=(), colors=(), materials=()):
    return (rid, known, k, list(tags), low, high, list(brands), list(excluded), list(colors), list(materials))


def candidates(spark, lists, rid="q"):
    rows = [(rid, ch, i + 1, p, 1.0 / (i + 1)) for ch, ps in lists.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "request_id string, channel string, rank int, parent_asin string, score double")


def items(spark):
    tuners = ["musical instruments", "guitar tuners"]
    rows = [
        ("TUNER_A", "Snark", 19.99, tuners, ["black"], []),
        ("TUNER_B", "Boss", 79.99, tuners, ["white"], []),
        ("MIC_A", "Shure", 99.0, ["microphones"], [], ["metal"]),
        ("STAND_A", "OnStage", 39.0, ["microphone stands"], [], ["steel"]),
        ("FENDER_A", "Fender", 24.0, tuners, [], []),
        ("OVER_BUDGET", "Boss", 120.0, tuners, [], []),
    ]
    return spark.createDataFrame(rows, ITEM)


TUNER_LISTS = {"dense": ["TUNER_A", "TUNER_B", "FENDER_A"], "bm25": ["TUNER_B", "TUNER_A", "OVER_BUDGET"], "lightgcn": ["TUNER_B", "FENDER_A", "TUNER_A"], "popularity": ["TUNER_A", "STAND_A", "MIC_A", "OVER_BUDGET"]}


def test_known_and_cold_scores(spark):
    tags = ["Guitar Tuners"]
    known = fusion.fuse(candidates(spark, TUNER_LISTS), spark.createDataFrame([request(known=True, tags=tags)], REQUEST), items(spark)).final.orderBy("rank").collect()
    assert [r.parent_asin for r in known] == ["TUNER_A", "TUNER_B", "FENDER_A", "OVER_BUDGET"]
    assert [r.score for r in known] == pytest.approx([0.45 / 61 + 0.25 / 62 + 0.25 / 63 + 0.05 / 61, 0.45 / 62 + 0.25 / 61 + 0.25 / 61, 0.45 / 63 + 0.25 / 62, 0.25 / 63 + 0.05 / 64], abs=1e-12)
    lists = {k: v for k, v in TUNER_LISTS.items() if k != "lightgcn"}
    out = fusion.fuse(candidates(spark, lists), spark.createDataFrame([request(tags=tags)], REQUEST), items(spark))
    cold = out.final.orderBy("rank").collect()
    assert [r.score for r in cold] == pytest.approx([0.65 / 61 + 0.3 / 62 + 0.05 / 61, 0.65 / 62 + 0.3 / 61, 0.65 / 63, 0.3 / 63 + 0.05 / 64], abs=1e-12)
    assert cold[0].sources == ["dense", "bm25", "popularity"] and cold[0].source_ranks == {"dense": 1, "bm25": 2, "popularity": 1}
    assert {(r.parent_asin, r.filter_policy, r.filter_reason) for r in out.filtered.collect()} == {("STAND_A", "personalized", "category_mismatch"), ("MIC_A", "personalized", "category_mismatch")}


def test_policies(spark):
    lists = {"dense": ["TUNER_B"], "lightgcn": ["TUNER_B", "FENDER_A", "MIC_A"]}
    free = fusion.fuse(candidates(spark, lists), spark.createDataFrame([request(known=True, colors=["black"])], REQUEST), items(spark))
    # a found item isn't checked for color; the others need a category tag
    assert [r.parent_asin for r in free.final.collect()] == ["TUNER_B"]
    assert {r.filter_reason for r in free.filtered.collect()} == {"missing_category_constraint"}
    # only graph items of a cold request have no weight: neither ranked nor filtered
    cold = fusion.fuse(candidates(spark, {"lightgcn": ["TUNER_A"]}), spark.createDataFrame([request(tags=["tuner"])], REQUEST), items(spark))
    assert cold.ranked.count() == 0 and cold.filtered.count() == 0
    unknown = fusion.fuse(candidates(spark, {"dense": ["NONE"]}), spark.createDataFrame([request(tags=["tuner"])], REQUEST), items(spark))
    assert unknown.filtered.first().filter_reason == "category_missing"
    with pytest.raises(ValueError):
        fusion.fuse(candidates(spark, lists), spark.createDataFrame([request()], REQUEST), items(spark), -1)


@pytest.mark.parametrize(
    ("asked", "kept"),
    [
        (request(tags=[" Tuners "]), {"TUNER_A", "TUNER_B", "FENDER_A", "OVER_BUDGET"}),
        (request(low=24.0, high=79.99), {"TUNER_B", "STAND_A", "FENDER_A"}),
        (request(brands=["boss ", "FENDER"]), {"TUNER_B", "FENDER_A", "OVER_BUDGET"}),
        (request(excluded=["Boss"]), {"TUNER_A", "MIC_A", "STAND_A", "FENDER_A", "NO_BRAND"}),
        (request(colors=["Black"]), {"TUNER_A"}),
        (request(materials=["METAL"]), {"MIC_A"}),
    ],
)
def test_hard_filter(spark, asked, kept):
    every = items(spark).unionByName(spark.createDataFrame([("NO_BRAND", None, None, [], None, None)], ITEM))
    joined = every.crossJoin(spark.createDataFrame([asked], REQUEST))
    expected = kept | ({"NO_BRAND"} if asked == request() else set())
    assert {r.parent_asin for r in c.hard_filter(joined).collect()} == expected


def test_details_tags(spark):
    rows = ['{"Color": " Black ", "Color Name": ["Red", ["Deep"]]}', '{"Color": 5}', "{broken", None, '{"Material": [["Steel", "Oak"]], "Material Type": "oak"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, d string").select("i", c.color_tags(F.col("d")).alias("c"), c.material_tags(F.col("d")).alias("m")).orderBy("i").collect()
    assert "black" in df[0].c and df[1].c in ([], ["5"]) and df[2].c == [] and df[3].c == [] and set(df[4].m) == {"steel", "oak"}


def test_aliases_and_intents(spark):
    aliases = spark.createDataFrame([("electric guitar", "Guitars"), ("guitar", " guitars "), ("mic", "Microphones")], "alias string, canonical string")
    df = spark.createDataFrame([("q", [" MIC", "Electric Guitar", "guitar", "drum"]), ("r", [])], "request_id string, v array<string>")
    assert {r.request_id: r.v for r in c.resolve_aliases(df, "v", aliases).collect()} == {"q": ["Microphones", "Guitars"], "r": []}
    good = '{"product_terms": [" guitar ", ""], "brands": null, "color_tags": [" black "], "min_price": 10, "max_price": 50.5, "search_query": "x"}'
    bad = ["[]", "{", '{"min_price": 50, "max_price": 10}', '{"min_price": -1}', '{"brands": "x"}', '{"brands": [1]}', '{"max_price": "9"}']
    out = c.parse_intent(spark.createDataFrame([("good", good), *((f"bad{i}", b) for i, b in enumerate(bad))], "request_id string, payload string"))
    assert [(r.request_id, r.product_terms, r.brands, r.color_tags, r.min_price, r.max_price) for r in out.ok.collect()] == [("good", ["guitar"], [], ["black"], 10.0, 50.5)]
    assert out.errors.count() == len(bad)


def test_requests_and_translations(spark):
    raw = spark.createDataFrame([("1", "  guitar tuner  ", " ", None), ("2", " ", "u", 5), ("3", "x", "u", 51), ("4", "吉他", "u", 1), ("5", "鼓", "u", 1)], "request_id string, query string, user_id string, top_k int")
    checked = c.valid_requests(raw)
    assert {r.request_id: (r.query, r.user_id, r.top_k) for r in checked.ok.collect()}["1"] == ("guitar tuner", None, 10)
    assert {r.request_id: r.error for r in checked.errors.collect()} == {"2": "blank query", "3": "top_k out of range"}
    known = spark.createDataFrame([("吉他", " guitar "), ("鼓", " ")], "query string, english string")
    out = c.prepare_search_query(checked.ok, known)
    assert {r.request_id: r.search_query for r in out.ok.collect()} == {"1": "guitar tuner", "4": "guitar"}
    assert [r.request_id for r in out.errors.collect()] == ["5"]
    limits = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 2.0), ("c", float("nan"), None)], "request_id string, min_price double, max_price double")
    assert [r.request_id for r in c.validate_constraints(limits).ok.collect()] == ["a"]


def test_lexical_search(spark, tmp_path):
    docs = spark.createDataFrame([("P1", "Title: Acoustic guitar"), ("P2", "Title: USB microphone for recording"), ("P3", "drum")], "doc_id string, text string")
    index = build_lexical_index(docs)
    ask = lambda *qs: [r.doc_id for r in bm25_search(index, spark.createDataFrame([(str(i), q) for i, q in enumerate(qs)], "query_id string, query string"), 5).collect()]
    assert ask("microphone recording") == ["P2"] and ask("violin") == [] and ask("") == []
    with pytest.raises(ValueError):
        bm25_search(index, docs, 0)
    with pytest.raises(ValueError):
        check_ids(docs.unionByName(docs.limit(1)))
    write_lexical_index(index, str(tmp_path / "i"))
    assert read_lexical_index(spark, str(tmp_path / "i")).terms.count() == index.terms.count()


def test_responses(spark):
    final = spark.createDataFrame([("q", "P1", 1, 0.5, ["dense"]), ("q", "P2", 2, 0.4, ["dense"])], "request_id string, parent_asin string, rank int, score double, sources array<string>")
    shown = spark.createDataFrame([("P1", "T", "B", 1.0)], "parent_asin string, title string, brand string, price double")
    told = spark.createDataFrame([("q", "P1", "good", "none", ["r1"], False)], "request_id string, parent_asin string, reason string, potential_cons string, cited_review_ids array<string>, fallback boolean")
    rows = {r.parent_asin: (r.title, r.reason, r.cited_review_ids, r.fallback) for r in recommend.response_rows(final, shown, told).collect()}
    assert rows == {"P1": ("T", "good", ["r1"], False), "P2": (None, "", [], True)}
    stored = spark.createDataFrame([("Q1", True, ["a", "b"]), ("Q2", False, None)], "query_id string, success boolean, results array<string>")
    good, failed = recommend.manual_eval_rows(stored)
    assert [tuple(r) for r in good.collect()] == [("Q1", 1, "a"), ("Q1", 2, "b")] and failed.count() == 1
    filled, lacking = recommend.fill_template(spark.createDataFrame([("Q1", 1), ("Q2", 1)], "query_id string, rank int"), good)
    assert filled.count() == 2 and [r.query_id for r in lacking.collect()] == ["Q2"]


def test_prompts_and_audit_rows(spark):
    from shelfrank.functions import prompts

    df = spark.createDataFrame([("q", "strings", "u")], "request_id string, search_query string, user_id string")
    a, b = df.select(prompts.translation_prompt(F.col("search_query")), prompts.intent_prompt(F.col("search_query"))).first()
    assert a.endswith("strings") and "excluded_brands" in b and b.endswith("strings")
    train = spark.createDataFrame([("u", "P1"), ("u", "P1"), ("u", "P2")], "user_id string, parent_asin string")
    shown = spark.createDataFrame([("TUNER_A", "T", "Snark", 19.99)], "parent_asin string, title string, brand string, price double")
    rows = recommend.audit_run(df, candidates(spark, {"dense": ["TUNER_A", "X"]}), shown, train, 1).collect()
    assert [(r.channel, r.rank, r.title, r.history) for r in rows] == [("dense", 1, "T", 2)]


def test_fused_records_tell_where_they_come_from(spark):
    rows = [("q", "dense", 1, "A", 0.9, "doc of A"), ("q", "bm25", 2, "A", 3.0, None), ("q", "lightgcn", 1, "B", None, None), ("q", "popularity", 1, "A", 7.0, None)]
    cands = spark.createDataFrame(rows, "request_id string, channel string, rank int, parent_asin string, score double, document string")
    none = F.array().cast("array<string>")
    asked = spark.createDataFrame([("q", True, 5, "red guitar")], "request_id string, known_user boolean, top_k int, search_query string").withColumns({"min_price": F.lit(None).cast("double"), "max_price": F.lit(None).cast("double")} | {c: none for c in ("category_tags", "brands", "excluded_brands", "color_tags", "material_tags")})
    items = spark.createDataFrame([("A", "x", 1.0)], "parent_asin string, brand string, price double").withColumns({c: none for c in ("item_categories", "item_colors", "item_materials")})
    (row,) = fusion.fuse(cands, asked, items).final.collect()
    assert row.score_type == "weighted_rrf" and row.source_score_types == {"dense": "dense_score", "bm25": "bm25_score", "popularity": "interaction_count"}
    assert row.retrieval_queries == {"dense": "red guitar", "bm25": "red guitar"} and row.retrieval_query == "red guitar" and row.documents == {"dense": "doc of A"}
    named = cands.withColumns({"retrieval_query": F.when(F.col("channel") == "bm25", "own words"), "score_type": F.lit("given")})
    (row,) = fusion.fuse(named, asked, items).final.collect()
    assert row.retrieval_queries == {"dense": "red guitar", "bm25": "own words"} and set(row.source_score_types.values()) == {"given"}
    (row,) = fusion.fuse(cands.drop("document"), asked.drop("search_query"), items).final.collect()
    assert row.retrieval_queries == {} and row.retrieval_query is None and row.documents == {}
