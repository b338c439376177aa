import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from shelfrank.llm import chat
from shelfrank.llm import language_model as lm
from shelfrank.llm.common import cut, table


def segmentations(text, pieces):
    """The summed probability of all segmentations, by plain recursion."""
    if not text:
        return 1.0
    return sum(pieces[text[:n]] * segmentations(text[n:], pieces) for n in range(1, len(text) + 1) if text[:n] in pieces)


@pytest.mark.parametrize("word", ["the", "thing", "é", "zq", "abab"])
def test_marginals_equal_plain_recursion(word):
    names, weights = lm.inventory()
    plain = segmentations(b" " + word.encode(), dict(zip(names, np.exp(weights))))
    assert lm.log_marginal(word.encode(), weights.tolist()) == pytest.approx(math.log(plain), abs=1e-9)


@pytest.mark.parametrize("word", ["thing", "a" * 60])
def test_expected_counts_cover_the_word(word):
    names, weights = lm.inventory()
    total = np.zeros(len(names))
    lm.expected(word.encode(), 3.0, np.exp(weights).tolist(), total)
    assert sum(n * len(p) for n, p in zip(total, names)) == pytest.approx(3 * (len(word) + 1))
    assert np.exp(weights).sum() == pytest.approx(1)


def test_scores_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    docs = cut(docs.unionByName(spark.createDataFrame([(5001, None), (5002, ""), (5003, "The THE neverseenword Ünknown"), (5003, "twice"), (None, "x")], "doc_id long, text string")))
    rows = docs.collect()
    out = [lm.held_out(r.doc_id) for r in rows]
    assert all(o == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r, o in zip(rows, out) if r.doc_id is not None)
    words = [(r.text or "").encode().lower().split() for r in rows]
    count, ends = Counter(), 0
    for w, o in zip(words, out):
        if not o:
            count.update(w)
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    part = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    expected = sorted((str(r.doc_id), o, len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, round(sum(part(count[x]) for x in w) + part(ends), 5)) for r, o, w in zip(rows, out, words))
    got = lm.score(docs).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    frequent = lm.SENT_WORDS
    try:
        lm.SENT_WORDS = 50  # the same through the join
        joined = lm.score(docs).collect()
    finally:
        lm.SENT_WORDS = frequent
    key = lambda rs: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rs)
    assert key(joined) == key(got)


def test_the_model_predicts_held_out_text_better_than_its_start(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [r for r in lm.score(docs).collect() if r.held_out and r.n_tokens > 30]
    start = lm.inventory()[1].tolist()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows[:20]:
        before = sum(lm.log_marginal(w, start) for w in text[r.doc_id].encode().lower().split()) / math.log(10)
        assert r.score > before


def test_no_documents(spark):
    assert lm.score(cut(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello"), (1, 3, "cat", None), (1, 4, "ann", "Bye"),
    (2, 0, "system", "alone"), (3, None, None, "who"), (3, 1, "ann", "x"), (3, 1, "ann", "x"), (None, 1, "ann", ""), (None, 0, "bob", "é😀"),
]


def test_views(spark):
    df = spark.createDataFrame([(*t, 7) for t in TURNS], "conv_id long, turn long, role string, text string, start long")
    rows = chat.rotate(df, 3).collect()
    view = {(r.conv_id, r.speaker): "" for r in rows}
    for r in sorted(rows, key=lambda r: r.start):
        view[r.conv_id, r.speaker] += r.text
    assert set(view) == {(1, "ann"), (1, "bob"), (1, "cat"), (3, "unknown"), (3, "ann"), (None, "ann"), (None, "bob")}
    assert view[1, "bob"] == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user name=ann\nHi<|im_end|>\n<|im_start|>assistant\nHello<|im_end|>\n<|im_start|>user name=cat\n<|im_end|>\n<|im_start|>user name=ann\nBye<|im_end|>\n"
    for r in rows:
        whole = view[r.conv_id, r.speaker]
        assert whole[r.start : r.end] == r.text
        if r.role == "assistant":
            assert whole[r.mask_start : r.mask_end].endswith("<|im_end|>") and r.name is None
        else:
            assert r.mask_start is None
    assert chat.rotate(df.limit(0)).count() == 0


def test_views_equal_their_sql_whatever_the_ranges(spark):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    theirs = duck.execute(chat.ORACLE)
    names = [d[0] for d in theirs.description]
    expected = sorted(map(str, theirs.fetchall()))
    turns = table(spark, "/root/testdata/sf0.001", "conversations")
    for parts in (1, 40):
        assert sorted(str(tuple(r[c] for c in names)) for r in chat.rotate(turns, parts).collect()) == expected


def test_pipeline_stages(spark):
    root = "/root/testdata/sf0.001"
    docs = table(spark, root, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, root))
        assert name == "byte_bpe" or out.columns == docs.columns
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scans", "byte_bpe"]
    assert kept["quality_rules"] > kept["near_duplicates"] >= kept["decontamination"] == kept["secret_scans"] == kept["byte_bpe"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, root).collect()} == kept["byte_bpe"]
