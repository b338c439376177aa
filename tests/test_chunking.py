import random
import time

import pytest
from pyspark.sql import functions as F

from shelfrank.operators import chunking
from shelfrank.operators.chunking import SEPARATORS, Splitter, split_texts
from shelfrank.operators.dense import hashed_encoder
from shelfrank.streaming import evidence_index as ei


def plain(text, separators, size, overlap, length):
    """The definition: split, join greedily, go into what is too long."""
    separator, left = None, ()
    for i, s in enumerate(separators):
        if s in text:
            separator, left = s, separators[i + 1 :] if s else ()
            break
    if separator is None:
        parts = [text]
    elif separator:
        first, *rest = text.split(separator)
        parts = [first, *(separator + r for r in rest)]
    else:
        parts = list(text)
    between = length("")

    def join(pieces):
        out, now, total = [], [], 0
        for p in pieces:
            n = length(p)
            if now and total + n + between > size:
                out.append("".join(now).strip())
                while total > overlap or (total + n + (between if now else 0) > size and total > 0):
                    total -= length(now[0]) + (between if len(now) > 1 else 0)
                    now = now[1:]
            now.append(p)
            total += n + (between if len(now) > 1 else 0)
        return [x for x in [*out, "".join(now).strip()] if x]

    out, good = [], []
    for p in filter(None, parts):
        if length(p) < size:
            good.append(p)
            continue
        out, good = out + (join(good) if good else []), []
        out += plain(p, left, size, overlap, length) if left else [p]
    return out + (join(good) if good else [])


@pytest.mark.parametrize("length", [len, lambda t: len(t.split()), lambda t: 2 + len(t) // 3])
def test_splitter_equals_the_definition(length):
    rnd = random.Random(3)
    many = lambda texts: [length(t) for t in texts]
    for _ in range(1500):
        texts = ["".join(rnd.choice(["a", "bb", " ", ", ", ". ", "\n", "\n\n", "; ", "ccccccc", "é", "! "]) for _ in range(rnd.randrange(50))) for _ in range(3)]
        size = rnd.randrange(3, 20)
        s = Splitter(size, rnd.randrange(size), lambda: many, SEPARATORS if rnd.random() < 0.8 else SEPARATORS[:-1])
        assert split_texts(texts, s, many) == [plain(t, s.separators, s.size, s.overlap, length) if t else [] for t in texts]


def test_a_megabyte_is_split_in_a_second():
    rnd = random.Random(1)
    text = "".join(rnd.choice(["word ", "and, ", "text. ", "\n\n", "x" * 40]) for _ in range(90_000))
    began = time.process_time()
    assert len(split_texts([text], Splitter(), chunking.characters())[0]) > 1000
    assert time.process_time() - began < 1


def test_each_level_is_measured_in_one_call():
    calls = []
    measure = lambda texts: calls.append(len(texts)) or [len(t) for t in texts]
    split_texts(["a b " * 50, "c\n\nd" * 50, "e" * 100], Splitter(10, 2), measure)
    assert len(calls) <= 1 + len(SEPARATORS)


def test_columns_stay_and_odd_texts(spark):
    df = spark.createDataFrame([(1, None, ["x"]), (2, "", None), (3, "  \n ", ["own"]), (4, "aaa bbb ccc", None)], "i int, t string, chunks array<string>")
    out = chunking.split_text(df, "t", Splitter(8, 3))
    assert out.columns == ["i", "t", "chunks"]
    assert {r.i: r.chunks for r in out.collect()} == {1: [], 2: [], 3: [], 4: ["aaa bbb", "ccc"]}
    assert chunking.split_text(df.limit(0), "t", Splitter()).count() == 0
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            Splitter(size, overlap)


def test_token_lengths_of_a_vocabulary_file(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"[UNK]": 0, "passage": 1, ":": 2, "a": 3}, unk_token="[UNK]"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "v.json"))
    measure = chunking.tokens(str(tmp_path / "v.json"))
    assert list(measure()(["", "a b"])) == [2, 4]
    df = spark.createDataFrame([("r", "P", None, None, "a b c d e f g h", 1)], "review_id string, parent_asin string, title string, rating double, text string, ts long").withColumns({"helpful_vote": F.lit(0), "verified_purchase": F.lit(True)})
    chunks = ei.chunk_reviews(df, splitter=Splitter(12, 4, measure)).orderBy("chunk_id").collect()
    assert [c.chunk_text for c in chunks] == ["passage: " + x for x in plain("Review text: a b c d e f g h", SEPARATORS, 12, 4, lambda t: measure()([t])[0])] and len(chunks) > 1
    assert chunks[0].timestamp == 1 and set(ei.PAYLOAD) == set(chunks[0].asDict())


COLUMNS = "parent_asin string, review_id string, rating double, title string, text string, helpful_vote long, verified_purchase boolean, ts long"


@pytest.fixture
def stream(spark, tmp_path):
    source, target, state = str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "state")
    put = lambda *rows: spark.createDataFrame([(p, r, 5.0, "t", x, 0, True, 1) for p, r, x in rows], COLUMNS).coalesce(1).write.mode("append").parquet(source)
    run = lambda **k: ei.build_evidence_incremental(spark, source, target, state, hashed_encoder(8), COLUMNS, 1, **{"size": 4, "overlap": 1, **k})
    return put, run, target


def shown(spark, target):
    return sorted((r.chunk_id, r.chunk_text) for r in ei.read_evidence_index(spark, target).collect())


def test_a_restart_counts_as_one_run_does(spark, stream, tmp_path):
    put, run, target = stream
    put(("P1", "r1", "one two three four five"), ("P1", None, "no id"), (" ", "r9", "no product"))
    first = run()
    assert first == {"seen": 3, "skipped": 2, "split": 1, "chunks": 4, "items": 1, "reviews": 1} and run() == first
    put(("P1", "r2", "four"), ("P2", "r3", "five"))
    put(("P2", "r1", "one"))
    again = run()
    whole = ei.build_evidence_incremental(spark, str(tmp_path / "in"), str(tmp_path / "other"), str(tmp_path / "other-state"), hashed_encoder(8), COLUMNS, 9, size=4, overlap=1)
    assert again == whole and again["items"] == 2 and again["seen"] == 6


def test_compaction_keeps_the_newest_rows(spark, stream):
    put, run, target = stream
    put(("P1", "r1", "old"), ("P1", "r2", "kept"))
    run()
    put(("P1", "r1", "new"))
    run()
    before = shown(spark, target)
    assert len(before) == 6 and any("new" in x for _, x in before) and not any("old" in x for _, x in before)
    assert ei.pending(spark, target) == 2 and ei.compact(spark, target) == 1 and ei.pending(spark, target) == 0
    assert shown(spark, target) == before
    put(("P1", "r1", "newest"), ("P3", "r3", "more"))
    run(compact_after=1)
    after = shown(spark, target)
    assert ei.pending(spark, target) == 0 and any("newest" in x for _, x in after) and any("kept" in x for _, x in after)
    base = spark.read.parquet(f"{target}/base-2")
    assert base.select("bucket", "parent_asin").distinct().count() == base.select("parent_asin").distinct().count()
    put(("P3", "r3", "last"))
    run()
    assert any("last" in x for _, x in shown(spark, target))
    assert run(recreate=True)["items"] == 2 and ei.pending(spark, target) > 0


def test_a_batch_that_runs_again_is_not_counted_twice(spark, stream, tmp_path):
    import shutil

    put, run, target = stream
    put(("P1", "r1", "one"))
    first = run()
    shutil.rmtree(tmp_path / "state" / "commits")  # as if the run had ended before it was noted
    assert run() == first and len(shown(spark, target)) == 3


def test_splitter_in_the_stream(spark, stream):
    put, run, target = stream
    put(("P1", "r1", "one two. three four"))
    assert run(splitter=Splitter(20, 0))["split"] == 1
    assert all(len(x) <= len("passage: ") + 20 for _, x in shown(spark, target))
