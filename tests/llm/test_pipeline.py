"""The pipeline's rows against a plain version that holds all documents at once."""

import hashlib
import re

import public_tokenizers
import tiktoken
from test_quality_and_dedup import base_counts, brute
from test_text_scans import ASSIGN, leaks, shingles, similarity

import corpus_pipeline
from shelfrank.llm import bpe, quality, secrets
from shelfrank.llm.common import table, texts, word_bounds, word_hashes

ROOT = "/root/testdata/sf0.001"


def redacted(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for order, rule in enumerate(secrets.RULES[1:], 1):
        found += [(m.start(), order, m.end()) for m in re.finditer(rule.pattern, text) if len(m[0]) >= rule.least]
    out, at = "", 0
    for start, _, end in sorted(found):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def holds_item(text, items):
    words = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    w, runs = words(text), set(shingles(words(text)))
    near = [(i, t) for i, t in items if runs & set(shingles(words(t)))]  # of others no window is similar
    return bool(leaks([(0, text)], near)) or any(5 <= len(w) < len(v) and similarity(w, v) >= 0.8 for v in (words(t) for _, t in near))


def test_rows_equal_the_plain_version(spark):
    import pyarrow as pa

    docs, labels = table(spark, ROOT, "documents"), table(spark, ROOT, "labels")
    model = quality.fit(docs, labels)

    def good(text):
        n, *_, failed = base_counts(text)
        if failed:
            return False
        (data,) = texts(pa.array([text]))
        return model is None or model.probability(quality.features(data, word_hashes(data, *word_bounds(data)))) >= quality.THRESHOLD

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = [r for r in rows if good(r[1])]
    kept = {d for d, _, _, stays in brute(rows, 5, 80) if stays}
    items = [tuple(r) for r in table(spark, ROOT, "benchmark").select("item_id", "text").collect()]
    rows = [(d, t) for d, t in rows if d in kept and not holds_item(t, items)]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    expected = []
    for d, t in rows:
        ids = encoding.encode_ordinary(redacted(t))
        expected.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), ids))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.ids) for r in corpus_pipeline.run(spark, ROOT).collect()]
    assert expected and sorted(got) == sorted(expected)


def test_rows_without_id_and_with_repeated_ids(spark):
    """Each row is judged by its own text in every stage but the last two, which keep all."""
    long = " ".join(f"word{i}" for i in range(60))
    item = table(spark, ROOT, "benchmark").orderBy("item_id").first().text
    rows = [(None, f"{long} {item}"), (None, long), (1, f"{long} {item}"), (1, long + " other"), (2, long + " token=abcdefgh1234")]
    df = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["decontamination"](spark, df, ROOT)
    assert clean.columns == df.columns and sorted((str(r.doc_id), r.text) for r in clean.collect()) == sorted((str(d), t) for d, t in (rows[1], rows[3], rows[4]))
    marked = {(r.doc_id, r.text) for r in stages["secret_scans"](spark, df, ROOT).collect()}
    assert (2, long + " [SECRET]") in marked and len(marked) == 5
    assert stages["byte_bpe"](spark, df.limit(0), ROOT).count() == 0 and stages["near_duplicates"](spark, df, ROOT).count() == 4


def test_stages_keep_further_columns_and_do_not_disturb_each_other(spark):
    from pyspark.sql import functions as F

    names = ("spans", "kept", "quality", "_blob", "blob", "_key", "key", "_same", "same", "_of", "words", "n_words", "rules", "id")
    docs = table(spark, ROOT, "documents").withColumns({n: F.concat(F.lit(f"{n} "), "doc_id") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, ROOT)
        assert out.columns == docs.columns, name
        rows = out.select("doc_id", *names).collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names), name
    assert dict(corpus_pipeline.STAGES)["byte_bpe"](spark, docs, ROOT).count() == docs.count()
    first = dict(corpus_pipeline.STAGES)["secret_scans"](spark, docs, ROOT)
    dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, ROOT).count()
    assert first.count() == docs.count()
