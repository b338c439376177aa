import random
import re
from collections import Counter

import pytest

from shelfrank.llm import near_dedup, quality
from shelfrank.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = set()
    for i, x in enumerate(zip(w, w[1:], w[2:])):
        if windows[x] > 1:
            inside |= {i, i + 1, i + 2}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), repeats, len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def test_base_counts_equal_their_definition(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    extra = [(9001, None), (9002, ""), (9003, " \x0b\n\n"), (9004, "a b c " * 40), (9005, "é# x " * 60 + "\nq\nq\n q\nq"), (9005, "dup")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = quality.judge(df, None).collect()
    expected = sorted((r.doc_id, *base_counts(r.text)) for r in df.collect())
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == expected
    assert all(r.kept != r.base_failed and r.quality is None for r in rows)


def test_classifier_on_held_out_labels(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = table(spark, root, "documents"), table(spark, root, "labels")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"), 1000)
    judged = quality.judge(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), model).where("not base_failed").collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = sum(r.kept == (truth[r.doc_id] == 1) for r in judged)
    assert right >= 0.97 * len(judged)
    good = [r for r in judged if truth[r.doc_id] == 1]
    assert sum(r.kept for r in good) >= 0.99 * len(good)


def test_labels_that_show_one_class_give_no_model(spark):
    docs = spark.createDataFrame([(i, "word " * 60) for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(6)] + [(None, 0), (1, None)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None and quality.fit(docs, labels.limit(0)) is None
    assert quality.judge(docs.limit(0), None).count() == 0


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, shingles(t, k))
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d, _ in rows)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, k, percent):
    rnd = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(8):
        base = [rnd.choice(words) for _ in range(rnd.randrange(30, 160))]
        for _ in range(14):
            copy = [rnd.choice(words) if rnd.random() < 0.03 else w for w in base]
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, ""), (502, "Two words"), (503, "two\twords "), (504, rows[0][1].upper()), (505, rows[0][1]), (505, rows[0][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    assert sorted(tuple(r) for r in near_dedup.group(df, k, percent).collect()) == brute(rows, k, percent)


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.group(df, 3, 85).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert {tuple(r) for r in near_dedup.group(df, 3, 85).collect()} == {(None, 2, None, True), (1, 2, 1, True)}


def test_sketches_agree_with_the_similarity():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n in (3, 30, 500):
        agree = []
        for _ in range(150):
            pool = rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = pool[: n + n // 2], pool[n // 2 :]
            agree.append((near_dedup.sketch(a) == near_dedup.sketch(b)).mean())
        assert abs(np.mean(agree) - 0.5) < 0.05
    assert near_dedup.band_rows(0.85) == 5 and near_dedup.band_rows(0.8) == 4


def test_repeated_ids_with_other_texts(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long), (5, "one two three four five six"), (3, long + " end"), (7, "one two three four five six"), (5, long), (None, long), (None, None), (8, None), (8, ""), (8, "x")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id int, text string, same int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.group(df, 5, 80).collect()), key=str)
    assert got == sorted([(5, 36, 3, False), (5, 36, 3, False), (5, 2, 5, True), (3, 37, 3, True), (7, 2, 5, False), (None, 36, None, True), (None, 0, None, True), (8, 0, 8, True), (8, 0, 8, True), (8, 1, 8, True)], key=str)
    left = near_dedup.survivors(df, 5, 80)
    assert left.columns == df.columns
    kept = [(r.doc_id, r.text or "") for r in left.collect()]
    assert sorted(kept, key=str) == sorted([(5, "one two three four five six"), (3, long + " end"), (None, long), (None, ""), (8, ""), (8, "x")], key=str)
    assert near_dedup.survivors(df.limit(0), 5, 80).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_rarest_shingles_meet_every_similar_pair(spark, percent):
    from shelfrank.llm.common import cut

    rnd = random.Random(percent)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for _ in range(90):
        words = [w for w in base if rnd.random() > 0.02]
        for _ in range(rnd.randrange(0, 9)):
            words[rnd.randrange(len(words))] = rnd.choice(["x", "y", f"u{rnd.random()}"])
        texts[len(texts)] = " ".join(words)
    texts = dict(enumerate(dict.fromkeys(texts.values())))  # classes have different words
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    classes = cut(near_dedup._sketched(df, 3, 5).selectExpr("same as id", "doc_id"))
    name = {bytes(r.id): r.doc_id for r in classes.collect()}
    members = classes.selectExpr("id", "id as component")
    pairs = near_dedup.across(members, classes, df, 3, percent)
    made = {tuple(sorted((name[bytes(r.a)], name[bytes(r.b)]))) for r in pairs.collect()}
    linked = {tuple(sorted((name[bytes(r.a)], name[bytes(r.b)]))) for r in near_dedup.verify(pairs, classes, df, 3, percent).collect()}
    sets = {d: shingles(t, 3) for d, t in texts.items()}
    expected = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert expected and linked == expected <= made


def early_rows(spark, sets):
    """(gram, id, component, n, place) of every shingle, each set its own component, in one order of all grams."""
    holders = Counter(g for s in sets.values() for g in s)
    rows = [(g, i, i, len(s), p) for i, s in sets.items() for p, g in enumerate(sorted(s, key=lambda g: (holders[g], g)), 1)]
    return spark.createDataFrame(rows, "gram long, id long, component long, n long, place long")


@pytest.mark.parametrize("cell", [3, 4096])
def test_meetings_by_size_classes_lose_no_pair(spark, monkeypatch, cell):
    monkeypatch.setattr(near_dedup, "CELL", cell)
    rnd = random.Random(cell)
    base = list(range(300))
    sets = {i: {g for g in base[: rnd.choice([1, 2, 7, 30, 33, 40, 240, 250, 280, 300])] if rnd.random() > 0.04} | {1000 + rnd.randrange(40) for _ in range(rnd.randrange(4))} for i in range(120)}
    sets = {i: s for i, s in sets.items() if s}
    for percent in (80, 85):
        met = {tuple(sorted(r)) for r in near_dedup.meetings(early_rows(spark, sets), percent).collect()}
        similar = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert similar and similar <= met and all(a != b for a, b in met)


def test_sets_that_share_the_same_too_few_shingles_do_not_meet(spark):
    sets = {i: set(range(100)) | {1000 * (i + 1) + j for j in range(9)} for i in range(300)}  # 100 of 118: below 0.85
    assert near_dedup.meetings(early_rows(spark, sets), 85).count() == 0
    assert near_dedup.meetings(early_rows(spark, {i: set(range(100)) | {1000 * (i + 1) + j for j in range(8)} for i in range(3)}), 85).select("id", "id2").distinct().count() == 3
