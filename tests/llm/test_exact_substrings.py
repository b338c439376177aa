import hashlib
import random
from collections import Counter

import pytest

from shelfrank.llm import exact_substrings as xs
from shelfrank.llm.common import table

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, length):
    count = Counter()
    raws = [(d, (t or "").encode()) for d, t in rows]
    for _, r in raws:
        count.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def ran(spark, rows, **k):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in xs.remove_repeats(df, **k).collect()), key=str)


def made(seed, n, letters="abcdefgh ", passage=260):
    rnd = random.Random(seed)
    text = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    shared = [text(rnd.randrange(100, passage)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(rnd.randrange(0, 300))]
        for _ in range(rnd.randrange(0, 4)):
            s = rnd.choice(shared)
            a = rnd.randrange(0, 40)
            parts += [s[a : len(s) - rnd.randrange(0, 40)], text(rnd.randrange(0, 200))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = made(seed, 60)
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "ä" * 700), (104, "xy" * 400 + rows[4][1])]
    assert ran(spark, rows) == brute(rows, 200)


def test_large_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(xs, "SORTED", 3)
    rows = made(9, 60)
    assert ran(spark, rows) == brute(rows, 200)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(333)) + "end"
    rows = [(1, text), (1, text), (2, "short")]
    assert ran(spark, rows) == brute(rows, 200)
    assert ran(spark, []) == []
    assert ran(spark, [(None, "a b c")])[0][0] is None


def test_null_and_repeated_ids(spark):
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared, other = text(300), text(250)
    rows = [(1, text(90) + shared), (None, shared + text(50)), (None, text(300)), (7, text(40) + other), (7, text(20) + other + text(60)), (8, text(400)), (None, None), (None, None)]
    rows += [(9, rows[5][1][:150] + text(100)), (None, rows[2][1])]
    assert ran(spark, rows) == brute(rows, 200)
    assert sum(r[2] for r in brute(rows, 200)) >= 2 * 300 + 2 * 250 + 2 * 300


def test_bucket_order_is_lexicographic_with_true_common_lengths():
    rnd = random.Random(4)
    words = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 5))) for _ in range(40)]
    tail = bytes(rnd.choice(b"ab") for _ in range(120))
    suffixes = [tail[: rnd.randrange(0, 120)] + rnd.choice(words) for _ in range(200)]
    order, common = xs.bucket_order(suffixes, [rnd.randrange(1000) for _ in suffixes])
    ordered = [suffixes[i] for i in order]
    assert ordered == sorted(suffixes)
    for k in range(1, len(ordered)):
        a, b = ordered[k - 1], ordered[k]
        n = common[k]
        assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


def test_anchors_are_chosen_by_content_across_chunks(monkeypatch):
    import numpy as np

    rnd = random.Random(5)
    raw = bytes(rnd.randrange(97, 123) for _ in range(9000))
    whole = xs.anchors(np.frombuffer(raw, np.uint8))
    monkeypatch.setattr(xs, "_CHUNK", 500)
    for a, b in zip(whole, xs.anchors(np.frombuffer(raw, np.uint8))):
        assert (a == b).all()
    at = set(whole[0].tolist())
    assert all(any(p in at for p in range(i, i + 137)) for i in range(len(raw) - 199))


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in xs.remove_repeats(docs).collect()), key=str) == brute(rows, 200)
