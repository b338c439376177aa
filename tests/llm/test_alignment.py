import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from shelfrank.llm import alignment, queries
from shelfrank.llm.common import table

ROOT = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def whole(texts):
    """The definition, on whole texts and with all links written out; rows in the order of the texts."""
    plain = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters = {v: k for k, v in (plain | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}).items()}
    rows, links = [], []
    for text in texts:
        a = b = []
        if text:
            a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
            x = [bytes(letters[c] for c in A.id_to_token(i)) for i in a]
            y = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(x) == b"".join(y) == (" " + text).encode():
                a = b = []
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 3000 else __import__("itertools").accumulate(map(len, parts))
        ea, eb = (list(ends(x)), list(ends(y))) if a else ([], [])
        common = sorted(set(ea) & set(eb))
        ga, gb = defaultdict(list), defaultdict(list)
        place = {}
        k = 0
        for e in range(common[-1] + 1 if common else 0):
            place[e] = k
            k += e == common[k]
        for ids, es, g in ((a, ea, ga), (b, eb, gb)):
            for i, e in zip(ids, es):
                g[place[e]].append(i)
        shown = ";".join(f"{','.join(map(str, ga[k]))}|{','.join(map(str, gb[k]))}" for k in range(len(common)))
        own = Counter((p, q) for k in range(len(common)) for p in ga[k] for q in gb[k])
        links.append(own)
        rows.append((len(a), len(b), len(common), own.total(), hashlib.sha256(shown.encode()).hexdigest() if a else ""))
    counts = Counter(p for own in links for p in own)
    most = Counter()
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    return [(*r[:4], sum(n for p, n in own.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in own.items()), r[4]) for r, own in zip(rows, links)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_whole_table_equals_the_definition(spark):
    docs = table(spark, ROOT, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_cross_tokenizer(spark, ROOT).collect()}
    assert got == {d.doc_id: row for d, row in zip(docs, whole([d.text for d in docs]))}


def test_odd_texts_in_many_small_runs(spark, monkeypatch):
    monkeypatch.setattr(alignment, "RUN_DOCS", 3)
    rnd = random.Random(7)
    texts = [None, "", " ", "  ", "a ", "a  ", " a", "<s> <unk> <0x41> <|endoftext|>", "a\x00b \x00", "x▁y z", "▁ ▁", "日本語 " * 30, "a" * 500, "-=" * 300, " \n\t" * 50, "é\x85 b\x1c c", "same text", "same text"]
    texts += ["".join(rnd.choice("ab1. \n\t 　's é😀<") for _ in range(rnd.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_a": F.lit("own"), "run": F.lit(1)}).repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokens(df).collect()}
    assert got == dict(enumerate(whole(texts)))
    twice = df.unionByName(df.where("doc_id = 16")).withColumn("doc_id", F.when(F.col("doc_id") != 16, F.col("doc_id")))
    rows = alignment.align_tokens(twice).collect()
    assert len(rows) == len(texts) + 1 and sum(r.doc_id is None for r in rows) == 2
    empty = alignment.align_tokens(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", *COLUMNS]


@pytest.mark.parametrize("small", [0, 1024])
def test_groups_of_many_chunks_at_once(monkeypatch, small):
    monkeypatch.setattr(alignment, "SMALL", small)
    tables = alignment.Tables([b"", b"aaa", b"b"], [b"", b"aa", b"ab", b"b"])
    got = alignment.align([[1] * 9 + [2], [1], [2], [1, 2]], [[1] * 13 + [2], [2], [3], [1, 2]], [b"a" * 27 + b"b", b"aaa", b"b", b"aaab"], tables)
    assert got.counts.tolist() == [[10, 14, 5, 4 * 2 * 3 + 2 * 2], [-1, 0, 0, 0], [1, 1, 1, 1], [2, 2, 1, 4]]
    assert got.held.tolist() == [4, 0, 1, 4]
    assert list(zip(got.pairs.tolist(), got.times.tolist())) == [(5, 4 * 6 + 1), (6, 1), (9, 1), (10, 1), (11, 1), (5, 1), (6, 1), (9, 1), (10, 1)]
    assert got.shown[1:] == ["", "2|3", "1,2|1,2"] and got.shown[0].startswith("1,1|1,1,1;1,1|")
    assert alignment.align([], [], [], tables).shown == []


def test_chunks_are_cut_behind_text_only():
    assert alignment.CHUNK.findall(" a b\n c  d\x1c e ") == [" a", " b\n c", "  d\x1c e", " "]


@pytest.mark.parametrize("runs", [1, 5])
def test_merge_finds_counts_and_highest(runs):
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(runs)
    pairs = [np.unique(rnd.integers(0, 400, 150)) for _ in range(runs)]
    held = [rnd.integers(1, 9, len(p)).astype(np.uint32) for p in pairs]
    out = alignment._merge(20)(pa.table({"part": pa.array([0] * runs, pa.int32()), "run": pa.array(range(runs)), "pairs": [alignment._pack(p) for p in pairs], "held": [alignment._pack(h) for h in held]}))
    sums = Counter()
    for p, h in zip(pairs, held):
        for x, n in zip(p.tolist(), h.tolist()):
            sums[x] += n
    for p, row in zip(pairs, out.to_pylist()):
        assert alignment._unpack(row["counts"], np.int64).tolist() == [sums[x] for x in p.tolist()]
        assert alignment._unpack(row["best"], bool).tolist() == [sums[x] == max(n for y, n in sums.items() if y // 20 == x // 20) for x in p.tolist()]
