import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfrank.llm import bpe

RANKS = bpe.read_ranks()
VOCABULARY = bpe.Vocabulary(RANKS)
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_texts_encode_as_the_library_does(text):
    ids, decoded = bpe.encode_text(text)
    assert [int(x) for x in ids.split()] == ENCODING.encode_ordinary(text)
    assert decoded == text.encode() == bpe.decode([int(x) for x in ids.split()])


def test_long_runs_and_other_scripts():
    for text in ("a" * 3000, " \n\t" * 400, "日本語" * 200, "-" * 500 + "=" * 700, "\U0001f600'll " * 60, "x" * 100_000):
        ids, decoded = bpe.encode_text(text)
        assert [int(x) for x in ids.split()] == ENCODING.encode_ordinary(text) and decoded == text.encode()


def test_appends_and_edits_equal_a_fresh_table():
    rnd = random.Random(2)
    draw = lambda n: bytes(rnd.choice(b"abcaa  the\xc3\xa9ing") for _ in range(rnd.randrange(n + 1)))
    for _ in range(200):
        base, more = draw(300), draw(20)
        table = bpe.PrefixTable(VOCABULARY, base)
        table.append(more)
        assert table.last == bpe.PrefixTable(VOCABULARY, base + more).last
        data = base + more
        i = rnd.randrange(len(data) + 1)
        j = min(len(data), i + rnd.randrange(9))
        new = draw(6)
        table.replace(i, j, new)
        whole = bpe.PrefixTable(VOCABULARY, data[:i] + new + data[j:])
        assert (table.data, table.last, table.tokens()) == (whole.data, whole.last, whole.tokens())


def test_rows(spark):
    rows = [(1, "ab", "x"), (1, "ab", "x"), (2, None, "y"), (3, "", "y"), (None, "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode(df, with_ids=True)
    got = sorted(((r.doc_id or -1, r.n_tokens, r.ids) for r in out.collect()), key=str)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert got == sorted([(1, 1, [397]), (1, 1, [397]), (2, 0, []), (3, 0, []), (-1, 1, [66])], key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.ids_sha256, r.decoded_sha256) for r in out.where("n_tokens = 0").collect()} == {(empty, empty)}
    assert bpe.encode(df.limit(0)).count() == 0
