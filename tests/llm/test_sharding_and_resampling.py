import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfrank.llm import queries, resampling, sharding
from shelfrank.llm.common import table

ROOT = "/root/testdata/sf0.001"


def cut_line(rows, shards):
    """Shard and slot of (key, text) rows that are in order, by the definition."""
    sizes = [len((t or "").encode()) + 16 for _, t in rows]
    total, start, out, slots = sum(sizes), 0, [], Counter()
    for z in sizes:
        shard = (2 * start + z) * shards // (2 * total)
        out.append((z, shard, slots[shard]))
        slots[shard] += 1
        start += z
    return out


def test_whole_table_is_cut_into_equal_parts(spark):
    docs = sorted((r.doc_id, r.text) for r in table(spark, ROOT, "documents").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op11_sharding(spark, ROOT).collect()}
    assert len(got) == len(docs)
    for (i, text), (size, shard, slot) in zip(docs, cut_line(docs, 40)):
        r = got[i]
        assert (r.size, r.shard, r.slot, r.text_crc32, r.law, r.grown_shard) == (size, shard, slot, zlib.crc32((text or "").encode()), "bytes", None)


def test_shards_are_near_equal_whatever_the_partitions(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 37).cast("int")).alias("text"), F.lit(1).alias("size"), F.lit("x").alias("_key"))
    first = sharding.assign(docs.repartition(7), 13).collect()
    assert sorted(first) == sorted(sharding.assign(docs, 13).collect())
    sums = Counter()
    for r in first:
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) <= 2 * (16 + 72)


def test_odd_rows_and_a_key_that_holds_most(spark):
    rows = [(None, None), (None, "a"), (3, ""), (3, ""), (3, "x"), *[(5, "same")] * 400]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(docs, 7).collect()
    assert len(got) == 405 and {r.shard for r in got} == set(range(7))
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert [(r.size, r.text_crc32) for r in got if r.doc_id is None and r.size == 16] == [(16, 0)]
    assert sharding.assign(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(docs, 0)


def test_written_shards_hold_all_columns(spark, tmp_path):
    docs = table(spark, ROOT, "documents").withColumn("slot", F.lit("own"))
    sharding.write_shards(docs, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*docs.columns, "shard"}
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in docs.collect())
    for f in sorted((tmp_path / "s").iterdir()):
        if f.name.startswith("shard="):
            slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
            assert slots == sorted(slots)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def drawn(docs, target, percent=5, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            side.update(map(bucket, bag(x)[0]))
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for i, x in docs:
        found, n = bag(x)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((-r[3], r[0]) for r in rows if r[4] >= min_words and r[0] is not None)
    rank = {i: k + 1 for k, (_, i) in enumerate(able[: percent * len(able) // 100])}
    return sorted((r[:4] + (rank.get(r[0]) if r[4] >= min_words else None,) for r in rows), key=str)


def test_resampling_equals_its_definition(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, ROOT, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, ROOT, "benchmark").collect()]
    got = sorted(map(tuple, queries.op13_target_resampling(spark, ROOT).collect()), key=str)
    assert got == drawn(docs, target)
    assert sum(r[4] is not None for r in got) == 5 * sum(bag(x)[1] >= 20 for _, x in docs) // 100


def test_resampling_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \x00.- "), (4, "A a-A 日本 é1 " * 9), (4, "A a-A 日本 é1 " * 9), (5, "w" * 2000 + " x"), (6, "word " * 20), (7, "Zürich Straße " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"weight": F.lit("own"), "rank": F.lit(1)})
    target = spark.createDataFrame([("a a 日本",), (None,)], "text string")
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in resampling.resample(docs, target, percent=50).collect()), key=str)
    assert got == [r[:4] for r in drawn(rows, ["a a 日本", None])]
    ranks = sorted(r.rank for r in resampling.resample(docs, target, percent=50).collect() if r.rank)
    assert ranks == [1, 2]
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs, target.limit(0)).count() == len(rows)
    with pytest.raises(ValueError):
        resampling.resample(docs, target, percent=101)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(0, 1 << 30))
def test_checksums_of_many_stretches(data, seed):
    rnd = np.random.default_rng(seed)
    starts = rnd.integers(0, len(data), 50)
    lengths = np.array([rnd.integers(0, len(data) - s + 1) for s in starts])
    got = resampling.crc32_of(np.frombuffer(data, np.uint8), starts, lengths)
    assert got.tolist() == [zlib.crc32(data[s : s + n]) for s, n in zip(starts, lengths)]
