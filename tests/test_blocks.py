import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfrank.operators import blocks


def frame(spark, v, name, prefix=""):
    return spark.createDataFrame([(f"{prefix}{i:04d}", [float(x) for x in row]) for i, row in enumerate(v)], f"{name} string, vector array<double>")


def brute(v, q, k, masked=()):
    out = []
    for i, x in enumerate(q):
        scores = v @ x
        best = sorted((-round(s, 9), j) for j, s in enumerate(scores) if (i, j) not in masked)[:k]
        out += [(f"q{i:04d}", f"{j:04d}", n + 1) for n, (_, j) in enumerate(best)]
    return sorted(out)


def rows(found):
    return sorted((r.query_id, r.id, r["rank"]) for r in found.rows.collect())


@pytest.fixture(scope="module")
def grouped():
    """Vectors around forty directions, of different lengths, and queries near some of them."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(40, 16))
    v = np.repeat(centres, 50, axis=0) + rnd.normal(scale=0.05, size=(2000, 16))
    v *= rnd.uniform(0.5, 2, size=(2000, 1))
    return v, centres[:25] + rnd.normal(scale=0.05, size=(25, 16))


@pytest.mark.parametrize("make", [blocks.cluster_blocks, blocks.norm_blocks])
def test_search_equals_brute_force_and_reads_fewer_blocks(spark, grouped, make):
    v, q = grouped
    packed = make(frame(spark, v, "id"), size=40)
    assert packed.agg(F.sum(F.size("ids"))).first()[0] == len(v)
    masked = {(0, int(np.argmax(v @ q[0]))), (1, 7), (1, 8)}
    hidden = spark.createDataFrame([(f"q{i:04d}", f"{j:04d}") for i, j in masked], "query_id string, id string")
    found = blocks.search_blocks(packed, frame(spark, q, "query_id", "q"), 5, hidden, first=2)
    assert rows(found) == brute(v, q, 5, masked)
    read, all_ = found.visits.count(), packed.count() * len(q)
    assert found.visits.distinct().count() == read < all_
    if make is blocks.cluster_blocks:
        assert read < all_ / 4


def test_bounds_hold(grouped):
    import pyarrow as pa

    v, q = grouped
    for part in (v[:40], v[::50], -v[:3], v[:1], np.zeros((2, 16)), np.vstack([v[:5], np.zeros((1, 16))])):
        one = blocks._pack(pa.table({"block": pa.array([1] * len(part)), "id": [str(i) for i in range(len(part))], "vector": part.tolist()}))
        head = [np.frombuffer(one["centre"][0].as_py())[None, :], *(np.array([one[c][0].as_py()]) for c in blocks.HEAD[1:])]
        both = np.vstack([q, np.zeros((1, 16)), -q])
        assert (blocks.bounds(both, *head)[:, 0] >= (both @ part.T).max(1) - 1e-9).all()


def test_ties_nulls_and_repeats(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), (None, [9.0, 9.0]), ("d", [0.0, 0.0])], "id string, vector array<double>")
    q = spark.createDataFrame([("x", [1.0, 1.0]), ("y", None), ("z", [0.0, 0.0])], "query_id string, vector array<double>")
    for make in (blocks.cluster_blocks, blocks.norm_blocks):
        assert rows(blocks.search_blocks(make(v, size=1), q, 2, first=1)) == [("x", "a", 1), ("x", "b", 2), ("z", "a", 1), ("z", "b", 2)]
        assert blocks.search_blocks(make(v.limit(0)), q, 2).rows.count() == 0
    assert blocks.search_blocks(blocks.norm_blocks(v), q.limit(0), 2).rows.count() == 0
    with pytest.raises(ValueError):
        blocks.search_blocks(blocks.norm_blocks(v), q.unionByName(q), 2)
    with pytest.raises(ValueError):
        blocks.search_blocks(blocks.norm_blocks(v), q, 0)


def test_a_block_that_all_queries_want_is_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ASKED", 10)
    rnd = np.random.default_rng(2)
    v, q = rnd.normal(size=(30, 4)), rnd.normal(size=(95, 4))
    assert rows(blocks.search_blocks(blocks.norm_blocks(frame(spark, v, "id"), 30), frame(spark, q, "query_id", "q"), 3)) == brute(v, q, 3)


def test_users_of_a_flat_graph_read_few_blocks(spark, monkeypatch):
    from shelfrank.operators import graph

    rnd = np.random.default_rng(8)
    items, users = rnd.normal(size=(2000, 2)), rnd.normal(size=(60, 2))
    nodes = [(f"{kind}:{i:04d}", [float(x) for x in row]) for kind, v in (("i", items), ("u", users)) for i, row in enumerate(v)]
    seen, read = spark.createDataFrame([("0000", "0000")], "user_id string, parent_asin string"), []
    search = blocks.search_blocks
    monkeypatch.setattr(blocks, "search_blocks", lambda *args: read.append(search(*args)) or read[0])
    asked = spark.createDataFrame([(f"{i:04d}",) for i in range(60)], "user_id string")
    found = graph.graph_top_k(spark.createDataFrame(nodes, "node string, vector array<double>"), asked, seen, 5, block=50).collect()
    assert sorted(("q" + r.user_id, r.parent_asin, r["rank"]) for r in found) == brute(items, users, 5, {(0, 0)})
    assert read[0].visits.count() <= 60 * 40 / 8


@pytest.mark.parametrize("listed", [7, 4096])
def test_metrics_search_for_few_users_and_equal_brute_force(spark, monkeypatch, listed):
    """Targets that k unseen items of a short list beat need no search; hits are still those of all items."""
    from shelfrank.operators import graph, popularity

    rnd = np.random.default_rng(11)
    items, users, k = rnd.normal(size=(1500, 3)), rnd.normal(size=(400, 3)), 5
    items[7] = items[8]  # a tie
    order = [[j for _, j in sorted((-round(s, 9), j) for j, s in enumerate(items @ u))] for u in users]
    rows = []
    for i, best in enumerate(order):
        rows += [(f"{i:04d}", f"{j:04d}", "train") for j in best[:6]] + [(f"{i:04d}", f"{best[6]:04d}", "valid")]
        at = 7 + i % 9 if i % 20 == 0 else int(rnd.integers(100, 1500))  # every twentieth target is one of the best, or nearly
        rows += [(f"{i:04d}", f"{best[at]:04d}", "test")]
    rows += [("0001", f"{order[1][8]:04d}", "test"), ("none", "0001", "test"), ("0002", "none", "test")]  # two targets, a user and an item without vectors
    targets = {(u, p) for u, p, s in rows if s == "test"}
    rows.append(rows[7])  # a row that is there twice
    expected = sorted((f"{i:04d}", f"{j:04d}", n) for i, best in enumerate(order) for n, j in enumerate(best[7 : 7 + k], 1) if (f"{i:04d}", f"{j:04d}") in targets)
    nodes = spark.createDataFrame([(f"{c}:{i:04d}", [float(x) for x in row]) for c, v in (("i", items), ("u", users)) for i, row in enumerate(v)], "node string, vector array<double>")
    splits = spark.createDataFrame(rows, "user_id string, parent_asin string, split string")

    searched, search = [], blocks.search_blocks
    monkeypatch.setattr(blocks, "search_blocks", lambda b, queries, *args: searched.append(queries.count()) or search(b, queries, *args))
    seen = splits.where("split <> 'test'")
    hits = graph.graph_hits(nodes, splits.where("split = 'test'"), seen, k, block=50, listed=listed)
    assert sorted(tuple(r) for r in hits.collect()) == expected and len(expected) > 10
    assert listed < 4096 or searched[0] <= 30
    got, owners = popularity.evaluate_graph(nodes, splits, "test", k).first(), [u for u, _ in targets]
    recall = sum(1 / owners.count(u) for u, _, _ in expected) / 401
    assert (got.users, got.hit_rate, got.recall) == (401, round(len({u for u, _, _ in expected}) / 401, 6), pytest.approx(recall, abs=1e-6)) and searched[-1] <= 30


def test_what_is_left_out_is_beaten_beyond_errors_and_unseen(spark):
    rows = [("a", "t", [1.0, 0.0], [1.0, 0.0], None), ("b", "t", [1.0, 0.0], [1.0, 0.0], [1]), ("c", "t", [1.0, 0.0], [3.0, 0.0], []), ("d", "t", [1.0, 0.0], [2.0 - 1e-9, 5.0], []), ("e", "t", [1.0, 0.0], None, [])]
    rows += [("f", "t", [1e200, 0.0], [0.0, 0.0], []), ("g", "t", [-1.0, 0.0], [1.0, 0.0], [])]
    asked = spark.createDataFrame(rows, "query_id string, id string, vector array<double>, target array<double>, places array<int>")
    listed = [[2.0, 0.0], [2.0, 1.0], [1.0, 0.0], [-3.0, 0.0]]
    left = lambda listed, k: sorted(r.query_id for r in blocks.not_beaten(asked, listed, k).collect())
    assert left(listed, 2) == ["b", "c", "d", "f", "g"] and left(listed, 3) == ["a", "b", "c", "d", "f", "g"]
    assert left([[1e200, 0.0]] * 4, 2) == ["a", "b", "c", "d", "f", "g"]  # errors that are not finite leave all rows in
