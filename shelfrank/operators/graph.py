"""The bipartite graph model: propagation, training by Bayesian personalised ranking, and recommendation."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfrank.operators import blocks
from shelfrank.sources.shared import bucketed, cut, if_small, numbered

#: A layer is sent to all tasks if it has at most so many numbers.
SENT_VALUES = 4_000_000

#: Items of a block, and blocks that a user reads first.
ITEM_BLOCK, FIRST_BLOCKS = 1024, 2

#: Items (those with the least hashes) that targets are held against before any search.
LISTED = 4096

#: A source with more edges is split into parts of so many.
HEAD = 16_384

ADAM = (0.9, 0.999, 1e-8)


def user_node(c: Column | str) -> Column:
    return F.concat(F.lit("u:"), c)


def item_node(c: Column | str) -> Column:
    return F.concat(F.lit("i:"), c)


def build_graph(train: DataFrame, repeats: bool = True) -> DataFrame:
    """src, dst, w: each training row in both directions; w counts repeats. Rows that are known to be distinct are not grouped."""
    pairs = train.groupBy("user_id", "parent_asin").agg(F.count("*").cast("double").alias("w")) if repeats else train.select("user_id", "parent_asin", F.lit(1.0).alias("w"))
    user, item = user_node("user_id"), item_node("parent_asin")
    both = F.array(F.struct(user.alias("src"), item.alias("dst"), "w"), F.struct(item.alias("src"), user.alias("dst"), "w"))
    return pairs.select(F.inline(both))  # a union would find the pairs twice


def degrees_of(edges: DataFrame) -> DataFrame:
    """node, d, n of each source: the sum of its weights and the number of its edges, as a written table."""
    return cut(edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d"), F.count("*").alias("n")))


@dataclass(frozen=True)
class Walk:
    """Edges (src, part, dst, w) in buckets of (src, part), the sources that have several parts (src, parts), and all degrees (node, d).

    Where layers are small enough to be sent to the edges there are neither parts nor heads. Weights are normalised by degrees on
    the nodes' side, before and behind a pass, so that edges never meet them.
    """

    edges: DataFrame
    heads: DataFrame | None
    degrees: DataFrame


def _few(nodes: DataFrame, dims: int) -> bool:
    """Whether a layer of these nodes is sent to all tasks."""
    return nodes.count() <= SENT_VALUES // max(dims, 1)


def walk_of(edges: DataFrame, few: bool = False, degrees: DataFrame | None = None) -> Walk:
    """Edges as layers pass over them; they are read more than once. A source of many edges is split into parts of about HEAD edges by their other ends."""
    counts = degrees_of(edges) if degrees is None else degrees
    degrees = counts.select("node", "d")
    if few:
        return Walk(edges, None, degrees)
    heads = cut(counts.where(F.col("n") > HEAD).select(F.col("node").alias("src"), F.ceil(F.col("n") / F.lit(HEAD)).alias("parts")))
    part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1)))
    return Walk(bucketed(edges.join(if_small(heads), "src", "left").select("src", part.alias("part"), "dst", "w"), ["src", "part"], ordered=False), heads, degrees)


def _near(walk: Walk, layer: DataFrame) -> DataFrame:
    """Edges with the values of their sources. A small layer is sent to the edges; a larger one is dealt out as the edges lie, heads once a part."""
    named = layer.withColumnRenamed("node", "src")
    if walk.heads is None:
        return walk.edges.join(F.broadcast(named), "src")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))
    dealt = named.join(if_small(walk.heads), "src", "left").withColumn("part", parts).drop("parts")
    return walk.edges.join(dealt.hint("shuffle_hash"), ["src", "part"])  # edges are not sorted


def propagate(edges: DataFrame | Walk, nodes: DataFrame, layers: int = 3) -> DataFrame:
    """node, vector: the mean of the node vectors (node, vector) and of their `layers` smoothings over normalised edges.

    Edges are written once, for large layers in buckets of their sources, and stay where they are while layers pass; weighted vectors are summed
    in each task before they are shuffled. A weight is divided by the roots of both ends' degrees: layers hold vectors over the
    root of the node's degree, so a pass is a sum over raw weights and a division by the degree. What no edge reaches has no row in a
    layer, and the layers meet once, in one sum at the end.
    """
    dims = len(nodes.select("vector").first().vector)
    names = [f"x{d}" for d in range(dims)]
    wide = cut(nodes.select("node", *(F.col("vector")[d].cast("double").alias(x) for d, x in enumerate(names))))
    walk = edges if isinstance(edges, Walk) else walk_of(cut(edges), _few(wide, dims))
    degrees = if_small(walk.degrees)
    layer = cut(wide.join(degrees, "node").select("node", *((F.col(x) / F.sqrt("d")).alias(x) for x in names)))
    total = wide
    for _ in range(layers):
        sums = _near(walk, layer).groupBy(F.col("dst").alias("node")).agg(*(F.sum(F.col("w") * F.col(x)).alias(x) for x in names))
        passed = cut(sums.join(degrees, "node").select("node", "d", *((F.col(x) / F.col("d")).alias(x) for x in names)))
        layer = passed.drop("d")
        total = total.unionByName(passed.select("node", *((F.col(x) * F.sqrt("d")).alias(x) for x in names)))
    total = total.groupBy("node").agg(*(F.sum(x).alias(x) for x in names)).join(wide.select("node"), "node", "left_semi") if layers else total
    return total.select("node", F.array(*(F.col(x) / (layers + 1) for x in names)).alias("vector"))


def graph_top_k(vectors: DataFrame, users: DataFrame, seen: DataFrame, k: int = 10, block: int = ITEM_BLOCK) -> DataFrame:
    """user_id, parent_asin, score, rank: each known user's k best items by dot product, without those seen; ties by id.

    Items lie in blocks of about `block` near ones, whose bounds are narrow. A user reads the blocks that promise most, then only those whose
    bound reaches the k-th score; what the user has seen is masked by its places in a block.
    """
    if k < 0 or block <= 0:
        raise ValueError("k must not be negative, block must be positive")
    if not k:
        return users.sparkSession.createDataFrame([], "user_id string, parent_asin string, score double, rank int")
    return _best_items(cut(vectors), users, seen, k, block)


def _side(vectors: DataFrame, kind: str, name: str) -> DataFrame:
    """The vectors of the users (u) or items (i), by their own names."""
    return vectors.where(F.col("node").startswith(f"{kind}:")).select(F.substring("node", 3, 1 << 30).alias(name), "vector")


def _best_items(vectors: DataFrame, users: DataFrame, seen: DataFrame, k: int, block: int) -> DataFrame:
    asked = if_small(cut(users.select(F.col("user_id").alias("query_id")).distinct()))
    own = _side(vectors, "u", "query_id").join(asked, "query_id", "left_semi")
    masked = seen.select(F.col("user_id").alias("query_id"), F.col("parent_asin").alias("id")).join(asked, "query_id", "left_semi")
    found = blocks.search_blocks(blocks.cluster_blocks(_side(vectors, "i", "id"), block), own, k, masked, FIRST_BLOCKS).rows
    return found.select(F.col("query_id").alias("user_id"), F.col("id").alias("parent_asin"), "score", "rank")


def graph_hits(vectors: DataFrame, targets: DataFrame, seen: DataFrame, k: int = 10, block: int = ITEM_BLOCK, listed: int = LISTED) -> DataFrame:
    """user_id, parent_asin, rank: those of targets (user_id, parent_asin) that graph_top_k() has among its rows.

    Targets are first held against a short list of items. Where k of them that the user hasn't seen score more than the target, it is not among the
    k best, whatever the other items are; only users with a target that this doesn't rule out are searched for, over all items.
    """
    if not k:
        return graph_top_k(vectors, targets, seen, k, block).drop("score")
    if k < 0 or block <= 0:
        raise ValueError("k must not be negative, block must be positive")
    vectors, targets = cut(vectors), targets.select("user_id", "parent_asin")
    items = _side(vectors, "i", "parent_asin").where("vector is not null")
    short = items.orderBy(F.xxhash64("parent_asin"), "parent_asin").limit(listed).collect()
    if not short:
        return graph_top_k(vectors, targets, seen, 0).drop("score")
    places = F.broadcast(targets.sparkSession.createDataFrame([(r.parent_asin, i) for i, r in enumerate(short)], "parent_asin string, place int"))
    taken = seen.join(places, "parent_asin").groupBy("user_id").agg(F.collect_set("place").alias("places"))
    met = targets.join(items.withColumnRenamed("vector", "target"), "parent_asin").join(_side(vectors, "u", "user_id"), "user_id").join(taken, "user_id", "left")
    left = cut(blocks.not_beaten(met.select(F.col("user_id").alias("query_id"), F.col("parent_asin").alias("id"), "vector", "target", "places"), [r.vector for r in short], k))
    left = left.withColumnsRenamed({"query_id": "user_id", "id": "parent_asin"})
    return _best_items(vectors, left, seen, k, block).join(left, ["user_id", "parent_asin"], "left_semi").select("user_id", "parent_asin", "rank")


def number(df: DataFrame, key: str) -> DataFrame:
    """df with ordinal, from 0 in the order of a unique key."""
    return numbered(df, [F.asc(key)])


def _hashed(ordinal: Column, n: Column, seed: int, epoch: int) -> Column:
    """A draw from 0 to n - 1 for a pair, the same on every run."""
    return F.pmod(F.xxhash64("user_id", "parent_asin", F.lit(epoch), F.lit(seed), ordinal), n).cast("long")


def sample_negatives(pairs: DataFrame, items: DataFrame, seed: int, epoch: int, draws: int = 8, rounds: int = 4) -> DataFrame:
    """pairs (user_id, parent_asin) with negative: a uniform item that the user doesn't have, the same on every run.

    Each pair draws several hashed ordinals at once; draws that hit the user's items go, the lowest of the rest counts, and
    pairs without one draw again. After some rounds only users are left who have nearly all items: they draw from those that
    they lack, which are listed for them. A user who has every item is an error.
    """
    catalog = cut(number(items.select("parent_asin").distinct(), "parent_asin"))
    n = catalog.count()
    owned = pairs.select("user_id", "parent_asin").distinct()
    if not owned.groupBy("user_id").agg(F.count("*").alias("c")).where(F.col("c") >= n).isEmpty():
        raise ValueError("a user has every item")
    left, found = owned, None
    for r in range(rounds):
        ordinals = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("j")
        drawn = left.select("user_id", "parent_asin", ordinals).withColumn("ordinal", _hashed(F.col("j") + r * draws, F.lit(n), seed, epoch))
        named = drawn.join(if_small(catalog.withColumnRenamed("parent_asin", "negative")), "ordinal")
        fresh = named.join(owned.select("user_id", F.col("parent_asin").alias("negative")), ["user_id", "negative"], "left_anti")
        got = cut(fresh.groupBy("user_id", "parent_asin").agg(F.min_by("negative", "j").alias("negative")))
        found = got if found is None else found.unionByName(got)
        left = cut(left.join(got, ["user_id", "parent_asin"], "left_anti"))
        if left.isEmpty():
            return found
    return _of_complement(left, owned, catalog, n, seed, epoch) if found is None else found.unionByName(_of_complement(left, owned, catalog, n, seed, epoch))


def _of_complement(left: DataFrame, owned: DataFrame, catalog: DataFrame, n: int, seed: int, epoch: int) -> DataFrame:
    """Draws of pairs whose users have nearly all items, from what these users lack: a list hardly longer than their own rows."""
    users = left.select("user_id").distinct()
    all_ = users.withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    has = owned.join(users, "user_id", "left_semi").join(catalog, "parent_asin").select("user_id", "ordinal")
    lacks = cut(all_.join(has, ["user_id", "ordinal"], "left_anti"))
    placed = lacks.withColumn("at", (F.row_number().over(W.partitionBy("user_id").orderBy("ordinal")) - 1).cast("long"))
    sizes = lacks.groupBy("user_id").agg(F.count("*").alias("size"))
    drawn = left.join(sizes, "user_id").withColumn("at", _hashed(F.lit(-1), F.col("size"), seed, epoch)).drop("size")
    named = drawn.join(placed, ["user_id", "at"]).join(catalog.withColumnRenamed("parent_asin", "negative"), "ordinal")
    return named.select("user_id", "parent_asin", "negative")


def train_lightgcn(train: DataFrame, dims: int = 8, layers: int = 3, epochs: int = 5, lr: float = 0.01, reg: float = 1e-4, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """Final node vectors and the losses of full-batch training.

    Propagation is linear and symmetric, so the gradient by the first vectors is the propagated gradient by the final ones.
    Regularisation acts on the first vectors of the sampled users and items. Steps are those of Adam.
    """
    edges = cut(build_graph(train))
    start = lambda d: ((F.pmod(F.xxhash64("node", F.lit(seed), F.lit(d)), F.lit(2_000_003)) / 2_000_003.0) - 0.5) * 0.2
    names = [f"x{d}" for d in range(dims)]
    nodes = cut(edges.select(F.col("src").alias("node")).distinct().select("node", F.array(*(start(d) for d in range(dims))).alias("vector")))
    few = _few(nodes, dims)
    walk = walk_of(edges, few)
    zero = F.array(*[F.lit(0.0)] * dims)
    state = nodes.select("node", "vector", zero.alias("m"), zero.alias("v"))
    pairs = train.select("user_id", "parent_asin").distinct()
    items = train.select("parent_asin").distinct()
    n = pairs.count()
    losses = []
    zip_ = lambda a, b, f: F.zip_with(a, b, f)
    for epoch in range(epochs):
        final = cut(propagate(walk, state.select("node", "vector"), layers))
        sampled = sample_negatives(pairs, items, seed, epoch).select(user_node("user_id").alias("u"), item_node("parent_asin").alias("p"), item_node("negative").alias("q"))
        look = lambda name: (F.broadcast if few else lambda x: x)(final.select(F.col("node").alias(name), F.col("vector").alias(f"{name}v")))
        met = sampled.join(look("u"), "u").join(look("p"), "p").join(look("q"), "q")
        dot = F.aggregate(zip_("uv", zip_("pv", "qv", lambda a, b: a - b), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        met = cut(met.withColumn("x", dot))
        pull = F.lit(-1.0 / n) / (1 + F.exp("x"))  # of the loss by x
        parts = met.select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("node"), zip_("pv", "qv", lambda a, b: (a - b) * pull).alias("g")),
                    F.struct(F.col("p").alias("node"), F.transform("uv", lambda a: a * pull).alias("g")),
                    F.struct(F.col("q").alias("node"), F.transform("uv", lambda a: -a * pull).alias("g")),
                )
            ).alias("z")
        )
        grads = parts.groupBy("z.node").agg(*(F.sum(F.col("z.g")[d]).alias(x) for d, x in enumerate(names)), F.count("*").alias("touched"))
        full = cut(nodes.select("node").join(grads, "node", "left").fillna(0.0, names).fillna(0, ["touched"]))
        back = propagate(walk, full.select("node", F.array(*names).alias("vector")), layers)
        step = state.join(back.select("node", F.col("vector").alias("g")), "node").join(full.select("node", "touched"), "node")
        step = step.withColumn("g", zip_("g", "vector", lambda g, w: g + F.lit(reg / n) * F.col("touched") * w))
        b1, b2, eps = ADAM
        step = step.withColumn("m", zip_("m", "g", lambda m, g: b1 * m + (1 - b1) * g)).withColumn("v", zip_("v", "g", lambda v, g: b2 * v + (1 - b2) * g * g))
        move = zip_("m", "v", lambda m, v: lr * (m / (1 - b1 ** (epoch + 1))) / (F.sqrt(v / (1 - b2 ** (epoch + 1))) + eps))
        loss = met.agg(F.avg(F.log1p(F.exp(-F.col("x"))))).first()[0]
        losses.append(float(loss))
        state = cut(step.select("node", zip_("vector", move, lambda w, d: w - d).alias("vector"), "m", "v"))
    return cut(propagate(walk, state.select("node", "vector"), layers)), losses


def save_embeddings(vectors: DataFrame, history: DataFrame, edges: DataFrame, path: str, config: dict | None = None) -> None:
    """Vectors, histories and edges as tables, with the version of their layout and the configuration of the model."""
    for name, df in (("nodes", vectors), ("history", history), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = [(1, json.dumps(config or {}, sort_keys=True))]
    vectors.sparkSession.createDataFrame(meta, "version int, config string").write.mode("overwrite").parquet(f"{path}/meta")


def load_embeddings(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    if (version := spark.read.parquet(f"{path}/meta").first().version) != 1:
        raise ValueError(f"unknown layout version {version}")
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "history", "edges"))


def load_config(spark, path: str) -> dict:
    """The configuration that a model was saved with."""
    return json.loads(spark.read.parquet(f"{path}/meta").first().config)
