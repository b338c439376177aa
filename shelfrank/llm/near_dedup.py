"""Near-duplicate documents by fast similarity sketches, banding, exact verification and connected components."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from shelfrank.llm.common import cut, if_small, in_turn, LOWER, mix, shingle_hashes, ship, SPACE, texts, unused, word_bounds, word_hashes

#: Coordinates of a sketch.
COORDINATES = 120

#: The bands are chosen so that a pair at the threshold shares none with at most this probability.
MISS = 1e-6

#: Pivots that a class is held against.
MET = 2

#: Tables of ids alone are broadcast up to so many rows.
IDS = 1_000_000

#: In buckets of up to so many classes every two are held against each other, in larger ones by their rarest shingles.
PAIRED = 12

#: Sizes of sets are parted into classes by this factor.
WIDTH = 1.03

#: Rows of a shingle and two size classes that meet in one task.
CELL = 4096

_NIBBLES = np.arange(0, 64, 4, dtype=np.uint64)

#: Components need more rounds than this only if a chain of links is longer than 2 to this power.
ROUNDS = 60


def sketch(shingles: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """A fast similarity sketch of a set of 64-bit hashes: t values, each of which two sets share with the probability of their similarity.

    In each of the first t rounds every element falls into one bin by a fresh hash; in round t + b all fall into bin b, so
    that each bin is filled at last. A bin keeps its least value, and a value of an earlier round is less than any later one;
    so the work ends with the round that fills the last bin, after about log t rounds for sets of t elements.
    """
    out = np.full(t, ~np.uint64(0))
    for i in range(2 * t):
        h = mix(shingles + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (h >> np.uint64(8)) | np.uint64(i << 56)
        if i < t:
            np.minimum.at(out, (mix(h ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(t)).astype(np.int64), value)
        else:
            out[i - t] = min(out[i - t], value.min())
        if out.max() != ~np.uint64(0):
            break
    return out


def band_rows(similarity: float, t: int = COORDINATES) -> int:
    """The most rows a band can have at the accepted probability of a miss."""
    return max(r for r in range(1, 9) if r == 1 or (1 - similarity**r) ** (t // r) <= MISS)


def most_different(similarity: float, t: int = COORDINATES) -> int:
    """So many of t coordinates differ in four of their bits, for a pair at the threshold, with at most the accepted probability of more."""
    p = (1 - similarity) * 15 / 16
    tail, d = 1.0, -1
    while tail > MISS:
        d += 1
        tail -= math.comb(t, d) * p**d * (1 - p) ** (t - d)
    return d


def _normal(data: np.ndarray, starts: np.ndarray) -> bytes:
    """The words in ASCII lower case, each but the first after one space."""
    keep = ~SPACE[data]
    if len(starts):
        before = starts[1:] - 1
        keep[before] = True
        data = data.copy()
        data[before] = 32
    return LOWER[data[keep]].tobytes()


def _digest(normal: bytes) -> bytes:
    return hashlib.blake2b(normal, digest_size=16).digest()


def _sketched(docs: DataFrame, k: int, r: int) -> DataFrame:
    """doc_id, n_shingles, same (a digest of the normalised words; null without words), bands (a hash of each band), nibbles (four bits of each coordinate)."""
    bands = COORDINATES // r

    def run(batches):
        for batch in batches:
            sizes, same, out, bits = [], [], [], []
            for data in texts(batch.column("text")):
                starts, ends = word_bounds(data)
                if not len(starts):
                    sizes.append(0), same.append(None), out.append(None), bits.append(None)
                    continue
                own = np.unique(shingle_hashes(word_hashes(LOWER[data], starts, ends), k))
                whole = sketch(own)
                rows = whole[: bands * r].reshape(bands, r)
                key = np.arange(bands, dtype=np.uint64)
                for j in range(r):
                    key = mix(key * np.uint64(0xFF51AFD7ED558CCD) + rows[:, j])
                sizes.append(len(own)), same.append(_digest(_normal(data, starts))), out.append(key.view(np.int64))
                four = np.zeros(-(-COORDINATES // 16) * 16, np.uint64)
                four[:COORDINATES] = mix(whole) >> np.uint64(60)
                bits.append(np.bitwise_or.reduce(four.reshape(-1, 16) << _NIBBLES, axis=1).view(np.int64))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(out, lists), pa.array(bits, lists)], ["doc_id", "n_shingles", "same", "bands", "nibbles"])

    return docs.mapInArrow(in_turn("near_dedup", run), "doc_id long, n_shingles long, same binary, bands array<bigint>, nibbles array<bigint>")


def texts_of(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id and text of each class in ids: that text of the class's smallest doc_id which has the class's words."""
    places = if_small(cut(classes.select("id", "doc_id").join(ids, "id", "left_semi")))
    found = docs.where("doc_id is not null").join(places, "doc_id")

    def run(batches):
        for batch in batches:
            own = pa.array([_digest(_normal(data, word_bounds(data)[0])) == i.as_py() for data, i in zip(texts(batch.column("text")), batch.column("id"))], pa.bool_())
            yield batch.filter(own)

    return found.select("id", "text").mapInArrow(in_turn("near_dedup", run), "id binary, text string").dropDuplicates(["id"])


def _shingles(text: bytes, k: int) -> set:
    w = text.lower().split()  # of bytes: only ASCII letters change, and only 0x20 and 0x09 to 0x0D part words
    return set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)}


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets are as similar as asked for: 100 * common >= percent * united."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    text = cut(texts_of(ids, classes, docs))
    both = pairs.join(text.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(text.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")

    def run(batches):
        last, known = None, set()
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("text_a"), batch.column("text_b")):
                x, y = _shingles(a.as_py().encode(), k), b.as_py().encode()
                if y != last:
                    last, known = y, _shingles(y, k)
                common = len(x & known)
                linked.append(100 * common >= percent * (len(x) + len(known) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(in_turn("near_dedup", run), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id that links lead to) of every id in links (a, b).

    Each round gives an id the least label among its neighbours' and its own, then the label of that label.
    """
    edges = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")))
    for _ in range(ROUNDS):
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = cut(lower.join(jump, "component", "left").select("id", "before", F.least("component", "next").alias("component")))
        labels = new.select("id", "component")
        if new.where("before <> component").isEmpty():
            return labels
    raise RuntimeError("links form longer chains than can be")


def _length_class(n):
    """The class of a set's size: sizes of one class differ by a factor of WIDTH at most."""
    return F.floor(F.log(n.cast("double")) / math.log(WIDTH) + 1e-9)


def _least_size(c):
    """No size of the class is below this."""
    return F.floor(F.pow(F.lit(WIDTH), c) * (1 - 1e-6))


def meetings(early: DataFrame, percent: int) -> DataFrame:
    """Pairs (id, id2) of rows (gram, id, component, n, place) of a common gram and different components, at which enough is left.

    Two sets of n and m shingles need percent / (100 + percent) * (n + m) in common, so how late a gram may stand in a set
    depends on the size of the other one. The rows of a gram are therefore parted by the size classes of both sides, and a
    row enters only the parts of those classes for which it stands early enough. Of equal sizes that is about half of what
    may stand first for any size, and exactly so much that sets which agree in too few shingles, all of them the same ones,
    don't meet at all. A part with many rows is dealt into a grid of cells.
    """
    enough = lambda m: (F.col("n") - F.col("place") + 1) * (100 + percent) >= percent * (F.col("n") + m)
    own = _length_class(F.col("n"))
    largest, smallest = F.floor(F.col("n") * 100 / percent), F.ceil(F.col("n") * percent / 100)
    key = ["gram", "c", "c2"]
    low = early.select("*", own.alias("c"), F.explode(F.sequence(own, _length_class(largest))).alias("c2")).where(enough(_least_size(F.col("c2"))))
    high = early.select("*", F.explode(F.sequence(_length_class(smallest), own)).alias("c"), own.alias("c2")).where(enough(F.greatest(_least_size(F.col("c")), smallest)))
    sides = low.select(*key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(high.select(*key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    counted = sides.groupBy(*key).agg(F.sum("a").alias("rows"), F.sum("b").alias("columns")).where((F.col("rows") > CELL) & (F.col("columns") > 0) | (F.col("columns") > CELL) & (F.col("rows") > 0))
    grids = if_small(cut(counted.select(*key, F.ceil(F.col("rows") / CELL).alias("rows"), F.ceil(F.col("columns") / CELL).alias("columns"))))
    rows, columns = F.coalesce("rows", F.lit(1)), F.coalesce("columns", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), n.cast("long"))
    low = low.join(grids, key, "left").select(*key, "id", "component", "n", "place", mine(rows).alias("row"), every(columns).alias("column"))
    high = high.join(grids, key, "left").select(*key, *(F.col(x).alias(f"{x}2") for x in ("id", "component", "n", "place")), every(rows).alias("row"), mine(columns).alias("column"))
    left_over = (F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + 1) * (100 + percent) >= percent * (F.col("n") + F.col("n2"))
    once = (F.col("component") < F.col("component2")) | (F.col("c") < F.col("c2")) & (F.col("component") != F.col("component2"))
    return low.join(high, [*key, "row", "column"]).where(once & left_over).select("id", "id2")


def across(members: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members (id, component) of different components, among them all that are as similar as asked for.

    The shingles of every member are ranked by the number of members that hold them, the rarest first; equal numbers by hash.
    A similar pair has `need` shingles in common at least, so the first of these has need - 1 behind it in either ranking:
    the pair meets at a shingle that stands early in both, and at which enough are left, see meetings(). What a member holds
    alone comes first and meets nobody, so a member with many words of its own makes no pairs at all, whatever the size of
    its group.
    """

    def run(batches):
        for batch in batches:
            for data, i in zip(texts(batch.column("text")), batch.column("id")):
                own = np.unique(shingle_hashes(word_hashes(LOWER[data], *word_bounds(data)), k)).view(np.int64)
                for j in range(0, len(own), 50_000):
                    part = own[j : j + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(part), pa.binary()), pa.array(np.full(len(part), len(own))), pa.array(part)], ["id", "n", "gram"])

    held = cut(texts_of(members.select("id"), classes, docs).mapInArrow(in_turn("near_dedup", run), "id binary, n long, gram long"))
    common = held.groupBy("gram").agg(F.count("*").alias("holders")).where("holders > 1")
    by_id = W.partitionBy("id")
    place = F.col("n") - F.count("*").over(by_id) + F.row_number().over(by_id.orderBy("holders", "gram"))
    early = held.join(common, "gram").withColumn("place", place).where((F.col("n") - F.col("place") + 1) * 100 >= F.col("n") * percent)
    early = cut(early.join(members, "id").select("gram", "id", "component", "n", "place"))
    several = early.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("gram")
    early = cut(early.join(several, "gram", "left_semi"))
    return meetings(early, percent).select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b")).distinct()


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """What group() returns, and same, the digest of each row's words."""
    ship(docs.sparkSession)
    r = band_rows(percent / 100)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = cut(_sketched(docs, k, r))
    known = whole.where("same is not null and doc_id is not null")
    classes = cut(known.groupBy(F.col("same").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("n_shingles", "bands", "nibbles")).alias("x")).select("id", "doc_id", "x.*"))
    banded = classes.select(F.explode("bands").alias("band"), "id", "n_shingles")
    full = banded.groupBy("band").agg(F.count("*").alias("classes")).where("classes > 1")
    buckets = cut(banded.join(full, "band"))
    limit = most_different(percent / 100)

    def near(a: str, b: str):
        """Whether so few coordinates differ as a linked pair's may."""
        different = F.lit(0)
        for j in range(-(-COORDINATES // 16)):
            x = F.col(a)[j].bitwiseXOR(F.col(b)[j])
            for shift in (1, 2):
                x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            different = different + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
        return different <= limit

    central = buckets.groupBy("id").agg(F.sum("classes").alias("met"))
    pivot = F.max_by(F.struct("id", "n_shingles"), F.struct("met", "id"))
    pivots = buckets.join(central, "id").groupBy("band").agg(pivot.alias("p"))
    fits = F.least("n_shingles", "p.n_shingles") * 100 >= F.greatest("n_shingles", "p.n_shingles") * percent  # sizes alone rule other pairs out
    met = buckets.join(pivots, "band").where(fits & (F.col("id") != F.col("p.id"))).groupBy("id", F.col("p.id").alias("pivot")).agg(F.count("*").alias("shared"))
    first = W.partitionBy("id").orderBy(F.desc("shared"), "pivot")
    most = met.withColumn("place", F.row_number().over(first)).where(F.col("place") <= MET)
    sketches = classes.select("id", "nibbles")

    def allowed(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches allow the similarity, as (a, b), once each."""
        both = pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        both = both.join(sketches.withColumnsRenamed({"id": "a", "nibbles": "na"}), "a").join(sketches.withColumnsRenamed({"id": "b", "nibbles": "nb"}), "b")
        return both.where(near("na", "nb")).select("a", "b")

    tried = cut(allowed(most.select(F.col("id").alias("x"), F.col("pivot").alias("y"))))
    links = cut(verify(tried, classes, docs, k, percent))
    found = components(links)

    of = buckets.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = of.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
    of = cut(of.join(mixed, "band", "left_semi"))
    few = of.where(F.col("classes") <= PAIRED)
    other = few.select("band", F.col("id").alias("y"), F.col("component").alias("component2"), F.col("n_shingles").alias("m"))
    sizes = F.least("n_shingles", "m") * 100 >= F.greatest("n_shingles", "m") * percent
    paired = few.join(other, "band").where((F.col("component") < F.col("component2")) & sizes).select(F.col("id").alias("x"), "y")
    members = cut(of.where(F.col("classes") > PAIRED).select("id", "component").distinct())
    fresh = allowed(paired).unionByName(across(members, classes, docs, k, percent)).distinct()
    more = cut(verify(cut(fresh.join(tried, ["a", "b"], "left_anti")), classes, docs, k, percent))
    if not more.isEmpty():
        found = components(links.unionByName(more))

    of_class = classes.select("id", "doc_id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.join(names, "component").select(F.col("id").alias("same"), "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return whole.join(of_class, "same", "left").select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "same")


def group(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Words are runs of bytes other than white space, A-Z in lower case; a document's set has its distinct runs of k words, or
    all its words as one run if they are fewer. Documents with 100 * common >= percent * united shingles are linked; a
    component is named by its smallest doc_id, and kept is true of the document with this id. Texts that are null or without
    words have the empty set and stand alone. Rows that repeat an id with other words are linked by their own words, and each
    is kept if its id names its component; a null id is in no component but its own (null), and kept. An empty table gives an
    empty one; other columns are not touched. Texts are taken as a whole.

    Equal word sequences are one class, so a class of any size costs one. A class that shares bands with most others is the
    pivot of each of its buckets, and every class is held against those pivots with which it shares most bands. Where a bucket
    has several components after that, its classes are held against each other: every two of them in a small bucket, by their
    rarest shingles in a larger one, see across(). So no pair of different texts that shares a band goes unexamined, unless its
    members are connected already. A pair is read only if its sizes, and four bits of each coordinate or its rarest shingles,
    allow the similarity.
    """
    return _grouped(docs, k, percent).drop("same")


def survivors(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The rows of docs that group() keeps, with all their columns; of rows with equal ids and equal words any one, and every row without id."""
    of, words, same = (unused(c, docs.columns) for c in ("of", "words", "same_words"))
    groups = cut(_grouped(docs, k, percent).where("doc_id is not null").select(F.col("doc_id").alias(of), F.col("same").alias(words), "kept"))
    several = if_small(cut(groups.groupBy(of).agg(F.count("*").alias("times")).where("times > 1").select(of)), IDS)
    gone = if_small(cut(groups.where("not kept").select(of).distinct()), IDS)  # fewer than those that stay
    here = F.col("doc_id").cast("long") == F.col(of)
    single = docs.join(gone, here, "left_anti").join(several, here, "left_anti")  # a null id is equal to none, so its row stays

    # Ids of several rows are looked at word by word.
    own, schema = docs.columns, StructType([*docs.schema.fields, StructField(same, BinaryType())])

    def run(batches):
        for batch in batches:
            found = [_digest(_normal(data, starts)) if len(starts := word_bounds(data)[0]) else None for data in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*own, same])

    worded = docs.join(several, here, "left_semi").mapInArrow(in_turn("near_dedup", run), schema)
    stays = groups.join(several, of, "left_semi").where("kept").select(of, words).distinct()
    left = worded.join(stays, here & F.col(same).eqNullSafe(F.col(words)), "left_semi").dropDuplicates(["doc_id", same])
    return single.unionByName(left.select(*(F.col(f"`{c}`") for c in own)))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.doc_id = d.doc_id
"""
