"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact check of candidates.

All expressions are Spark's own. A window of a document has as many words as the item it is held against. Its fingerprint
has one bit for each of 60 weighted votes of its words. Fingerprints within RADIUS of an item's agree with it in at least one
of RADIUS + 1 blocks of bits, so an equality join on blocks finds every one of them; blocks of two or three bits agree often, so
windows are only held against items that their text shares rare shingles with. Texts with fewer words than an item are
counted out as a whole, without fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfrank.llm.common import cut, if_small, unused

#: Words in a shingle, and the least weighted similarity, as agreed for all near-duplicate work.
SHINGLE = 5
SIMILARITY = 0.8

#: Bits of a fingerprint, and the greatest Hamming distance that is looked for. At a similarity of 0.8 a ninth of the shingles, and
#: of the words at most, differs, so that a bit differs with a probability of acos(8 / 9) / pi = 0.15; 24 of 60 are passed in 1 of 10^6 cases.
BITS = 60
RADIUS = 24

#: Tables of shingles of items are broadcast up to so many rows.
KNOWN = 500_000

#: Votes are counted in lanes of 20 bits, three to a long, so in 20 longs.
_LANES = 1 | 1 << 20 | 1 << 40
_LONGS = 20
LONGEST_ITEM = (1 << 19) - 1

#: Long texts are taken in segments of so many words, each with as many more as a window that begins in it may need.
SEGMENT = 1 << 16


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; null is empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingle(words: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(SHINGLE)))


def _shingles(words: Column, step: int = 1) -> Column:
    """The hashes of every step-th run of five words."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)), F.lit(step))
    return F.when(n >= SHINGLE, F.transform(starts, lambda i: _shingle(words, i))).otherwise(F.array().cast("array<bigint>"))


def _need(n: Column) -> Column:
    """Shingles that a window of n words must share with an item of n words to be similar enough: inter >= s / (1 + s) * 2 (n - 4)."""
    return F.ceil(2 * SIMILARITY / (1 + SIMILARITY) * (n - SHINGLE + 1) - 1e-9).cast("int")


def _votes(word_hash: Column) -> list[Column]:
    """Sixty bits of a hash as ones in the lanes of twenty longs."""
    return [F.shiftrightunsigned(word_hash, j).bitwiseAND(F.lit(_LANES)) for j in range(_LONGS)]


def _fingerprint(sums: list[Column], n: Column) -> Column:
    """The majority of n words' bits, from the lanes' sums."""
    above = (F.lit(1 << 19) - F.floor(n / 2).cast("long") - 1) * F.lit(_LANES)
    out = F.lit(0).cast("long")
    for j, s in enumerate(sums):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(s + above, 19).bitwiseAND(F.lit(_LANES)), j))
    return out


def _blocks(fingerprint: Column) -> Column:
    """(number, bits) of each of RADIUS + 1 blocks as one integer; they share the bits as evenly as can be."""
    edges = [BITS * b // (RADIUS + 1) for b in range(RADIUS + 2)]
    return F.array(*(F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (z - a)) - 1)).cast("int") + (b << 6) for b, (a, z) in enumerate(zip(edges, edges[1:]))))


def _key(text: Column) -> Column:
    """128 bits that name a text."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def _items(benchmark: DataFrame) -> DataFrame:
    """item (the text's key), n (words), words and gram hashes of each different text that has a shingle."""
    made = benchmark.select(_key(F.col("text")).alias("item"), words_of(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    return cut(made.where(F.col("n") >= SHINGLE).dropDuplicates(["item"]).withColumn("grams", _shingles(F.col("words"))))


def _met(whole: DataFrame, items: DataFrame) -> DataFrame:
    """copy, n, item: which items a text can have a similar window of.

    A similar window lacks at most a ninth of an item's shingles, so of any more of them it holds one. The rarest among the items
    are taken, so a shingle that many items share makes no pairs.
    """
    placed = items.select("item", "n", F.posexplode("grams").alias("at", "gram"))
    shared = placed.select("item", "gram").distinct().groupBy("gram").agg(F.count("*").alias("items"))
    rarest = W.partitionBy("item").orderBy("items", "gram", "at")
    keys = placed.join(shared, "gram").withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= F.col("n") - SHINGLE + 2 - _need(F.col("n")))
    keys = if_small(cut(keys.select("gram", "item", "n").distinct()), KNOWN)
    grams = F.array_distinct(F.transform("hits", lambda h: F.get("grams", h["at"])))
    return whole.select("copy", F.explode(grams).alias("gram")).join(keys, "gram").select("copy", "n", "item").distinct()


def _found(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """key (of a text), item, similarity, start, n_words: of windows that are similar enough, some of each text and item; None without items."""
    low, high = items.agg(F.min("n"), F.max("n")).first()
    if low is None:
        return None
    if high > LONGEST_ITEM:
        raise ValueError(f"an item has {high} words; at most {LONGEST_ITEM} can be counted")
    # A similar window shares 8/9 of its shingles with its item, so of every fourth position of a text it holds one of them.
    step = 4 if low - SHINGLE + 1 >= 4 else 1
    known = cut(items.select("n", F.explode("grams").alias("gram")).groupBy("gram").agg(F.collect_set("n").alias("lengths")))
    known = if_small(known, KNOWN)
    keyed = docs.select(_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("words"))
    anchors = keyed.select("key", F.explode(_shingles(F.col("words"), step)).alias("gram"))
    hit = if_small(cut(anchors.join(known, "gram", "left_semi").select("key").distinct()))

    # Words of the texts that share anything, with running sums of votes, and the positions that hold a shingle of an item, with the items' lengths.
    texts = keyed.join(hit, "key", "left_semi").dropDuplicates(["key"])
    segments = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(SEGMENT))).alias("from")
    texts = texts.select("*", segments).select(F.struct("key", "from").alias("copy"), F.slice("words", F.col("from") + 1, SEGMENT + int(high) - 1).alias("words"))
    each = F.posexplode(F.arrays_zip(F.transform("words", lambda w: F.xxhash64(w)).alias("word"), F.col("grams"))).alias("at", "x")
    placed = texts.withColumn("grams", _shingles(F.col("words"))).select("copy", each).select("copy", "at", "x.word", F.col("x.grams").alias("gram"))
    placed = placed.join(known, "gram", "left").repartition("copy")  # the words travel, not their votes
    before = W.partitionBy("copy").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    summed = placed.select("copy", "at", "gram", "lengths", *(F.sum(v).over(before).alias(f"v{j}") for j, v in enumerate(_votes(F.col("word")))))
    gathered = summed.groupBy("copy").agg(
        F.array_sort(F.collect_list(F.struct("at", *(f"v{j}" for j in range(_LONGS))))).alias("p"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("gram").isNotNull(), F.struct("at", "gram")))), lambda x: x["gram"]).alias("grams"),
        F.array_sort(F.collect_list(F.when(F.col("lengths").isNotNull(), F.struct("at", "lengths")))).alias("hits"),
    )
    whole = cut(gathered)

    # Of the windows with most similarity to an item one begins at a shingle of an item of that length, or it is the text's last one.
    places, hits = F.col("p"), F.col("hits")

    def windows_of(n: Column, own: Column) -> Column:
        last, shingles = F.size(places) - n, n - SHINGLE + 1
        begins = F.filter(
            F.transform(own, lambda h, i: F.when((F.get(own, i + _need(n) - 1) - h < shingles) & (h <= last), h)),
            lambda s: s.isNotNull(),
        )
        in_last = F.size(F.filter(own, lambda h: (h >= last) & (h - last < shingles)))
        begins = F.array_union(begins, F.when((last >= 0) & (in_last >= _need(n)), F.array(last)).otherwise(F.array().cast("array<int>")))
        return F.transform(begins, lambda s: F.struct(n.alias("n"), s.alias("start"), printed_at(s, n).alias("print")))

    def printed_at(start: Column, n: Column) -> Column:
        end, front = F.get(places, start + n - 1), F.get(places, start - 1)  # before the first word there is nothing
        return _fingerprint([end[f"v{j}"] - F.coalesce(front[f"v{j}"], F.lit(0).cast("long")) for j in range(_LONGS)], n)

    def of_length(n: Column) -> Column:
        own = F.transform(F.filter(hits, lambda h: F.array_contains(h["lengths"], n)), lambda h: h["at"])
        return F.flatten(F.transform(F.array(own), lambda o: windows_of(n, o)))  # the array of one makes own once

    lengths = F.array_distinct(F.flatten(F.transform(hits, lambda h: h["lengths"])))
    printed = whole.select("copy", F.inline(F.flatten(F.transform(lengths, of_length))))

    own = items.select("item", "n", F.explode("words").alias("w")).select("item", "n", F.xxhash64("w").alias("word"))
    own = own.groupBy("item", "n").agg(*(F.sum(v).alias(f"v{j}") for j, v in enumerate(_votes(F.col("word")))))
    index = own.select("item", "n", _fingerprint([F.col(f"v{j}") for j in range(_LONGS)], F.col("n")).alias("item_print"))
    index = if_small(cut(index.select("*", F.explode(_blocks(F.col("item_print"))).alias("block"))))
    # windows meet the items that their text shares rare shingles with; of those, the ones that agree in a block
    near = cut(printed).join(_met(whole, items), ["copy", "n"]).select("*", F.explode(_blocks(F.col("print"))).alias("block")).join(index, ["item", "n", "block"])
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    candidates = cut(near.select("copy", "n", "start", "item").distinct())

    # Exact check on the counts of both multisets.
    pieces = candidates.join(whole.select("copy", "grams"), "copy")
    cutout = F.slice("grams", F.col("start") + 1, F.col("n") - SHINGLE + 1)
    ours = pieces.select("item", "copy", "n", "start", F.explode(cutout).alias("gram")).groupBy("item", "copy", "n", "start", "gram").agg(F.count("*").alias("c"))
    theirs = items.select("item", "n", F.explode("grams").alias("gram")).groupBy("item", "n", "gram").agg(F.count("*").alias("d"))
    theirs = if_small(cut(theirs), KNOWN)
    shared = ours.join(theirs, ["item", "n", "gram"]).groupBy("item", "copy", "n", "start").agg(F.sum(F.least("c", "d")).alias("both"))
    checked = shared.withColumn("similarity", F.col("both") / (2 * (F.col("n") - SHINGLE + 1) - F.col("both"))).where(F.col("similarity") >= SIMILARITY)
    checked = checked.select("item", "copy", "n", "start", "similarity")

    # Texts with fewer words than an item, as a whole: 8/9 of their shingles at least must be known. No fingerprints are needed, as they are short.
    has, lacks = F.size("grams"), F.col("n") - SHINGLE + 1 > F.col("m")
    short = whole.where((F.col("copy.from") == 0) & (F.size("p") < high) & (has > 0) & (9 * F.size("hits") >= 8 * has))
    short = short.select("copy", has.alias("m"), F.explode("grams").alias("gram")).groupBy("copy", "m", "gram").agg(F.count("*").alias("c"))
    short = short.join(theirs, "gram").where(lacks).groupBy("item", "copy", "n", "m").agg(F.sum(F.least("c", "d")).alias("both"))
    short = short.withColumn("similarity", F.col("both") / (F.col("n") - SHINGLE + 1 + F.col("m") - F.col("both"))).where(F.col("similarity") >= SIMILARITY)
    checked = checked.unionByName(short.select("item", "copy", (F.col("m") + SHINGLE - 1).alias("n"), F.lit(0).alias("start"), "similarity"))
    return checked.select(F.col("copy.key").alias("key"), "item", "similarity", (F.col("start") + F.col("copy.from")).alias("start"), F.col("n").alias("n_words"))


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words: for each document and item, the best window with similarity of 0.8 or more.

    Similarity is that of the multisets of five-word shingles: the sum of the lesser counts over the sum of the greater ones;
    of equals the first counts that begins with a shingle of an item of that length, or ends the text. A text with fewer words
    than the item is held against it as a whole. Windows are found by the distance of fingerprints, at 0.8 all but about one in
    a million. Items and texts of fewer than five words have no pairs; null is an empty text. Rows that repeat an id are read as one document's
    texts and give one row for each item, as do repeated items; rows without id are read as one document that has none, and
    items likewise. Equal texts are read once. An empty table gives no rows. Whole texts are read, by whatever number of tasks.
    """
    found = _found(docs, _items(benchmark))
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, similarity double, start int, n_words int")
    found = if_small(cut(found))
    owners = if_small(cut(benchmark.select("item_id", _key(F.col("text")).alias("item")).distinct()))
    named = docs.select("doc_id", _key(F.col("text")).alias("key")).join(found, "key").join(owners, "item")
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words"))
    return named.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.similarity", (-F.col("b.back")).alias("start"), "b.n_words")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose own text holds no item as find() tells it, whether they have an id or not."""
    found = _found(docs, _items(benchmark))
    if found is None:
        return docs
    key = unused("key", docs.columns)
    marked = docs.withColumn(key, _key(F.col("text")))
    return marked.join(if_small(cut(found.select(F.col("key").alias(key)).distinct())), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
