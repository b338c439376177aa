"""Lexical index and Okapi BM25 search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfrank.functions.text import tokenize
from shelfrank.operators.ranking import PLACES, best_of_row
from shelfrank.sources.shared import cut, if_small, send_package

#: Published defaults of the Okapi formula: saturation, length weight, and the floor of negative idf values as a share of the mean.
K1, B, EPSILON = 1.5, 0.75, 0.25


#: Bags and questions of a block, how many blocks of questions are sent to all tasks at most, and contributions that are summed at once.
BAG_BLOCK, ASK_BLOCK, SENT_BLOCKS, SUMMED = 1024, 512, 64, 1 << 20


@dataclass(frozen=True)
class LexicalIndex:
    """bags(bag, doc_id, dl, copies, runs of (term, tf)), docs(doc_id, dl, bag), terms(term, df, idf).

    Documents of the same tokens, as often, are one bag: it has one row, with its first document and their number.
    """

    bags: DataFrame
    docs: DataFrame
    terms: DataFrame

    @property
    def postings(self) -> DataFrame:
        """term, bag, doc_id, tf, dl, copies: a row for each term of a bag."""
        return self.bags.select("bag", "doc_id", "dl", "copies", F.inline("runs")).select("term", "bag", "doc_id", "tf", "dl", "copies")


def check_ids(docs: DataFrame, key: str = "doc_id") -> None:
    """Raises if an id is absent, blank or repeated."""
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    bad = docs.groupBy(key).agg(F.count("*").alias("n")).where(blank | (F.col("n") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"{key} must be present and unique: {bad[0][key]!r}")


def _bag(tokens: Column) -> Column:
    """What sorted tokens, which have no blanks, have in common only with equal ones."""
    return F.unhex(F.sha2(F.array_join(tokens, " "), 256))


def _run_starts(tokens: Column) -> Column:
    """Where the runs of equal ones start among sorted tokens."""
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1)))


def _with_idf(df: DataFrame, n: int) -> DataFrame:
    """term, df, idf of terms (term, df) among n documents."""
    raw = F.ln((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = df.agg(F.avg(raw)).first()[0]  # one number
    return df.select("term", "df", F.when(raw < 0, F.lit(EPSILON) * F.lit(mean)).otherwise(raw).alias("idf"))


def lexical_terms(docs: DataFrame) -> DataFrame:
    """The terms of an index of docs alone: texts are read once and only counts are shuffled."""
    check_ids(docs)
    each = docs.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
    return _with_idf(cut(each.groupBy("term").agg(F.count("*").alias("df"))), docs.count())


def build_lexical_index(docs: DataFrame) -> LexicalIndex:
    """An index of docs (doc_id, text), whose ids must be present and unique. Texts are cut into tokens once; the tables are written below the shared folder.

    Which document is a bag's first is told from narrow rows; the terms of documents are shuffled once, by document.
    """
    check_ids(docs)
    tokens = docs.select("doc_id", F.sort_array(tokenize(F.col("text"))).alias("tokens"))
    starts = tokens.withColumn("dl", F.size("tokens")).withColumn("starts", _run_starts(F.col("tokens")))
    runs = F.transform("starts", lambda s, i: F.struct(F.get("tokens", s).alias("term"), (F.coalesce(F.get("starts", i + 1), F.col("dl")) - s).cast("long").alias("tf")))
    each = cut(starts.select("doc_id", "dl", _bag(F.col("tokens")).alias("bag"), runs.alias("runs")))
    firsts = each.where("dl > 0").groupBy("bag").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")
    bags = cut(each.join(firsts.hint("shuffle_hash"), "doc_id").select("bag", "doc_id", "dl", "copies", "runs"))
    df = cut(bags.select("copies", F.explode("runs.term").alias("term")).groupBy("term").agg(F.sum("copies").alias("df")))
    return LexicalIndex(bags, each.select("doc_id", "dl", "bag"), _with_idf(df, each.count()))


def _one_list(values: pa.Array) -> pa.ListArray:
    """An array as the only list of a column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _bag_blocks(bags: DataFrame) -> DataFrame:
    """Bags in blocks of at most BAG_BLOCK: a row has lists of their bags, documents, lengths and numbers of terms, and of the terms and their tf."""
    kind, size = bags.schema["doc_id"].dataType.simpleString(), BAG_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                part = batch.slice(first, size)
                runs = part.column("runs")
                each, counts = runs.flatten(), runs.value_lengths()
                columns = [*(part.column(c) for c in ("bag", "doc_id", "dl")), counts, *each.flatten()]
                yield pa.RecordBatch.from_arrays([_one_list(c) for c in columns], ["bags", "ids", "lengths", "counts", "terms", "tfs"])

    rows = bags.select("bag", "doc_id", F.col("dl").cast("double").alias("dl"), "runs")
    return rows.mapInArrow(run, f"bags array<binary>, ids array<{kind}>, lengths array<double>, counts array<int>, terms array<string>, tfs array<long>")


def _ask_blocks(asked: DataFrame) -> DataFrame:
    """Questions (ask, term, weight) in blocks of at most ASK_BLOCK: lists of questions and distinct terms, and of (term's place, question's place, weight), by term."""
    whole = cut(asked.groupBy("ask").agg(F.collect_list(F.struct("term", "weight")).alias("parts")))
    size = ASK_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                block = batch.slice(first, size)
                parts = block.column("parts")
                terms, weights = parts.flatten().flatten()
                coded = terms.dictionary_encode()
                term, place = coded.indices.to_numpy(), np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy())
                order = np.argsort(term, kind="stable")
                columns = [block.column("ask"), coded.dictionary, pa.array(term[order]), pa.array(place[order].astype(np.int32)), weights.take(pa.array(order))]
                yield pa.RecordBatch.from_arrays([_one_list(c) for c in columns], ["asks", "words", "word", "place", "weight"])

    spread = whole.repartition(max(1, -(-whole.count() // size)))
    return spread.mapInArrow(run, "asks array<binary>, words array<string>, word array<int>, place array<int>, weight array<double>")


def _block_scores(row: pa.RecordBatch, average: float) -> np.ndarray:
    """Scores of the bags of one row, a line each, by its questions; -inf where they share no term. Contributions are summed some bags at a time."""
    bags, asks = len(row.column("bags")[0]), len(row.column("asks")[0])
    lengths, counts, tfs, word, place, weight = (row.column(c).flatten().to_numpy() for c in ("lengths", "counts", "tfs", "word", "place", "weight"))
    at = pc.index_in(row.column("terms").flatten(), value_set=row.column("words").flatten())
    known = at.is_valid().to_numpy(zero_copy_only=False)
    at, bag, tf = at.drop_null().to_numpy(), np.repeat(np.arange(bags), counts)[known], tfs[known].astype(np.float64)
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[bag] / average))
    starts = np.searchsorted(word, np.arange(len(row.column("words").flatten()) + 1))
    times = np.diff(starts)[at]
    ends = np.concatenate([[0], np.cumsum(np.bincount(bag, times, bags))]).astype(np.int64)  # of contributions, by bag
    rows = np.searchsorted(bag, np.arange(bags + 1))  # of terms, by bag
    scores = np.full((bags, asks), -np.inf)
    low = 0
    while low < bags:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + SUMMED, "right")) - 1)
        of = slice(rows[low], rows[high])
        n = times[of]
        entry = np.repeat(starts[at[of]] - np.concatenate([[0], np.cumsum(n)[:-1]])[: len(n)], n) + np.arange(n.sum())
        cell = np.repeat((bag[of] - low) * asks, n) + place[entry]
        sums = np.bincount(cell, weight[entry] * np.repeat(part[of], n), (high - low) * asks)
        shared = np.bincount(cell, minlength=(high - low) * asks) > 0
        scores[low:high] = np.where(shared, sums, -np.inf).reshape(-1, asks)
        low = high
    return scores


def bm25_search(index: LexicalIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank of queries (query_id, query): the k best documents that share a token; repeated tokens count.

    Queries of the same tokens are one question, which is scored against bags. Both lie in blocks; a task sums the scores of two blocks
    in memory, and passes on the k best bags of each question. A document among a question's k best is in one of its k
    best bags (those of equal score by their first document), and there among the k first: these are looked up at the end.
    """
    if k <= 0:
        raise ValueError("k must be greater than zero")
    send_package(queries.sparkSession)
    tokens = queries.select("query_id", F.array_sort(tokenize(F.col("query"))).alias("tokens"))
    each = cut(tokens.where(F.size("tokens") > 0).select("query_id", _bag(F.col("tokens")).alias("ask"), "tokens"))
    wanted = each.groupBy("ask").agg(F.first("tokens").alias("tokens")).select("ask", F.explode("tokens").alias("term")).groupBy("ask", "term").agg(F.count("*").alias("times"))
    asked = index.terms.join(wanted, "term").select("ask", "term", (F.col("times") * F.col("idf")).alias("weight"))
    average = index.docs.agg(F.avg("dl")).first()[0]  # one number
    kind = index.bags.schema["doc_id"].dataType.simpleString()
    met = _bag_blocks(index.bags).join(if_small(cut(_ask_blocks(asked)), SENT_BLOCKS), how="cross")  # of blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                bags, ids, asks = (row.column(c).flatten() for c in ("bags", "ids", "asks"))
                scores = _block_scores(row, average)
                names = ids.to_numpy(zero_copy_only=False)
                best = [best_of_row(scores[:, j], names, k) if found else [] for j, found in enumerate((scores > -np.inf).any(axis=0))]
                at = np.concatenate([np.asarray(b, np.int64) for b in best])
                ask = np.repeat(np.arange(len(best)), [len(b) for b in best])
                columns = [bags.take(pa.array(at)), ids.take(pa.array(at)), asks.take(pa.array(ask)), pa.array(scores[at, ask])]
                yield pa.RecordBatch.from_arrays(columns, ["bag", "doc_id", "ask", "score"])

    scores = met.mapInArrow(run, f"bag binary, doc_id {kind}, ask binary, score double")
    best = cut(top_k(scores, ["ask"], "doc_id", k).select("ask", "bag", "score"))
    named = index.docs.join(if_small(cut(best.select("bag").distinct())), "bag")
    first = named.withColumn("_place", F.row_number().over(W.partitionBy("bag").orderBy("doc_id"))).where(F.col("_place") <= k).select("bag", "doc_id")
    found = if_small(cut(top_k(best.join(first, "bag").select("ask", "doc_id", "score"), ["ask"], "doc_id", k)))
    return each.select("query_id", "ask").join(found, "ask").select("query_id", "doc_id", "score", "rank")


def top_k(scores: DataFrame, keys: list[str], item: str, k: int, score: Column | None = None) -> DataFrame:
    """The k best rows of each key with their rank; ties by the item's id."""
    best = F.round(F.col("score") if score is None else score, PLACES)
    w = W.partitionBy(*keys).orderBy(F.desc(best), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def write_lexical_index(index: LexicalIndex, path: str) -> None:
    """The index as Parquet tables, with the version of its layout."""
    index.bags.write.mode("overwrite").parquet(f"{path}/bags")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.docs.sparkSession.createDataFrame([(3,)], "version int").write.mode("overwrite").parquet(f"{path}/meta")


def read_lexical_index(spark, path: str) -> LexicalIndex:
    version = spark.read.parquet(f"{path}/meta").first().version
    if version != 3:
        raise ValueError(f"unknown index version {version}")
    return LexicalIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("bags", "docs", "terms")))
