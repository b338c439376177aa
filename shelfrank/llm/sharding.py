"""Contiguous shards of nearly equal bytes, by prefix sums of sizes over the whole corpus.

Every document has a size; the sum of all sizes before it, in the order of the documents, is its start. A range of the order
holds its own running sums and is moved by the totals of the ranges before it. The line of all bytes is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import cut, placed

#: Bytes that a document takes besides its text.
OVERHEAD = 16

RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def assign(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", overhead: int = OVERHEAD, rows: bool = False) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row, and `row`, all columns of docs as a struct, if asked for.

    Documents are in the order of their key, nulls first, then of their text's checksum, size and hash. A document goes to the
    shard in whose part of all bytes its middle lies, so a shard is contiguous, slots count its documents from 0, and a
    shard's bytes differ from its equal part by one document at most. The law is `bytes`; grown_shard, for laws by key, is
    null.

    A null text is empty (size: the overhead; checksum 0). Repeated rows and ids are documents of their own; equal rows are
    interchangeable and may lie in different shards. With fewer or larger documents than the shards can share, some shards
    stay empty. An empty table gives an empty one. Other columns of docs, whatever their names, matter only with `rows`.
    """
    if shards <= 0 or overhead < 0:
        raise ValueError("there must be a shard, and the overhead must not be negative")
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    carried = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if rows else []
    sized = docs.select(F.col(f"`{key}`").alias("_key"), (F.octet_length(value) + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.encode(value, "UTF-8")).alias("text_crc32"), F.xxhash64(value).alias("_hash"), *carried)
    line = placed(sized, [F.col("_key").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc(), F.col("_hash").asc()], "size").drop("_hash")
    line = cut(line)
    total = line.agg(F.sum("size")).first()[0] or 1
    part = F.expr(f"(2 * _start + size) * {shards} div (2 * {total}L)").cast("int")
    line = line.withColumn("shard", F.least(part, F.lit(shards - 1)))
    firsts = line.groupBy("shard").agg(F.min("_no").alias("_first"))  # a row a shard
    numbered = line.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_no") - F.col("_first"))
    out = numbered.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *["row"] * rows)
    return out


def write_shards(docs: DataFrame, path: str, shards: int = 40, text: str = "text", key: str = "doc_id") -> None:
    """Writes docs as Parquet files below path, a folder `shard=n` for each shard that has documents, in the order of their `slot`.

    The files hold all columns of docs and slot; columns of docs that are called shard or slot are replaced.
    """
    dealt = assign(docs, shards, text, key, rows=True)
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    dealt.select(*own, "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
