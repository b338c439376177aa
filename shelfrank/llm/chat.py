"""Chat formatting by perspective rotation: every participant's view of a dialogue, with the marks of what to learn from it."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import cut, ship

#: Fixed forms of a turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
SYSTEM = "system"
UNNAMED = "unknown"

PARTS = 64


def rotate(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each turn in each participant's view: conv_id, speaker, turn, role, name, text, mask_start, mask_end, start, end.

    The participants of a conversation are its distinct roles except the system's; a null role is `unknown`. In the view of
    `speaker`, own turns have the role assistant, the system's keep theirs, all others are users with their role as name.
    text is the rendered turn; start and end are its place, in characters, in the view's whole text, which is the view's turns
    one after the other by (turn, role, content), nulls first. mask_start and mask_end bound what the speaker said and how it
    ended, the part to learn from; both are null in turns of others. Null content is empty. Repeated turns are rendered as
    often as they occur. A conversation of the system alone, and an empty table, have no views.

    A view is kept as rows and may be larger than any task: turns are dealt out by ranges of (conversation, speaker, turn),
    and the lengths of a view's earlier ranges are added in a second step.
    """
    spark = turns.sparkSession
    ship(spark)
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("said_by"), F.coalesce("text", F.lit("")).alias("content"))
    speakers = said.where(F.col("said_by") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("said_by").alias("speaker")).distinct()
    own, system = F.col("said_by") == F.col("speaker"), F.col("said_by") == SYSTEM
    role = F.when(own, "assistant").when(system, SYSTEM).otherwise("user")
    name = F.when(~own & ~system, F.col("said_by"))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit(MIDDLE))
    seen = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "speaker", "turn", "said_by", role.alias("role"), name.alias("name"), F.length(head).alias("head"), own.alias("own"), F.concat(head, F.col("content"), F.lit(CLOSE)).alias("text")
    )
    seen = seen.withColumn("size", F.length("text").cast("long"))
    keys = ["conv_id", "speaker", "turn", "said_by"]
    n = parts or max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the hash spreads turns of one number; equal rows beyond that are told apart by nothing, and by nothing in the result
    dealt = seen.withColumn("tie", F.md5("text")).repartitionByRange(n, *keys, "tie").sortWithinPartitions(*keys, "text").withColumn("part", F.spark_partition_id())
    schema = dealt.drop("tie", "size", "said_by").schema.add("start", "long").add("end", "long")

    def run(batches):
        view, total = None, 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = list(zip(t["conv_id"].to_pylist(), t["speaker"].to_pylist()))
            ends = []
            for key, size in zip(keys, t["size"].to_pylist()):
                if key != view:
                    view, total = key, 0
                total += size
                ends.append(total)
            end = pa.array(ends, pa.int64())
            out = t.drop_columns(["tie", "size", "said_by"]).append_column("start", pc.subtract(end, t["size"].combine_chunks())).append_column("end", end)
            yield from out.to_batches()

    placed = cut(dealt.mapInArrow(run, schema))
    totals = placed.groupBy("conv_id", "speaker", "part").agg(F.max("end").alias("size"))
    # only views that a range boundary cuts need the second step: at most one more view than there are boundaries
    cut_views = totals.groupBy("conv_id", "speaker").agg(F.collect_list(F.struct("part", "size")).alias("sizes")).where(F.size("sizes") > 1)
    before = cut_views.select(
        F.col("conv_id").alias("of"),
        F.col("speaker").alias("by"),
        F.explode(F.transform("sizes", lambda p: F.struct(p["part"].alias("part"), F.aggregate("sizes", F.lit(0).cast("long"), lambda s, q: s + F.when(q["part"] < p["part"], q["size"]).otherwise(0)).alias("before")))).alias("x"),
    )
    joined = placed.join(
        F.broadcast(before.select("of", "by", "x.part", "x.before").withColumnRenamed("part", "in_part")),  # at most two rows a range
        F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("speaker") == F.col("by")) & (F.col("part") == F.col("in_part")),
        "left",
    )
    start = F.col("start") + F.coalesce("before", F.lit(0))
    end = F.col("end") + F.coalesce("before", F.lit(0))
    return joined.select(
        "conv_id", "speaker", "turn", "role", "name", "text",
        F.when(F.col("own"), start + F.col("head")).alias("mask_start"), F.when(F.col("own"), end - 1).alias("mask_end"), start.alias("start"), end.alias("end"),
    )


ORACLE = """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS said_by, coalesce(text, '') AS content FROM conversations),
speakers AS (SELECT DISTINCT conv_id, said_by AS speaker FROM said WHERE said_by <> 'system'),
seen AS (SELECT s.conv_id, p.speaker, s.turn, s.said_by,
         CASE WHEN s.said_by = p.speaker THEN 'assistant' WHEN s.said_by = 'system' THEN 'system' ELSE 'user' END AS role,
         CASE WHEN s.said_by <> p.speaker AND s.said_by <> 'system' THEN s.said_by END AS name, s.content
         FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
made AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) AS head FROM seen),
full_text AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS text FROM made),
placed AS (SELECT *, SUM(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, said_by, text
                                             ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM full_text)
SELECT conv_id, speaker, turn, role, name, text,
       CASE WHEN role = 'assistant' AND said_by = speaker THEN "end" - length(text) + length(head) END AS mask_start,
       CASE WHEN role = 'assistant' AND said_by = speaker THEN "end" - 1 END AS mask_end,
       "end" - length(text) AS start, "end"
FROM placed
"""
