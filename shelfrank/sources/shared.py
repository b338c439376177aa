"""Tables that driver and executors share: intermediate results, cuts of lineage, broadcasts of a counted size."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 200_000

#: Marks names of tables among the folders that are recorded.
TABLE = "table:"

_written: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, one machine gets a folder of its own, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shelfrank-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    for paths in _written:
        paths.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark reaches, or a name that `bucketed` gave."""
    if path.startswith(TABLE):
        spark.sql(f"DROP TABLE IF EXISTS {path.removeprefix(TABLE)}")
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The list of folders that are named within, which grows meanwhile."""
    own: list[str] = []
    _written.append(own)
    try:
        yield own
    finally:
        _written[:] = [paths for paths in _written if paths is not own]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the intermediate tables that were written within. What is read later must be written elsewhere by then."""
    with recorded() as own:
        try:
            yield
        finally:
            for path in own:
                delete(spark, path)


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of df from a table written to the shared folder, so that a lost executor costs no more than its running tasks."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], ordered: bool = True) -> DataFrame:
    """The rows of df from a table in buckets of its keys, in their order if asked: joins and sums by these keys leave it where it is."""
    spark = df.sparkSession
    path, n = shared_dir(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"shelfrank_{uuid.uuid4().hex}"
    for paths in _written:
        paths.append(f"{TABLE}{name}")
    dealt = df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys)
    (dealt.sortBy(*keys) if ordered else dealt).option("path", path).saveAsTable(name)
    return spark.table(name)


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with ordinal, from 0 in an order without ties: numbered within ranges of it, to which the sizes of earlier ranges are added."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = ranged.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1).join(F.broadcast(before), "_part")
    return placed.withColumn("ordinal", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is, for a shuffled join. df is counted, so cut() it before."""
    return F.broadcast(df) if df.count() <= rows else df


def send_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_shelfrank_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-shelfrank-"), "shelfrank_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    context._shelfrank_sent = True
