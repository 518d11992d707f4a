"""Helpers shared by the training-data operators: tables, shared storage, words, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bits of the maps that filter rows before a shuffle.
BITS = 1 << 24
#: With it, Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of this machine; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here leave no shuffle files when they end."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, lost executors lose nothing, and the
    shuffles that made it are deleted at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def release(table: DataFrame) -> None:
    """Delete a table of materialize(), or a union of such tables, that nothing will read again."""
    spark = table.sparkSession
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _with_bits(rows: DataFrame, key: str, keys: DataFrame, how: str) -> DataFrame:
    word = lambda c: F.expr(f"({c} >> 6) & {BITS // 64 - 1}L")
    bits = keys.select(word(key).alias("_word"), F.expr(f"shiftleft(1L, int({key} & 63L))").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))  # BITS / 64 rows at most
    return rows.withColumn("_at", word(key)).join(F.broadcast(bits), F.col("_at") == F.col("_word"), how)


def _set(key: str) -> str:
    return f"(shiftrightunsigned(_bits, int({key} & 63L)) & 1L) = 1L"


def met(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key (long) is among keys, and some others: a bit map of BITS is broadcast, however many keys there are,
    so most of the other rows need no shuffle."""
    return _with_bits(rows, key, keys, "inner").where(F.expr(_set(key))).drop("_at", "_word", "_bits")


def split_met(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of met(), and all others, none of which has its key (long, not null) among keys."""
    others = _with_bits(rows, key, keys, "left").where(F.expr(f"not coalesce({_set(key)}, false)"))
    return met(rows, key, keys), others.drop("_at", "_word", "_bits")


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none. Splitting at one plain character needs no regex engine."""
    flat = F.coalesce(text, F.lit(""))
    for c in "\t\n\v\f\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def n_words_of(text: Column) -> Column:
    """Number of words, without building the array of them."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) undirected links -> (node, component): the smallest node id that links reach.

    Large-star and small-star rounds: each node hands its smallest neighbour to the others, so a round is two
    group-bys with partial aggregation and two joins, and no group is ever collected. A round is written to
    the shared folder, and the one before it deleted; rounds end when each node has one link to a smaller one,
    which has none itself. They always come to that, as every change lowers an end of a link. Nodes without links
    do not appear. Components found before may be given as edges: they cost fewer rounds than the links they came from.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def settled(links: DataFrame) -> bool:
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        with swept(links.sparkSession):
            return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("downs")).where("ups + downs > 1").isEmpty()

    links = None
    while links is None or not settled(links):
        before, links = links, materialize(star(star(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b") if links is None else links, True), False), "links")
        if before is not None:
            release(before)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
