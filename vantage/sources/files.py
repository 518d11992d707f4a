"""Files in and out: checked reads, batches, logs, feature stores and their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table_checked(spark: SparkSession, path: str, required: list[str], schema: str | None = None, format: str = "csv") -> DataFrame:
    """A table with a header; an error names the required columns that it lacks. Columns are strings without a schema."""
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    df = (reader.schema(schema) if schema else reader).load(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return df


def read_rows_json(spark: SparkSession, path: str, row: str, lines: bool = False) -> DataFrame:
    """The rows of JSON documents that hold them in an array `rows`; row is the DDL of one. A document is one task's, and a
    file, or with `lines` a line, is a document. Documents without rows give none."""
    return spark.read.schema(f"rows array<struct<{row}>>").json(path, multiLine=not lines).select(F.inline("rows"))


def read_event_log(spark: SparkSession, path: str | list[str], schema: str, keys: DataFrame, key: str = "entity") -> DataFrame:
    """Lines of JSON logs (compressed ones too) whose key is among keys. The keys decide how they are joined: Spark
    broadcasts them by their size, and beyond its bound both sides are shuffled."""
    return spark.read.schema(schema).json(path).join(keys.select(key).distinct(), key, "left_semi")


def merge_batches(spark: SparkSession, path: str, key: str, keep: str = "last", format: str = "parquet", schema: str | None = None, by: str = "file") -> DataFrame:
    """One row for each key out of a folder of batches: that of the last batch by name, or of the first one. A batch is a file,
    or, by folder, all files of a folder below path."""
    reader = spark.read.format(format).option("header", True).option("recursiveFileLookup", by == "folder")
    name = F.col("_metadata.file_name") if by == "file" else F.element_at(F.split("_metadata.file_path", "/"), -2)
    rows = (reader.schema(schema) if schema else reader).load(path).select("*", name.alias("_file"))
    rest = [c for c in rows.columns if c not in (key, "_file")]
    pick = F.max if keep == "last" else F.min
    best = rows.groupBy(key).agg(pick(F.struct("_file", *rest)).alias("r"))
    return best.select(key, *[f"r.{c}" for c in rest])


def cache_inventory(spark: SparkSession, paths: dict[str, str], format: str = "parquet") -> DataFrame:
    """(source, rows, files, flag) of folders by name; flag: empty where a folder holds no rows."""
    out = None
    for name, path in paths.items():
        one = spark.read.format(format).load(path).select(F.col("_metadata.file_path").alias("f"))
        one = one.groupBy("f").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("rows"), F.count("*").alias("files"))
        one = one.select(F.lit(name).alias("source"), "rows", "files", F.when(F.col("rows") == 0, "empty").alias("flag"))
        out = one if out is None else out.unionByName(one)
    return out


def write_feature_store(tables: dict[str, DataFrame], path: str, key: str = "entity") -> DataFrame:
    """Writes each table to its own folder and returns (table, rows, keys, digest) of what stands there.

    The digest is a sum of row hashes, so it does not depend on the order of rows or files.
    """
    out = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        back = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
        one = back.groupBy(key).agg(F.count("*").alias("k"), F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).alias("h"))
        one = one.agg(F.lit(name).alias("table"), F.coalesce(F.sum("k"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def quarantine_partition(rows: DataFrame, legacy: str, path: str) -> DataFrame:
    """Writes the rows of which the flag column holds to a side table, which it returns; the source is only read."""
    side = rows.where(F.coalesce(F.col(legacy), F.lit(False)))
    side.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(side.schema).parquet(path)


def file_manifest_check(spark: SparkSession, path: str, manifest: DataFrame, nested: bool = False) -> DataFrame:
    """(file, expected, found, problem) of files whose SHA-256 differs from the manifest's (file, sha256), or that only one
    side has. Each file is read as one value, so files must be below 2 GB. Files go by their name, or, nested, by their
    place below path, folders included."""
    name = F.substring_index("path", f"/{path.rstrip('/').rpartition('/')[2]}/", -1) if nested else F.element_at(F.split("path", "/"), -1)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", nested).load(path).select(name.alias("file"), F.sha2("content", 256).alias("found"))
    both = manifest.select("file", F.col("sha256").alias("expected")).join(found, "file", "full")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(F.col("found") != F.col("expected"), "differs")
    return both.withColumn("problem", problem).where("problem is not null")


#: Batches of a table that is replayed whole, about: a file and a part of a micro-batch each, which cost time of their own.
BATCHES = 100


def batch_size(rows: int, least: int) -> int:
    """Rows of a batch, so that a table of any size is some BATCHES of them; no fewer than `least`."""
    return max(least, -(-rows // BATCHES))


def write_batches(rows: DataFrame, path: str, size: int, order: str) -> StructType:
    """Writes rows as files of `size` rows in order, named by batch, for a later replay file by file; returns the schema.

    Ranges of the order are cut by Spark's sampled range partitioning, so batches of a range end with a smaller one.
    """
    ranged = rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(order)
    placed = ranged.withColumn("_n", F.floor((F.row_number().over(w) - 1) / size)).withColumn("batch", F.format_string("%05d-%07d", "_p", "_n"))
    placed.drop("_p", "_n").write.mode("overwrite").partitionBy("batch").parquet(path)
    return rows.schema
