"""Tables with one row for each key: merges rewrite only the hash buckets they touch, and a manifest names what is valid."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import materialize, release

BUCKET = "_bucket"


@dataclass(frozen=True)
class Manifest:
    """number: of the version. batch: the last batch merged. folders: where the files of each bucket are."""

    number: int = 0
    batch: int = -1
    folders: dict[int, str] = field(default_factory=dict)


class KeyedTable:
    """merge: for each column beside the keys, the aggregate that joins an old row with new ones, as {"peak": F.max("peak")}.

    A version is a file under manifests, which names a folder for each bucket. A merge writes the touched buckets to a
    folder of its own and then, in one rename, the next manifest. Readers and a rerun after a failure, a lost driver
    included, so see the version before; a batch that has been merged is not merged again. One writer at a time.
    Choose buckets so that one is a task's work: keys are hashed to them, so no key makes one larger than others, as
    a key has one row.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], merge: dict[str, Column], buckets: int = 32):
        self.spark, self.path, self.keys, self.merge, self.buckets = spark, path.rstrip("/"), keys, merge, buckets
        self.schema = spark.createDataFrame([], schema).schema
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self) -> Manifest:
        found = self._versions()
        if not found:
            return Manifest()
        stream = self._fs.open(self._path(f"{self.path}/manifests/v{found[-1]:012d}.json"))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(told["number"], told["batch"], {int(b): f for b, f in told["folders"].items()})

    def _commit(self, manifest: Manifest) -> None:
        part, final = self._path(f"{self.path}/manifests/_{uuid.uuid4().hex}"), self._path(f"{self.path}/manifests/v{manifest.number:012d}.json")
        out = self._fs.create(part, True)
        try:
            out.write(bytearray(json.dumps({"number": manifest.number, "batch": manifest.batch, "folders": manifest.folders}).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            raise RuntimeError(f"version {manifest.number} of {self.path} was written by another writer")

    def _stored(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/rows/{f}/{BUCKET}={b}" for b, f in sorted(manifest.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows of the last version, in the columns of the schema."""
        return self._stored(self.manifest())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row for each key out of rows of the schema's columns."""
        return rows.groupBy(*self.keys).agg(*[a.alias(c) for c, a in self.merge.items()]).select(*self.schema.names)

    def upsert(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Merges rows into the table; False where that batch has been merged before."""
        before = self.manifest()
        if batch is not None and batch <= before.batch:
            return False
        new = materialize(self.merged(rows).withColumn(BUCKET, self.bucket()), "upsert")
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most one row a bucket
        folder = uuid.uuid4().hex
        if touched:
            both = self._stored(before, touched).withColumn(BUCKET, self.bucket()).unionByName(new)
            out = both.repartition(min(len(touched), self.buckets), BUCKET).groupBy(BUCKET, *self.keys).agg(*[a.alias(c) for c, a in self.merge.items()])
            out.select(*self.schema.names, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/rows/{folder}")
        self._commit(Manifest(before.number + 1, before.batch if batch is None else batch, before.folders | dict.fromkeys(touched, folder)))
        release(new)
        return True

    def drop_folders(self, path: str, last: int) -> None:
        """Deletes the folders batch=<number> under path up to the last number."""
        top = self._path(path)
        for folder in self._fs.listStatus(top) if self._fs.exists(top) else []:
            name = folder.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) <= last:
                self._fs.delete(folder.getPath(), True)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the bucket folders that none of the last `keep` versions names, and older manifests; returns how many folders.

        Readers of older versions fail after it; a merge under way must not run beside it."""
        versions = self._versions()
        for number in versions[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/v{number:012d}.json"), False)
        named = set()
        for number in versions[-keep:]:
            stream = self._fs.open(self._path(f"{self.path}/manifests/v{number:012d}.json"))
            named |= {f"{f}/{BUCKET}={b}" for b, f in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"].items()}
            stream.close()
        gone, top = 0, self._path(f"{self.path}/rows")
        for folder in self._fs.listStatus(top) if self._fs.exists(top) else []:
            held = [p for p in self._fs.listStatus(folder.getPath()) if p.isDirectory()]
            useless = [p.getPath() for p in held if f"{folder.getPath().getName()}/{p.getPath().getName()}" not in named]
            for p in useless:
                self._fs.delete(p, True)
            gone += len(useless)
            if len(useless) == len(held):
                self._fs.delete(folder.getPath(), True)
        return gone


def first_seen_table(spark: SparkSession, path: str, seen: StructType, key: str = "entity", at: str = "ts", buckets: int = 32) -> KeyedTable:
    """The earliest row of each key, ties by all other columns; rows come and go as (key, row struct)."""
    rest = [at, *(f for f in seen.names if f not in (key, at))]
    fields = ", ".join(f"`{c}`: {seen[c].dataType.simpleString()}" for c in rest)
    return KeyedTable(spark, path, f"`{key}` {seen[key].dataType.simpleString()}, row struct<{fields}>", [key], {"row": F.min("row")}, buckets)


def append_first_seen(table: KeyedTable, seen: DataFrame, batch: int | None = None) -> bool:
    """Writes sightings to a first_seen_table: a key that stands there keeps its row, but for an earlier sighting."""
    return table.upsert(_rows(table, seen), batch)


def followup_table(spark: SparkSession, path: str, log: StructType, keys: list[str], version: str, buckets: int = 32) -> KeyedTable:
    """The row of each key with the largest version, ties by all other columns; rows come and go as (keys, row struct)."""
    rest = [version, *(f for f in log.names if f not in (*keys, version))]
    fields = ", ".join(f"`{c}`: {log[c].dataType.simpleString()}" for c in rest)
    told = ", ".join(f"`{k}` {log[k].dataType.simpleString()}" for k in keys)
    return KeyedTable(spark, path, f"{told}, row struct<{fields}>", keys, {"row": F.max("row")}, buckets)


def upsert_followup(table: KeyedTable, log: DataFrame, batch: int | None = None) -> bool:
    """Writes follow-ups to a followup_table: a later version of a key replaces its row, an earlier one does not."""
    return table.upsert(_rows(table, log), batch)


def _rows(table: KeyedTable, rows: DataFrame) -> DataFrame:
    return rows.select(*table.keys, F.struct(*table.schema["row"].dataType.names).alias("row"))


def unpacked(table: KeyedTable) -> DataFrame:
    return table.read().select(*table.keys, "row.*")
