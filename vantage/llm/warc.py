"""WARC archives: writing, normalising monolithic gzip to one member per record with an offset index, reading."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

_CHUNK = pa.schema([("archive", pa.string()), ("seq", pa.int32()), ("chunk", pa.binary())])
_ENTRY = pa.struct([("record", pa.int64()), ("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_FILE = pa.schema([("archive", pa.string()), ("seq", pa.int32()), ("start", pa.int64()), ("piece", pa.binary()), ("index", pa.list_(_ENTRY))])
#: Bytes of a new file that a row holds, but for the end of its last member.
PIECE = 4 << 20
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, with the length of the full payload, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[4:4] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_record_types(pages: DataFrame, key: str, url: str, html: str, least: int) -> DataFrame:
    """Adds payload, digest, kind and refers_to: of equal payloads of `least` bytes or more the largest key responds."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select(F.col("digest").alias("_d"), "first")
    rows = rows.join(again, F.col("digest") == F.col("_d"), "left").drop("_d")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return rows.withColumn("kind", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def _write(archive_bytes: int, chunk_bytes: int):
    """Records -> chunks of archives, each one gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, seq, raw, held, size, stream = TaskContext.get().partitionId(), 0, 0, 0, [], 0, None
        name = lambda: f"archive-{part:06d}-{k:04d}.warc.gz"

        def out(last: bool) -> pa.RecordBatch:
            data = b"".join(held) + (stream.flush() if last else b"")
            return pa.RecordBatch.from_arrays([pa.array([name()]), pa.array([seq], pa.int32()), pa.array([data], pa.binary())], schema=_CHUNK)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "kind", "refers_to")]
            for i in range(batch.num_rows):
                stream = stream or zlib.compressobj(6, zlib.DEFLATED, 31)
                data = record_bytes(*(c[i].as_py() for c in columns))
                held.append(stream.compress(data))
                raw, size = raw + len(data), size + len(held[-1])
                if raw >= archive_bytes:
                    yield out(True)
                    k, seq, raw, held, size, stream = k + 1, 0, 0, [], 0, None
                elif size >= chunk_bytes:
                    yield out(False)
                    seq, held, size = seq + 1, [], 0
        if stream:
            yield out(True)

    return run


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, archive_bytes: int = 32 << 20, chunk_bytes: int = 1 << 20) -> DataFrame:
    """(archive, seq, chunk): each archive is one gzip stream over all its records, in chunks."""
    rows = with_record_types(pages, key, url, html, least)
    return rows.mapInArrow(_write(archive_bytes, chunk_bytes), "archive string, seq int, chunk binary")


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The WARC records of a gzip file that is inflated once, as a stream; several members are read on.

    A file that ends within a gzip member or within a record is an error, and so are bytes that belong to neither.
    """
    held, stream, need, inside = bytearray(), zlib.decompressobj(31), 0, False
    for chunk in chunks:
        while chunk:
            held += stream.decompress(chunk)
            chunk, inside = stream.unused_data, not stream.eof
            if stream.eof:
                stream = zlib.decompressobj(31)
        while True:
            if not need:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                length = next((int(x[15:]) for x in bytes(held[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                need = at + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if inside:
        raise ValueError("the archive ends within a gzip member")
    if held:
        raise ValueError(f"the archive ends with {len(held)} bytes that are no whole record")


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (archive, seq) -> the new file of each archive in pieces of whole members, with the index of each piece."""

    def rows() -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            for archive, chunk in zip(batch.column("archive").to_pylist(), batch.column("chunk"), strict=True):
                yield archive, chunk.as_py()

    def piece(archive: str, seq: int, start: int, held: list[bytes], index: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((archive, seq, start, b"".join(held), index), _FILE, strict=True)], schema=_FILE)

    for archive, group in itertools.groupby(rows(), key=lambda r: r[0]):
        held, index = [], []
        offset = start = seq = 0
        for number, record in enumerate(records_of(chunk for _, chunk in group)):
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = pack.compress(record) + pack.flush()
            name = record[: record.find(b"\r\n\r\n")].partition(b"WARC-Record-ID: <")[2].partition(b">")[0].decode()
            held.append(member)
            index.append({"record": number, "record_id": name, "offset": offset, "length": len(member)})
            offset += len(member)
            if offset - start >= PIECE:
                yield piece(archive, seq, start, held, index)
                held, index, start, seq = [], [], offset, seq + 1
        if held:
            yield piece(archive, seq, start, held, index)


def normalised_files(archives: DataFrame) -> DataFrame:
    """(archive, seq, start, piece, index): the pieces of an archive, in order of seq, are its new file, one gzip member a
    record; start is a piece's place in the file, and index the sidecar entries of its records, with offsets in the file.
    Each archive is inflated once, as a stream, in one task; a damaged one is an error."""
    ddl = "archive string, seq int, start long, piece binary, index array<struct<record:bigint,record_id:string,offset:bigint,length:bigint>>"
    return archives.repartition("archive").sortWithinPartitions("archive", "seq").mapInArrow(_normalise, ddl)


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, record, record_id, offset, length, member): members in order of record make the new file;
    the other columns are its sidecar index."""
    rows = normalised_files(archives).select("archive", "start", "piece", F.inline("index"))
    member = F.substring("piece", (F.col("offset") - F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    return rows.select("archive", "record", "record_id", "offset", "length", member.alias("member"))


def offset_index(files: DataFrame) -> DataFrame:
    """The sidecar index of normalised files, or of members."""
    if "index" in files.columns:
        return files.select("archive", F.inline("index"))
    return files.select("archive", "record", "record_id", "offset", "length")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members out of the pieces of files: each is read at the place that the index tells, and nowhere else."""
    number = lambda s: int(s.rpartition(":")[2].rstrip(">")) if s and s.rpartition(":")[2].rstrip(">") else None

    def placed(batch: pa.RecordBatch) -> Iterator[bytes]:
        for start, piece, index in zip(batch.column("start").to_pylist(), batch.column("piece"), batch.column("index").to_pylist(), strict=True):
            data = piece.as_buffer()
            for entry in index:
                yield data.slice(entry["offset"] - start, entry["length"]).to_pybytes()

    for batch in batches:
        out = []
        for member in placed(batch):
            head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            http, _, payload = rest[:-4].partition(b"\r\n\r\n")
            size = int(http.rpartition(b"Content-Length: ")[2])
            digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
            intact = kind == "revisit" or (len(payload) == size and hashlib.sha1(payload).hexdigest() == digest)
            out.append((number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To", "")), intact))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)


def read_members(files: DataFrame) -> DataFrame:
    """One row per record of normalised files, read by their index: page_id, payload_bytes, payload_digest, record_type,
    refers_to, intact (digest verified). An index that points beside a member is an error."""
    return files.select("start", "piece", "index").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """Writes a record per row, normalises the archives and reads them back: one row per input row.

    Null html is an empty payload; empty and short payloads are always responses; rows that repeat the largest
    key of a payload are all responses; a null key never responds to others. An empty table gives no rows. A payload is
    one record, however long, and held whole by one task. Other columns are not read, whatever their names.
    """
    archives = materialize(write_archives(pages, key, url, html, least), "archives")
    files = materialize(normalised_files(archives), "files")
    release(archives)
    return read_members(files).withColumnRenamed("page_id", key)
