"""Suffix-array dedup with run-compressed Burrows-Wheeler indexes.

Every string of `length` bytes has one anchor: the leftmost smallest hash among its `gram`-byte substrings.
Equal strings have equal anchors at equal distances, so all starts that share an anchor form one slice, and
slices meet in cells by the bytes around the anchor that all their starts cover. Cells that hold more than
one occurrence go to index shards: a shard's slices are suffix-sorted, the Burrows-Wheeler transform is cut
into runs, suffix positions are sampled at run ends with the common prefix they have with their neighbour,
and matching statistics stream from sample to sample along the text. Starts whose match is `length` bytes
or more are marked. Work and memory of a task are bounded by the shard size, not by the size of a cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .hashing import CHUNK, mix, range_hash, sums, texts

_LOW = np.uint64((1 << 24) - 1)


def anchored(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(cell, slice, lo, hi) of one text: starts lo..hi belong to a slice with these hashes."""
    found = []
    half = (length - gram) // 2
    for at in range(0, max(1, len(data) - length + 1), CHUNK):
        part = data[at : at + CHUNK + length - 1]
        n = len(part)
        if n < length:
            continue
        prefix = sums(part)
        j = np.arange(n - gram + 1)
        keys = (range_hash(prefix, j, j + gram) & ~_LOW) | j.astype(np.uint64)
        w = length - gram + 1
        m = len(keys)
        rows = np.full(-(-m // w) * w, ~np.uint64(0))
        rows[:m] = keys
        rows = rows.reshape(-1, w)
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        fore = np.minimum.accumulate(rows, axis=1).ravel()
        least = np.minimum(back[: m - w + 1], fore[w - 1 : m])
        p = (least & _LOW).astype(np.int64)
        cut = np.flatnonzero(p[1:] != p[:-1]) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(p) - 1]))
        p = p[lo]
        for right in (False, True):
            a, b = (np.maximum(lo, p - half + 1), hi) if right else (lo, np.minimum(hi, p - half))
            ok = a <= b
            a, b, q = a[ok], b[ok], p[ok]
            start = q if right else q - half
            cell = range_hash(prefix, start, start + gram + half) ^ np.uint64(right)
            body = mix(range_hash(prefix, a, b + length) + (q - a).astype(np.uint64))
            found.append((cell, body, a + at, b + at))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_OCC = pa.schema([("cell", pa.int64()), ("body", pa.int64()), ("occ", pa.list_(pa.int64()))])


def _occurrences(length: int, gram: int):
    """Per partition: one row per (cell, slice) with all its occurrences [row, lo << 32 | hi, ...]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            ids = np.asarray(batch.column("rid"))
            offsets, data = texts(batch.column("bytes"))
            for i in np.flatnonzero(np.diff(offsets) >= length):
                cell, body, lo, hi = anchored(data[offsets[i] : offsets[i + 1]], length, gram)
                kept.append((cell, body, np.full(len(cell), ids[i]), lo << 32 | hi))
        if not kept:
            return
        cell, body, rid, span = (np.concatenate(x) for x in zip(*kept, strict=True))
        kept.clear()
        order = np.lexsort((body, cell))
        cell, body = cell[order].view(np.int64), body[order].view(np.int64)
        occ = np.empty((len(order), 2), np.int64)
        occ[:, 0], occ[:, 1] = rid[order], span[order]
        first = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (body[1:] != body[:-1]))))
        ends = np.concatenate((first, [len(order)]))
        for a in range(0, len(first), 20_000):
            b = min(a + 20_000, len(first))
            lists = pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]) * 2, pa.int32()), pa.array(occ[ends[a] : ends[b]].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cell[first[a:b]]), pa.array(body[first[a:b]]), lists], schema=_OCC)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by cell, those whose cell has more than one occurrence. Holds back one row at most."""
    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.asarray(batch.column("cell"))
        many = np.asarray(batch.column("occ").value_lengths()) > 2
        same = cell[1:] == cell[:-1]
        keep = many.copy()
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None and cell[0] == last:
            keep[0] = True
            if held is not None:
                yield held
        last, held = cell[-1], None if keep[-1] else batch.slice(batch.num_rows - 1)
        if keep.any():
            yield batch.filter(pa.array(keep))


def matching_starts(slices: list[bytes], length: int) -> list[np.ndarray]:
    """For each slice, the starts whose `length` bytes occur at another place in these slices.

    This is the index: suffix order, runs of the Burrows-Wheeler transform, suffixes sampled at run ends.
    """
    sizes = np.array([len(s) + 1 for s in slices])
    total = int(sizes.sum())
    ends = np.cumsum(sizes) - 1  # the terminators, each smaller than all bytes and ordered among themselves
    begins = ends - sizes + 1
    sid = np.repeat(np.arange(len(slices)), sizes)
    end = ends[sid]
    symbols = np.frombuffer(b"\0".join(slices) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[ends] = 0
    padded = np.concatenate((symbols, np.zeros(8, np.int64)))
    pos = np.arange(total)
    key = np.zeros(total, np.int64)
    for o in range(7):
        key = key << 9 | np.where(pos + o <= end, padded[o : o + total], 0)
    order = np.argsort(key)

    def ranks(order: np.ndarray, value: np.ndarray) -> np.ndarray:
        v = value[order]
        out = np.empty(total, np.int64)
        out[order] = np.cumsum(np.concatenate(([False], v[1:] != v[:-1])))
        return out

    rank, h = ranks(order, key), 7
    while h < 2 * sizes.max() and rank[order[-1]] < total - 1:
        beyond = pos + h
        pair = rank * (total + 1) + np.where(beyond <= end, rank[np.minimum(beyond, total - 1)], sid)
        order = np.argsort(pair)
        rank, h = ranks(order, pair), h * 2
    before = symbols[order - 1]
    starts = order == begins[sid[order]]
    before = np.where(starts, 300 + sid[order], before)
    edge = np.flatnonzero(before[1:] != before[:-1]) + 1  # run heads; the rows before them are run tails
    head, tail = order[edge], order[edge - 1]
    most = np.minimum(end[head] - head, end[tail] - tail)
    common = np.zeros(len(edge), np.int64)
    live = np.flatnonzero(most >= length)  # shorter ones cannot reach the length
    while len(live):
        go = key[head[live] + common[live]] == key[tail[live] + common[live]]
        live = live[go]
        common[live] += 7
        live = live[common[live] < most[live]]
    long = np.flatnonzero(most >= length)
    a, b = head[long] + common[long], tail[long] + common[long]
    a, b = np.minimum(a, total - 1), np.minimum(b, total - 1)
    same = np.zeros(len(long), np.int64)
    for o in range(6):
        step = padded[a + o] == padded[b + o]
        same += step & (same == o)
    common[long] = np.minimum(common[long] + same, most[long])
    best = np.zeros(total, np.int64)
    for sample in (head, tail):
        reach = np.full(total, -1, np.int64)
        reach[begins] = begins
        np.maximum.at(reach, sample, sample + common)
        best = np.maximum(best, np.maximum.accumulate(reach) - pos)  # the match shortens by one from byte to byte
    hit = best >= length
    return [np.flatnonzero(hit[b : max(b, e - length + 1)]) for b, e in zip(begins, ends, strict=True)]


_MARKS = pa.schema([("cell", pa.int64()), ("body", pa.int64()), ("marks", pa.list_(pa.int64()))])


def _index(length: int, shard_bytes: int):
    """Rows sorted by (cell, part): whole parts are gathered to shards of about shard_bytes and indexed."""

    def ranges(starts: np.ndarray) -> list[int]:
        if not len(starts):
            return []
        cut = np.flatnonzero(np.diff(starts) > 1)
        return (np.concatenate((starts[:1], starts[cut + 1])) << 32 | np.concatenate((starts[cut], starts[-1:]))).tolist()

    def shard(group: dict) -> pa.RecordBatch:
        keys = list(group)
        marked = matching_starts([group[k][0] for k in keys], length)
        for i, k in enumerate(keys):
            if group[k][1] > 1:
                marked[i] = np.arange(len(group[k][0]) - length + 1)
        rows = [(k[0], k[1], ranges(m)) for k, m in zip(keys, marked, strict=True) if len(m)]
        cells, bodies, marks = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(bodies, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], schema=_MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict = {}
        size, last = 0, None
        for batch in batches:
            for cell, part, body, n, data in zip(*(batch.column(c).to_pylist() for c in ("cell", "part", "body", "n", "slice")), strict=True):
                if (cell, part) != last and size >= shard_bytes:
                    yield shard(group)
                    group, size = {}, 0
                last = (cell, part)
                if (cell, body) not in group:
                    group[cell, body] = (data, n)
                    size += len(data)
        if group:
            yield shard(group)

    return run


_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _removed(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts(batch.column("bytes"))
            rows = []
            for i, (key, spans) in enumerate(zip(batch.column("id").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                gone = n = 0
                kept = text.tobytes()
                if spans:
                    s = np.unique(np.array(spans, np.int64))
                    a, b = s >> 32, (s & 0xFFFFFFFF) + length
                    b = np.maximum.accumulate(b)
                    new = np.concatenate(([True], a[1:] > b[:-1]))
                    a, b = a[new], b[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(b) - 1]))]
                    gone, n = int((b - a).sum()), len(a)
                    kept = b"".join(text[x:y].tobytes() for x, y in zip(np.concatenate(([0], b)), np.concatenate((a, [len(text)])), strict=True))
                rows.append((key, len(text), gone, n, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 6, _OUT, strict=True)], schema=_OUT)

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, gram: int = 64, part_slices: int = 4096, shard_bytes: int = 2 << 20, with_text: bool = False) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, with_text).

    Removes every byte that lies in a string of `length` bytes which starts at two or more places of the
    input, the same text included; strings are judged on the input. Null text counts as empty; texts under
    `length` bytes never lose anything; rows that repeat are copies of each other. Cells with more than
    part_slices slices are split into blocks, and each pair of blocks is indexed in a shard of its own.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).select("id", F.xxhash64("id", "t", F.length("t")).alias("rid"), F.col("t").cast("binary").alias("bytes"))
    long = rows.where(F.octet_length("bytes") >= length).select("rid", "bytes")
    ddl = "cell long, body long, occ array<long>"
    seen = long.mapInArrow(_occurrences(length, gram), ddl).repartition("cell").sortWithinPartitions("cell").mapInArrow(_repeated, ddl)
    seen = materialize(seen, "occurrences")
    cells = seen.groupBy("cell").agg((F.min("body") != F.max("body")).alias("several"), F.count("*").alias("width"))
    several = seen.join(cells.where("several"), "cell")
    chosen = several.groupBy("cell", "body").agg(F.min("occ").alias("one"), F.sum(F.size("occ") / 2).cast("long").alias("n"), F.max("width").alias("width"))
    chosen = chosen.select("cell", "body", "n", "width", F.get("one", F.lit(0)).alias("rid"), F.get("one", F.lit(1)).alias("span"))
    chosen = chosen.withColumn("lo", F.shiftright("span", 32).cast("int")).withColumn("hi", F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    slices = chosen.join(long, "rid").withColumn("slice", F.expr(f"substring(bytes, lo + 1, hi - lo + {length})"))
    blocks = F.ceil(F.col("width") / part_slices).cast("long")
    own = F.pmod(F.xxhash64("body"), blocks)
    part = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.least(own, b) * blocks + F.greatest(own, b)))
    slices = slices.select("cell", part.alias("part"), "body", "n", "slice")
    marks = slices.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_index(length, shard_bytes), "cell long, body long, marks array<long>")
    marks = materialize(marks, "marks")

    each = F.expr("explode(transform(sequence(0, cast(size(occ) / 2 as int) - 1), i -> named_struct('rid', occ[2 * i], 'span', occ[2 * i + 1])))")
    whole = seen.join(cells.where("not several"), "cell", "left_semi").select(each.alias("x")).select("x.rid", "x.span")
    found = several.select("cell", "body", "occ").join(marks, ["cell", "body"]).select("marks", each.alias("x"))
    shifted = F.explode(F.transform("marks", lambda m: m + F.shiftleft(F.shiftright(F.col("x.span"), 32), 32) + F.shiftright(F.col("x.span"), 32)))
    spans = whole.unionByName(found.select("x.rid", shifted.alias("span"))).groupBy("rid").agg(F.collect_set("span").alias("spans"))
    out = rows.join(spans, "rid", "left").select(F.col("id").cast("long").alias("id"), "bytes", "spans")
    out = out.mapInArrow(_removed(length, with_text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", key) if with_text else out.drop("kept").withColumnRenamed("id", key)
