"""Fill-in-middle rewriting at line cuts, which counts of memoized content-defined chunks locate."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing

#: The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes that the rolling hash sees, and the mean and the largest chunk in bytes.
WINDOW, MEAN, LARGEST = 48, 1024, 1 << 15
#: Bytes of chunks that one task remembers; older ones are forgotten, which costs time only.
CACHE_BYTES = 32 << 20


@dataclass(frozen=True)
class Summary:
    """What combining needs of a chunk: its newlines, code points, a mark inside, and the two bytes at either end."""

    newlines: int
    points: int
    marked: bool
    head: bytes
    tail: bytes


def summarise(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, np.uint8)
    return Summary(chunk.count(b"\n"), int(((data & 0xC0) != 0x80).sum()), any(m.encode() in chunk for m in MARKS), chunk[:2], chunk[-2:])


class Memory:
    """Summaries by content: a chunk is looked up by its hash and taken for known only if all its bytes are equal; the
    least used go first."""

    def __init__(self, size: int = CACHE_BYTES):
        self.size, self.held, self.known, self.hits, self.misses = size, 0, OrderedDict(), 0, 0

    def of(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is not None:
            self.known.move_to_end(chunk)
            self.hits += 1
            return found
        self.misses += 1
        found = self.known[chunk] = summarise(chunk)
        self.held += len(chunk)
        while self.held > self.size and len(self.known) > 1:
            self.held -= len(self.known.popitem(last=False)[0])
        return found


def chunks(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of some bytes: one ends where the hash of the WINDOW bytes before is 0 modulo MEAN.

    A cut depends on those bytes alone, so equal passages are cut alike wherever they stand, but for their first
    chunk. Chunks above LARGEST are cut at that size.
    """
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(data), hashing.CHUNK):
        skip = min(at, WINDOW)
        piece = data[at - skip : at + hashing.CHUNK]
        prefix = hashing.sums(piece)
        stop = np.arange(max(WINDOW, skip + 1), len(piece) + 1)
        rolled = hashing.range_hash(prefix, stop - WINDOW, stop)
        found.append(stop[(rolled >> np.uint64(20)) % np.uint64(MEAN) == 0] - skip + at)
    ends, begin = [], 0
    for end in np.unique(np.append(np.concatenate(found), len(data))).tolist():
        ends += range(begin + LARGEST, end, LARGEST)
        ends += [end] * (end > begin)
        begin = end
    return np.array(ends, np.int64)


class Located:
    """A text as chunks with running counts: the number of its lines, and where its n-th line ends."""

    def __init__(self, data: np.ndarray, memory: Memory):
        self.data, raw = data, data.tobytes()
        self.ends = chunks(data).tolist()
        self.begins = [0, *self.ends[:-1]] if self.ends else []
        told = [memory.of(raw[a:e]) for a, e in zip(self.begins, self.ends, strict=True)]
        self.lines = np.cumsum([0, *(s.newlines for s in told)])
        self.points = np.cumsum([0, *(s.points for s in told)])
        self.n = int(self.lines[-1]) + bool(len(raw) and raw[-1:] != b"\n")
        self.marked = any(s.marked for s in told)
        edge = b""  # a mark may lie across the ends of chunks, short ones included
        for s, a, e in zip(told, self.begins, self.ends, strict=True):
            self.marked = self.marked or any(m.encode() in edge + s.head for m in MARKS)
            edge = (edge + raw[a:e])[-2:] if e - a < 2 else s.tail

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) of the first so many lines: only the chunk that the cut falls in is read."""
        if units <= 0:
            return 0, 0
        if units > self.lines[-1]:
            return len(self.data), int(self.points[-1])
        k = int(np.searchsorted(self.lines, units)) - 1
        chunk = self.data[self.begins[k] : self.ends[k]]
        inside = int(np.flatnonzero(chunk == 10)[units - int(self.lines[k]) - 1]) + 1
        return self.begins[k] + inside, int(self.points[k]) + int(((chunk[:inside] & 0xC0) != 0x80).sum())


def _numbers(key: Column, seed: str) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of seed:key as whole numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def rewrite(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "7", rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """Key, n, form, prefix_chars, middle_chars and output of each row: its text cut at two lines and put in another order.

    The cuts and the form are drawn from a hash of the key, so reruns agree. n counts lines; form is plain (the text
    as it is) for an empty text, one that holds a mark, and a share of 100 - rate in a hundred; else spm for spm_rate
    in a hundred, and psm. prefix_chars and middle_chars are code points, null for plain. A null text is empty; a null
    key draws from the empty key. Repeated rows give repeated results; an empty table gives none; other columns are
    not read, whatever their names. A text is one task's, whatever its length, and each byte is read a few times.
    """
    h = _numbers(F.col(key), seed)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t"), *[c.alias(f"_h{i}") for i, c in enumerate(h, 1)])
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n", "form", "prefix_chars", "middle_chars", "output"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            offsets, data = hashing.texts(batch.column("_t"))
            h1, h2, h3, h4 = (batch.column(f"_h{i}").to_pylist() for i in range(1, 5))
            start, size, out = 0, 0, []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                row = _rewritten(own, h1[i], h2[i], h3[i], h4[i], memory, rate, spm_rate)
                out.append(row)
                size += len(row[-1])
                if size > 16 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, i + 1 - start), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))], names
                    )
                    start, size, out = i + 1, 0, []

    return rows.mapInArrow(work, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _rewritten(data: np.ndarray, h1: int, h2: int, h3: int, h4: int, memory: Memory, rate: int, spm_rate: int) -> tuple:
    text = Located(data, memory)
    if not len(data) or text.marked or h3 % 100 >= rate:
        return text.n, "plain", None, None, data.tobytes()
    a, b = sorted((h1 % (text.n + 1), h2 % (text.n + 1)))
    (one, points), (two, most) = text.cut(a), text.cut(b)
    prefix, middle, suffix = (data[i:j].tobytes() for i, j in ((0, one), (one, two), (two, len(data))))
    p, s, m = (x.encode() for x in MARKS)
    spm = h4 % 100 < spm_rate
    output = b"".join([s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle])
    return text.n, "spm" if spm else "psm", points, most - points, output


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks are found from the left; texts that hold one are always plain."""

    def between(after: str, before: str | None) -> Column:
        begin = F.position(F.lit(after), output) + len(after)
        if before is None:
            return F.substring(output, begin, F.length(output))
        return F.substring(output, begin, F.position(F.lit(before), output) - begin)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
