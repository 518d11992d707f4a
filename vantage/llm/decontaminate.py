"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize
from .hashing import mix, range_hash, sums, texts
from .jaccard_join import _LOWER, _SPACE, _STEPS

#: Words that are units when they follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs hour hours day days week weeks month months year years % percent $ usd eur dollars euros c f k hz khz mhz ghz b kb mb gb tb w kw mw v a".split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (11, 13, 17))
#: Bits of the map of window hashes that filters texts early: 8 MB, whatever the size of the benchmark.
MAP_BITS = 1 << 26


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_DIGIT, _UPPER, _NUMERIC, _PUNCT = _mask("0123456789"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789.,:/-+%$()"), _mask(".,;:!?\"'()[]")

#: First byte and range of the second of UTF-8 capitals: Latin-1, Greek, Cyrillic.
_CAPITALS = ((0xC3, 0x80, 0x9E), (0xCE, 0x86, 0xAB), (0xD0, 0x80, 0xAF))


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([range_hash(sums(d := np.frombuffer(w.encode(), np.uint8)), np.array([0]), np.array([len(d)]))[0] for w in words], np.uint64)


_UNIT_HASHES = np.sort(_hashes(UNITS))


def template(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, is_slot, start, end) of the words of a text, with typed placeholders for numbers, names and units.

    Punctuation around a word does not count. A number has a digit and only digits and number signs; a unit
    stands in UNITS and follows a number; a name is a run of words that begin with a capital letter (Latin-1,
    Greek or Cyrillic).
    """
    blank = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    start, end = edges[::2].copy(), edges[1::2].copy()
    for _ in range(3):
        end -= (end - start > 1) & _PUNCT[data[end - 1]]
        start += (end - start > 1) & _PUNCT[data[np.minimum(start, len(data) - 1)]]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, bool), start, end
    count = lambda m: (c := np.concatenate(([0], np.cumsum(m))))[end] - c[start]
    number = (count(_DIGIT[data]) > 0) & (count(_NUMERIC[data]) == end - start)
    second = data[np.minimum(start + 1, len(data) - 1)]
    lead = data[start]
    name = _UPPER[lead]
    for byte, lo, hi in _CAPITALS:
        name |= (lead == byte) & (second >= lo) & (second <= hi) & (end - start > 1)
    low = _LOWER[data]
    words = range_hash(sums(low), start, end)
    at = np.minimum(np.searchsorted(_UNIT_HASHES, words), len(_UNIT_HASHES) - 1)
    unit = (_UNIT_HASHES[at] == words) & np.concatenate(([False], number[:-1])) & ~number
    words = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, words)))
    name &= ~number & ~unit
    keep = ~(name & np.concatenate(([False], name[:-1])))  # a name of several words is one slot
    last = np.concatenate((np.flatnonzero(keep)[1:], [len(keep)])) - 1
    return words[keep], (number | unit | name)[keep], start[keep], end[last]


def windows(words: np.ndarray, slot: np.ndarray, n: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, usable) of each window of n template words; usable ones have so many literal words at least."""
    k = n
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    size = len(words) - k + 1
    total = np.zeros(size, np.uint64)
    for i in range(k):
        total += mix(words[i : size + i] * _STEPS[i])
    c = np.concatenate(([0], np.cumsum(~slot)))
    return mix(total + np.uint64(k)), c[k:] - c[:-k] >= min(literals, k)


_ROWS = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("pos", pa.int32()), ("slots", pa.list_(pa.string()))])


def _windows(widths: tuple[int, ...], literals: int, only, short: bool):
    """id, window hash, its position among the words, its slots' words with their places in the window as 'i=word'.

    Windows have the first width; with `short`, texts of fewer words are one window, else all widths are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if only is None else np.frombuffer(only.value, np.uint8)
        for batch in batches:
            offsets, data = texts(batch.column("bytes"))
            ids = batch.column("id").to_pylist()
            out: list[tuple] = []
            for i in range(batch.num_rows):
                part = data[offsets[i] : offsets[i + 1]]
                if not len(part):
                    continue
                words, slot, start, end = template(part)
                raw = part.tobytes()
                for k in [min(widths[0], len(words))] if short else widths:
                    h, ok = windows(words, slot, k, literals)
                    if wanted is not None and len(h):
                        at = h & np.uint64(MAP_BITS - 1)
                        ok = ok & ((wanted[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                    for p in np.flatnonzero(ok).tolist():
                        slots = [f"{j}={raw[start[p + j] : end[p + j]].decode('utf-8', 'replace').lower()}" for j in range(k) if slot[p + j]]
                        out.append((ids[i], int(h[p].view(np.int64)), p, slots))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROWS, strict=True)], schema=_ROWS)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROWS, strict=True)], schema=_ROWS)

    return run


def _hash_map(items: DataFrame):
    """A bit for each window hash of the items, MAP_BITS in all; built in tasks, in pieces of a fixed size."""
    at = items.select(F.expr(f"h & {MAP_BITS - 1}L").alias("at"))
    pieces = at.groupBy(F.expr("at >> 15").alias("piece")).agg(F.bitmap_construct_agg(F.expr("at & 32767")).alias("bits"))
    bits = bytearray(MAP_BITS // 8)
    for piece, part in pieces.collect():  # 2048 pieces of 4 KB at most
        bits[piece << 12 : (piece + 1) << 12] = part
    return bytes(bits)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", n: int = 5, coverage: float = 0.8, literals: int = 2) -> DataFrame:
    """One row per leak: key, item, coverage, reparameterised.

    Windows of n template words of texts and items are hash-joined. On each diagonal (difference of the two
    positions) the slots must be consistent: one word of the item always stands for one word of the text, the
    commonest of the diagonal (ties: the greatest); windows with another one do not count. A text leaks an item
    when the windows that are left cover the given share of the item's usable windows; reparameterised tells
    that some slot differs. An item of fewer than n words is one window of its own length. Windows need so many
    literal words (all of them, in shorter windows), so that runs of placeholders say nothing; items without
    usable windows, null and empty texts never match. Texts of any length are read whole. Repeated rows give
    one leak; keys are integers, and a null key is none. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ddl = "id long, h long, pos int, slots array<string>"
    side = lambda df, k: df.where(F.col(k).isNotNull()).select(F.col(k).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    items = materialize(side(benchmark, item).mapInArrow(_windows((n,), literals, None, True), ddl), "items")
    words = side(benchmark, item).select(F.regexp_count(F.col("bytes").cast("string"), F.lit(WORD)).alias("k")).where(f"k > 0 and k < {n}").distinct()
    widths = (n, *sorted(r[0] for r in words.collect()))  # n numbers at most
    only = spark.sparkContext.broadcast(_hash_map(items))
    found = side(docs, key).mapInArrow(_windows(widths, literals, only, False), ddl).distinct()
    sizes = items.groupBy("id").agg(F.countDistinct("pos").alias("total"))
    ours = items.select(F.col("id").alias("item"), "h", F.col("pos").alias("ipos"), F.col("slots").alias("islots")).distinct()
    met = found.join(ours, "h").withColumn("diagonal", F.col("pos") - F.col("ipos"))
    pairs = F.zip_with("islots", "slots", lambda a, b: F.struct(F.regexp_replace(a, r"^\d+=", "").alias("a"), F.regexp_replace(b, r"^\d+=", "").alias("b")))
    met = materialize(met.withColumn("pairs", pairs), "met")
    at = ["id", "item", "diagonal"]
    slots = met.select(*at, "ipos", F.inline("pairs"))
    best = slots.groupBy(*at, "a", "b").agg(F.count("*").alias("n")).groupBy(*at, "a").agg(F.max(F.struct("n", "b")).alias("best"))
    odd = slots.join(best, [*at, "a"]).where(F.col("b") != F.col("best.b")).select(*at, "ipos").distinct()
    consistent = met.join(odd, [*at, "ipos"], "left_anti")
    leaks = consistent.groupBy("id", "item").agg(F.countDistinct("ipos").alias("covered"), F.max(F.exists("pairs", lambda p: p["a"] != p["b"])).alias("reparameterised"))
    leaks = leaks.join(sizes.withColumnRenamed("id", "item"), "item").withColumn("coverage", F.col("covered") / F.col("total")).where(F.col("coverage") >= coverage)
    return leaks.select(F.col("id").alias(key), F.col("item").alias(item), "coverage", "reparameterised")
