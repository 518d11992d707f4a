"""N-gram Jaccard join with signature trees.

Texts become sets of word shingles; equal sets are one class. Two sets can only reach the threshold when they
share one of the first tokens of both in a common order, so classes meet in cells by such tokens; the order
puts frequent tokens last, which keeps cells small. In a cell the classes form a tree whose nodes hold
OR-combined token bitmaps and size ranges, and a dual traversal drops every pair of nodes whose largest
possible overlap is too small. What is left is verified on the whole sets. Dense cells first offer each class
its best partners only; pairs inside a component found so far are never needed, and a last round offers all
pairs that still cross components, so no link between different texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, met, release
from .hashing import mix, range_hash, sums, texts

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEPS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)
#: Tokens that the order puts last, at most; the choice changes costs, never results.
MOST_FREQUENT = 1 << 18


def shingles(data: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text; shorter texts have one, of all their words."""
    data = _LOWER[data]
    blank = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    if not len(edges):
        return np.zeros(0, np.uint64)
    words = range_hash(sums(data), edges[::2], edges[1::2])
    k = min(n, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total += mix(words[i : len(words) - k + 1 + i] * _STEPS[i])
    return np.unique(mix(total + np.uint64(k)))


def class_of(tokens: np.ndarray) -> int:
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(tokens) if len(tokens) else 0], np.uint64) + np.uint64(len(tokens)))[0].view(np.int64))


_SETS = pa.schema([("kind", pa.int32()), ("rid", pa.int64()), ("size", pa.int64()), ("ck", pa.int64()), ("bits", pa.binary())])


def _sets(n: int, chunk: int = 2_000_000):
    """kind 0: a text's row, set size and class, and once per partition the bitmap of the class. kind 1: a token frequent in this stretch of texts and its count."""

    def frequent(pending: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(pending), return_counts=True)
        often = counts >= max(4, len(pending) // 256)
        k = int(often.sum())
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, 1, np.int32)), pa.array(np.zeros(k, np.int64)), pa.array(counts[often].astype(np.int64)), pa.array(tokens[often].view(np.int64)), pa.nulls(k, pa.binary())], schema=_SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pending: list[np.ndarray] = []
        held = 0
        for batch in batches:
            offsets, data = texts(batch.column("bytes"))
            sizes, classes, bits = [], [], []
            for i in range(batch.num_rows):
                tokens = shingles(data[offsets[i] : offsets[i + 1]], n)
                ck = class_of(tokens)
                sizes.append(len(tokens))
                classes.append(ck)
                bits.append(None)
                if ck not in seen and len(tokens):
                    seen.add(ck)
                    bits[-1] = bitmap(tokens).tobytes()
                    pending.append(tokens)
                    held += len(tokens)
                    if held >= chunk:
                        yield frequent(pending)
                        pending, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), batch.column("rid"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(bits, pa.binary())], schema=_SETS)
        if pending:
            yield frequent(pending)

    return run


_PREFIX = pa.schema([("tok", pa.int64()), ("ck", pa.int64()), ("size", pa.int64())])


def _prefixes(n: int, percent: int, last, flush: int = 200_000):
    """The first tokens of each class: sets that link share at least one of them. A class shows once per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = last.value
        seen: set[int] = set()
        out: list[tuple] = []
        held = 0

        def told() -> pa.RecordBatch:
            tok, ck, size = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(ck), pa.array(size)], schema=_PREFIX)

        for batch in batches:
            offsets, data = texts(batch.column("bytes"))
            for i in range(batch.num_rows):
                tokens = shingles(data[offsets[i] : offsets[i + 1]], n)
                ck = class_of(tokens)
                if ck in seen or not len(tokens):
                    continue
                seen.add(ck)
                k = len(tokens) - (-(-percent * len(tokens) // 100)) + 1
                if len(often):
                    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
                    tokens = tokens[np.argsort(often[at] == tokens, kind="stable")]
                out.append((tokens[:k], np.full(k, ck, np.int64), np.full(k, len(tokens), np.int64)))
                held += k
                if held >= flush:
                    yield told()
                    out, held = [], 0
        if out:
            yield told()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by tok, those whose token has more than one row. Holds back one row at most."""
    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        tok = np.asarray(batch.column("tok"))
        same = tok[1:] == tok[:-1]
        keep = np.zeros(len(tok), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if last is not None and tok[0] == last:
            keep[0] = True
            if held is not None:
                yield held
        last, held = tok[-1], None if keep[-1] else batch.slice(batch.num_rows - 1)
        if keep.any():
            yield batch.filter(pa.array(keep))


def _tokens(n: int):
    """(ck, bytes) -> the whole set."""
    schema = pa.schema([("ck", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = texts(batch.column("bytes"))
            for a in range(0, batch.num_rows, 500):
                b = min(a + 500, batch.num_rows)
                sets = [shingles(data[offsets[i] : offsets[i + 1]], n).view(np.int64) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([batch.column("ck").slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return run


def bitmap(tokens: np.ndarray) -> np.ndarray:
    width = 1 << int(np.clip(int(2 * max(1, len(tokens)) - 1).bit_length(), 8, 20))
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, width), axis=0)


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def banded_pairs(sizes: np.ndarray, bitmaps: list[bytes], label: np.ndarray, side: np.ndarray, percent: int, best: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """tree_pairs over members with bitmaps of one width, and across neighbouring widths, so that the bitmaps of
    large sets keep their power. Sizes that differ by more than that never link."""
    widths = np.array([len(b) for b in bitmaps])
    bands = [np.flatnonzero(widths == w) for w in np.unique(widths)]
    for k, band in enumerate(bands):
        groups = [(band, np.zeros(len(band), np.int64))]
        if k + 1 < len(bands) and 100 * sizes[band].max() >= percent * sizes[bands[k + 1]].min():
            near = [band[100 * sizes[band] >= percent * sizes[bands[k + 1]].min()], bands[k + 1][percent * sizes[bands[k + 1]] <= 100 * sizes[band].max()]]
            groups.append((np.concatenate(near), np.repeat([1, 2], [len(x) for x in near])))
        for at, of in groups:
            if len(at) > 1:
                for x, y in tree_pairs(sizes[at], [bitmaps[i] for i in at], label[at], side[at], of, percent, best):
                    yield at[x], at[y]


def tree_pairs(sizes: np.ndarray, bitmaps: list[bytes], label: np.ndarray, side: np.ndarray, band: np.ndarray, percent: int, best: int, fan: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members that may reach the threshold and have different labels, by dual traversal of a signature tree.

    side, band: pairs must take members of different sides, and of different bands, unless all are the same. best: so many partners a
    member at most, those with the largest possible overlap (0: all).
    """
    width = min(len(b) for b in bitmaps)
    raw = np.stack([folded(np.frombuffer(b, np.uint8), width) for b in bitmaps])
    order = np.lexsort((*(raw[:, i] for i in range(min(4, width))), sizes))
    sizes, raw, label, apart = sizes[order], raw[order].view(np.uint64), label[order], [s[order] for s in (side, band) if s.min() != s.max()]
    levels = [(raw, sizes, sizes, sizes - _count(raw), label, label)]
    while len(levels[-1][0]) > 1:
        b, lo, hi, extra, la, lb = levels[-1]
        at = np.arange(0, len(b), fan)
        levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(extra, at), np.minimum.reduceat(la, at), np.maximum.reduceat(lb, at)))
    kept: list[tuple] = []
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, x, y = stack.pop()
        if len(x) > 1 << 15:
            half = len(x) // 2
            stack += [(depth, x[:half], y[:half]), (depth, x[half:], y[half:])]
            continue
        b, lo, hi, extra, la, lb = levels[depth]
        need = percent * (lo[x] + lo[y])  # overlap * (100 + percent) must reach it
        ok = (100 * hi[x] >= percent * lo[y]) & (100 * hi[y] >= percent * lo[x]) & ~((la[x] == lb[x]) & (la[y] == lb[y]) & (la[x] == la[y]))
        x, y, need = x[ok], y[ok], need[ok]
        if depth:
            common = _count(b[x] & b[y])
            most = np.minimum(np.minimum(extra[x], extra[y]) + common, np.minimum(hi[x], hi[y]))
            most = np.where(x == y, hi[x], most)
            ok = most * (100 + percent) >= need
            x, y = x[ok], y[ok]
            n = len(levels[depth - 1][0])
            i, j = np.divmod(np.arange(fan * fan), fan)
            p, q = (x[:, None] * fan + i).ravel(), (y[:, None] * fan + j).ravel()
            ok = (p < n) & (q < n) & ((p <= q) if depth > 1 else (p < q))
            stack.append((depth - 1, p[ok], q[ok])) if ok.any() else None
            continue
        for s in apart:
            ok = s[x] != s[y]
            x, y, need = x[ok], y[ok], need[ok]
        most = np.minimum(sizes[x] - _count(b[x] & ~b[y]), sizes[y] - _count(b[y] & ~b[x]))
        ok = most * (100 + percent) >= need
        if not ok.any():
            continue
        x, y, slack = x[ok], y[ok], (most * (100 + percent) - need)[ok]
        if not best:
            yield order[x], order[y]
            continue
        kept.append((x, y, slack))
        if sum(len(k[0]) for k in kept) > 1 << 20:
            kept = [_best(kept, best)]
    if kept:
        x, y, _ = _best(kept, best)
        yield order[x], order[y]


def _best(kept: list[tuple], best: int) -> tuple:
    """Of (x, y, slack), the pairs that are among the best of either member."""
    x, y, slack = (np.concatenate(k) for k in zip(*kept, strict=True))
    keep = np.zeros(len(x), bool)
    for a in (x, y):
        order = np.lexsort((-slack, a))
        first = np.concatenate(([True], a[order][1:] != a[order][:-1]))
        rank = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
        keep[order[rank < best]] = True
    return x[keep], y[keep], slack[keep]


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _cells(percent: int, best: int):
    """Rows sorted by (tok, part): pairs of classes of a cell that may link, least first."""

    def pairs(rows: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        ck = np.array(list(rows), np.int64)
        size, bits, label, side = (list(x) for x in zip(*rows.values(), strict=True))
        for x, y in banded_pairs(np.array(size, np.int64), bits, np.array(label, np.int64), np.array(side, np.int64), percent, best):
            a, b = np.minimum(ck[x], ck[y]), np.maximum(ck[x], ck[y])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, tuple] = {}
        last = None
        for batch in batches:
            for tok, part, ck, size, bits, label, side in zip(*(batch.column(c).to_pylist() for c in ("tok", "part", "ck", "size", "bits", "label", "side")), strict=True):
                if (tok, part) != last and rows:
                    if len(rows) > 1:
                        yield from pairs(rows)
                    rows = {}
                last = (tok, part)
                rows[ck] = (size, bits, label, side)
        if len(rows) > 1:
            yield from pairs(rows)

    return run


def link_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, part_rows: int = 2048, best: int = 4) -> DataFrame:
    """One row per input row: key, n_shingles (long), component_id: the smallest key that links reach.

    Two texts link when 100 * |intersection| >= percent * |union| of their distinct n-word shingles (A-Z in
    lower case). Texts with fewer words have one shingle of all of them; texts without words, and null, have
    none and link with nothing. Repeated rows are copies. Cells with more than part_rows classes are split
    into blocks, and each pair of blocks is a cell of its own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).select("id", F.xxhash64("id", "t", F.length("t")).alias("rid"), F.col("t").cast("binary").alias("bytes"))
    slim = rows.select("rid", "bytes")
    sets = materialize(slim.mapInArrow(_sets(n), "kind int, rid long, size long, ck long, bits binary"), "sets")
    often = sets.where("kind = 1").groupBy("ck").agg(F.sum("size").alias("count")).orderBy(F.desc("count"), "ck").limit(MOST_FREQUENT).select("ck")
    often = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64)))  # MOST_FREQUENT numbers at most
    first = slim.mapInArrow(_prefixes(n, percent, often), "tok long, ck long, size long")
    shared = first.repartition("tok").sortWithinPartitions("tok").mapInArrow(_shared, "tok long, ck long, size long")
    shared = materialize(shared, "shared")
    members = shared.groupBy("tok", "ck").agg(F.min("size").alias("size"))
    alike = members.groupBy("tok").agg(F.count("*").alias("width"), F.expr("bit_xor(xxhash64(ck))").alias("s1"), F.expr("bit_xor(xxhash64(ck, 1))").alias("s2")).where("width > 1")
    cells = alike.groupBy("width", "s1", "s2").agg(F.min("tok").alias("tok")).select("tok", "width")  # equal cells once
    members = materialize(members.join(cells, "tok"), "members")

    of_class = sets.where("kind = 0").groupBy("ck").agg(F.min("rid").alias("rid"), F.max("bits").alias("bits"))
    blocks = F.ceil(F.col("width") / part_rows).cast("long")
    own = F.pmod(F.xxhash64("ck"), blocks)
    spread = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct((F.least(own, b) * blocks + F.greatest(own, b)).alias("part"), F.when(own > b, 1).otherwise(0).alias("side"))))
    dealt = members.join(of_class.select("ck", "bits"), "ck").withColumn("x", spread).select("tok", "x.part", "x.side", "ck", "size", "bits")
    dealt = materialize(dealt, "cells")

    components = sets_of = wanted = None
    labels = members.select("ck").distinct().withColumn("label", F.col("ck"))
    for partners in (best, best, 0):  # the last round offers every pair that still crosses components
        named = dealt.withColumn("label", F.col("ck")) if wanted is None else dealt.join(labels, "ck")
        offered = named.repartition("tok", "part").sortWithinPartitions("tok", "part").mapInArrow(_cells(percent, partners), "a long, b long").distinct()
        offered = materialize(offered, "offered")
        if wanted is None:  # a class that has any partner is offered its best one, so later rounds need no other sets and no other rows of cells
            wanted = offered.select(F.col("a").alias("ck")).unionByName(offered.select(F.col("b").alias("ck"))).distinct()
            wanted = materialize(wanted.join(of_class.select("ck", "rid"), "ck"), "wanted")
            sets_of = materialize(met(slim, "rid", wanted).join(wanted, "rid").dropDuplicates(["ck"]).select("ck", "bytes").mapInArrow(_tokens(n), "ck long, tokens array<long>"), "tokens")
            every, dealt = dealt, materialize(met(dealt, "ck", wanted).join(wanted.select("ck"), "ck"), "cells")
            release(every)
        left, right = sets_of.select(F.col("ck").alias("a"), F.col("tokens").alias("ta")), sets_of.select(F.col("ck").alias("b"), F.col("tokens").alias("tb"))
        both = offered.join(left, "a").join(right, "b")
        overlap = F.size(F.array_intersect("ta", "tb"))
        found = both.where(100 * overlap >= percent * (F.size("ta") + F.size("tb") - overlap)).select("a", "b")
        found = materialize(found, "links")
        if found.isEmpty():
            continue
        links = found if components is None else found.unionByName(components.select(F.col("node").alias("a"), F.col("component").alias("b")))
        components = materialize(connected_components(links), "components")
        labels = members.select("ck").distinct().join(components, F.col("ck") == F.col("node"), "left").select("ck", F.coalesce("component", "ck").alias("label"))

    of = sets.where("kind = 0").groupBy("rid").agg(F.min("size").alias("n_shingles"), F.min("ck").alias("ck"))
    out = rows.select("id", "rid").join(of, "rid").join(labels, "ck", "left").withColumn("label", F.coalesce("label", "ck"))
    least = out.groupBy("label").agg(F.min("id").alias("least"))
    out = out.join(least, "label")
    return out.select(F.col("id").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
