"""Quality scores by gradient-boosted trees over histograms of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import materialize, release

#: Statistics of a document, in this order.
STATISTICS = [
    "n_words", "n_chars", "n_lines", "word_length", "word_length_spread", "letters", "capitals", "digits", "symbols", "bars", "points", "other_ascii", "beyond_ascii", "spaces",
    "words_per_line", "words_per_point", "symbol_words", "distinct_words", "top_word", "repeated_pairs", "distinct_pairs", "repeated_lines", "short_words", "long_words",
]
#: Bytes of text that are counted at once; one longer text is cut at white space.
PIECE = 1 << 20
#: Bytes of text whose words are held at once, but for a longer single text.
GROUP = 4 << 20
#: Whole numbers that a gradient of 1 stands for: sums of whole numbers do not depend on their order.
UNIT = 1 << 24

LETTER, CAPITAL, DIGIT, SYMBOL, BAR, POINT, OTHER, BEYOND, TRAIL, SPACE, NEWLINE = range(11)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[list(range(ord("a"), ord("z") + 1))] = LETTER
    out[list(range(ord("A"), ord("Z") + 1))] = CAPITAL
    out[list(range(ord("0"), ord("9") + 1))] = DIGIT
    out[[ord(c) for c in "#*$%&<>@^~_={}[]\\"]] = SYMBOL
    out[ord("|")] = BAR
    out[[ord(c) for c in ".!?"]] = POINT
    out[0x80:0xC0] = TRAIL
    out[0xC0:] = BEYOND
    out[[9, 11, 12, 13, 32]] = SPACE
    out[10] = NEWLINE
    return out


CLASS = _classes()


def _pieces(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bounds, documents): neighbouring texts of PIECE bytes in all, and longer ones in parts that end with white space."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= PIECE:
            j += 1
        if offsets[j] - offsets[i] <= PIECE:
            yield offsets[i : j + 1], np.arange(i, j)
        else:  # one long text
            at, end = int(offsets[i]), int(offsets[i + 1])
            while at < end:
                stop = min(end, at + PIECE)
                while stop < end:
                    blank = np.flatnonzero(CLASS[data[stop : stop + PIECE]] >= SPACE)
                    if len(blank):
                        stop = min(end, stop + int(blank[0]) + 1)
                        break
                    stop = min(end, stop + PIECE)
                yield np.array([at, stop]), np.array([i])
                at = stop
        i = j


def _tally(docs: list[np.ndarray], hashes: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: distinct hashes, the count of the commonest, and those that stand more than once."""
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    value = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(doc)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc[at], count)
    return np.bincount(doc[at], minlength=n), top, np.bincount(doc[at], weights=np.where(count > 1, count - 1, 0), minlength=n)


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """STATISTICS of texts given as bytes: counts of byte classes, words, pairs of words and lines; shares where it fits.

    Words of a pair or line that a cut of a long text divides do not meet; a text below PIECE bytes is never cut.
    """
    n = len(offsets) - 1
    counts, words, lengths, squares, symbol_words, short, long = np.zeros((n, 11)), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    word_docs, word_hashes, pair_docs, pair_hashes, line_docs, line_hashes = [], [], [], [], [], []
    for bounds, documents in _pieces(offsets, data):
        base, piece = int(bounds[0]), data[bounds[0] : bounds[-1]]
        if not len(piece):
            continue
        sizes = np.diff(bounds)
        owner = np.repeat(documents, sizes)
        kind = CLASS[piece]
        counts += np.bincount(owner * 11 + kind, minlength=n * 11).reshape(n, 11)
        inside = np.zeros(len(piece) + 2, np.int8)
        inside[1:-1] = kind < SPACE
        edge = np.zeros(len(piece) + 1, bool)  # a word never crosses the end of a text
        edge[bounds - base] = True
        begin = np.flatnonzero((inside[1:-1] == 1) & ((inside[:-2] == 0) | edge[:-1]))
        end = np.flatnonzero((inside[1:-1] == 1) & ((inside[2:] == 0) | edge[1:])) + 1
        prefix = hashing.sums(piece)
        if len(begin):
            doc = owner[begin]
            h = hashing.range_hash(prefix, begin, end)
            chars = np.append(0, np.cumsum(kind != TRAIL))
            length = (chars[end] - chars[begin]).astype(float)
            signs = np.append(0, np.cumsum((kind == SYMBOL) | (kind == BAR)))
            words += np.bincount(doc, minlength=n)
            lengths += np.bincount(doc, weights=length, minlength=n)
            squares += np.bincount(doc, weights=length**2, minlength=n)
            symbol_words += np.bincount(doc[signs[end] > signs[begin]], minlength=n)
            short += np.bincount(doc[length <= 3], minlength=n)
            long += np.bincount(doc[length >= 12], minlength=n)
            word_docs.append(doc)
            word_hashes.append(h)
            same = doc[1:] == doc[:-1]
            pair_docs.append(doc[1:][same])
            pair_hashes.append(hashing.mix(h[:-1] * np.uint64(3) + h[1:])[same])
        stops = np.flatnonzero(kind == NEWLINE) + 1
        ends = np.unique(np.concatenate([stops, bounds[1:] - base]))
        starts = np.append(0, ends[:-1])
        ends = ends - (kind[ends - 1] == NEWLINE)
        starts, ends = starts[ends > starts], ends[ends > starts]
        line_docs.append(owner[starts])
        line_hashes.append(hashing.range_hash(prefix, starts, ends))
    distinct, top, _ = _tally(word_docs, word_hashes, n)
    pairs, _, again = _tally(pair_docs, pair_hashes, n)
    _, _, lines_again = _tally(line_docs, line_hashes, n)
    n_lines = np.bincount(np.concatenate(line_docs), minlength=n) if line_docs else np.zeros(n)
    chars = counts.sum(axis=1) - counts[:, TRAIL]
    per = lambda a, b: a / np.maximum(b, 1)
    mean = per(lengths, words)
    shares = [per(counts[:, k], chars) for k in (CAPITAL, DIGIT, SYMBOL, BAR, POINT, OTHER, BEYOND)]
    out = [
        words, chars, n_lines, mean, np.sqrt(np.maximum(per(squares, words) - mean**2, 0)), per(counts[:, LETTER] + counts[:, CAPITAL], chars), *shares, per(counts[:, SPACE] + counts[:, NEWLINE], chars),
        per(words, n_lines), per(words, counts[:, POINT]), per(symbol_words, words), per(distinct, words), per(top, words), per(again, words), per(pairs, words), per(lines_again, n_lines), per(short, words), per(long, words),
    ]
    return np.column_stack(out).astype(np.float32)


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, statistics array<float>) of each row's whole text; null is empty, and an empty text has zeros."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_t"))

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                offsets, data = hashing.texts(batch.column("_t"))
                cuts = np.unique(np.append(np.searchsorted(offsets, np.arange(offsets[0] + GROUP, offsets[-1], GROUP)), batch.num_rows))
                flat = np.vstack([statistics(offsets[a : b + 1], data) for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=True)])
                lists = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "statistics"])

    return rows.mapInArrow(work, f"`{key}` {docs.schema[key].dataType.simpleString()}, statistics array<float>")


@dataclass
class Trees:
    """Complete trees of one depth in flat arrays: feature and bin of each inner node, value of each leaf, by tree.

    edges: the upper bounds of the bins of each statistic. A row goes right when its bin is above the node's.
    """

    edges: list[np.ndarray]
    base: float
    depth: int
    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(self.edges)]).astype(np.uint8) if len(values) else np.zeros((0, len(self.edges)), np.uint8)

    def nodes(self, bins: np.ndarray, tree: int, depth: int) -> np.ndarray:
        """The node of that depth, counted from the left, that each row comes to."""
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for level in range(depth):
            node = at + (1 << level) - 1
            at = 2 * at + (bins[row, self.feature[tree, node]] > self.bin[tree, node])
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in range(len(self.leaf)):
            out += self.leaf[tree, self.nodes(bins, tree, self.depth)]
        return out


def _histograms(rows: DataFrame, model: Trees, level: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and of their slopes for (node of the last tree's level, statistic, bin), over all rows.

    Each task counts its rows into one histogram, and Spark adds the histograms up by cell: what reaches the driver
    is nodes x statistics x bins numbers, whatever the rows.
    """
    k, tree = len(model.edges), len(model.leaf) - 1
    done = Trees(model.edges, model.base, model.depth, model.feature[:tree], model.bin[:tree], model.leaf[:tree])
    cells = (1 << level) * k * bins

    def partial(batches):
        total = np.zeros((2, cells), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            b = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, k)
            p = 1 / (1 + np.exp(-done.margins(b)))
            g = np.rint((batch.column("label").to_numpy() - p) * UNIT)
            s = np.rint(p * (1 - p) * UNIT)
            cell = ((model.nodes(b, tree, level)[:, None] * k + np.arange(k)) * bins + b).ravel()
            total[0] += np.rint(np.bincount(cell, weights=np.repeat(g, k), minlength=cells)).astype(np.int64)
            total[1] += np.rint(np.bincount(cell, weights=np.repeat(s, k), minlength=cells)).astype(np.int64)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0, at]), pa.array(total[1, at])], ["cell", "g", "s"])

    out = np.zeros((2, cells))
    for r in rows.mapInArrow(partial, "cell int, g long, s long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("s").alias("s")).collect():
        out[:, r["cell"]] = r["g"] / UNIT, r["s"] / UNIT
    return tuple(out.reshape(2, 1 << level, k, bins))


def fit_trees(rows: DataFrame, trees: int = 16, depth: int = 3, bins: int = 48, rate: float = 0.4, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosted trees on rows (statistics, label 0 or 1). Each level of a tree is one job that returns a histogram.

    Bins are approximate quantiles of all rows. A node splits where the gain of the log loss is largest, ties by
    statistic and bin; both sides keep slopes of `least`. Gradients are rounded to whole numbers before they are
    added, so reruns give the same trees. Margins are computed anew from the trees in each job: no state of rows is
    kept. Boosting ends early when no node of a tree splits. Without rows the base is 0; with one class, trees are
    leaves.
    """
    k = len(STATISTICS)
    share = [i / bins for i in range(1, bins)]
    told = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), *[F.percentile_approx(F.col("statistics")[i], share, 20000).alias(f"e{i}") for i in range(k)]).first()
    n, ones = told["n"], told["ones"] or 0
    edges = [np.unique(np.array(told[f"e{i}"] or [], np.float32)) for i in range(k)]
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    inner = (1 << depth) - 1
    model = Trees(edges, base, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, 1 << depth)))
    if not n or ones in (0, n):
        return model
    cut = Trees(edges, 0.0, 0, model.feature, model.bin, model.leaf)

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                b = cut.bins(batch.column("statistics").flatten().to_numpy().reshape(batch.num_rows, k))
                lists = pa.ListArray.from_arrays(np.arange(len(b) + 1, dtype=np.int32) * k, pa.array(b.ravel().astype(np.int16)))
                yield pa.RecordBatch.from_arrays([lists, batch.column("label")], ["bins", "label"])

    train = materialize(rows.mapInArrow(binned, "bins array<smallint>, label int"), "binned")
    for _ in range(trees):
        model.feature, model.bin = np.vstack([model.feature, np.zeros((1, inner), np.int64)]), np.vstack([model.bin, np.full((1, inner), bins, np.int64)])
        model.leaf = np.vstack([model.leaf, np.zeros((1, 1 << depth))])
        grown = False
        for level in range(depth):
            g, s = _histograms(train, model, level, bins)
            left_g, left_s = g.cumsum(axis=2), s.cumsum(axis=2)
            all_g, all_s = left_g[:, :, -1:], left_s[:, :, -1:]
            gain = left_g**2 / (left_s + ridge) + (all_g - left_g) ** 2 / (all_s - left_s + ridge) - all_g**2 / (all_s + ridge)
            gain[(left_s < least) | (all_s - left_s < least)] = 0
            for node in range(1 << level):
                best = int(np.argmax(gain[node].round(9)))
                f, b = divmod(best, bins)
                splits = gain[node, f, b] > 1e-6
                at = (1 << level) - 1 + node
                model.feature[-1, at], model.bin[-1, at] = (f, b) if splits else (0, bins)
                grown |= splits
                if level == depth - 1:
                    sides = [(left_g[node, f, b], left_s[node, f, b]), (all_g[node, f, 0] - left_g[node, f, b], all_s[node, f, 0] - left_s[node, f, b])] if splits else [(all_g[node, 0, 0], all_s[node, 0, 0]), (0.0, 0.0)]
                    model.leaf[-1, 2 * node : 2 * node + 2] = [rate * a / (c + ridge) for a, c in sides]
        if not grown:
            break
    release(train)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = 200_000, threshold: float = 0.3, folds: int = 5, **fit) -> DataFrame:
    """Key, held_out, score and predicted of each row: the likelihood of label 1, from statistics of its whole text.

    Rows whose crc32 of the key as text is 0 modulo folds are held out and never teach; a null key counts as the empty
    text and is held out. Labels other than 0 and 1 are not used; a key with both teaches both, and repeated labels
    count once. All labelled rows teach up to fit_rows of them; beyond it, a share of fit_rows over their number is
    taken by a hash of key and statistics, which bounds the cost of a fit, not of scoring. Null and empty texts are
    scored like others; equal texts get equal scores. Without usable labels each score is 0.5, with one class near it.
    Repeated rows give repeated results; an empty table gives none; other columns are not read, whatever their names.
    """
    bucket = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    stats = materialize(document_statistics(docs, key, text), "statistics")
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("label")).distinct()
    taught = stats.where(bucket != 0).join(known, F.col(key) == F.col("_k")).select(key, "statistics", "label")
    taught = materialize(taught, "taught")
    n = taught.count()
    if n > fit_rows:
        share = int(fit_rows / n * (1 << 30))
        chosen = taught.where(F.pmod(F.xxhash64(key, "statistics", F.lit(29)), F.lit(1 << 30)) < share)
    else:
        chosen = taught
    model = fit_trees(chosen, **fit)
    release(taught)
    k = len(STATISTICS)

    def scored(batches):
        for batch in batches:
            if batch.num_rows:
                values = batch.column("statistics").flatten().to_numpy().reshape(batch.num_rows, k)
                score = 1 / (1 + np.exp(-model.margins(model.bins(values))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return stats.select(key, "statistics", (bucket == 0).alias("held_out")).mapInArrow(scored, f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")
