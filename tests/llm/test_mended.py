"""Damaged archives, reading by the offset index, repeated rows of the mix, and short lines."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.llm import line_dedup, mixing, warc


def archives(spark, n=40, **more):
    draw = np.random.default_rng(2)
    pages = [(i, f"http://x/{i}", bytes(draw.integers(97, 122, 3000, np.uint8)).decode()) for i in range(n)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    return pages, warc.write_archives(df, **more).collect()


def test_cut_archives_and_surplus_bytes_are_errors(spark):
    pages, rows = archives(spark)
    whole = b"".join(bytes(r.chunk) for r in sorted(rows, key=lambda r: r.seq))
    assert len(list(warc.records_of(iter([whole])))) == len(list(warc.records_of(whole[i : i + 700] for i in range(0, len(whole), 700)))) == 40
    for bad in (whole[: len(whole) // 2], whole[:-1], whole[:5], gzip.compress(gzip.decompress(whole)[:-3]), whole + gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")):
        with pytest.raises(ValueError, match="archive ends"):
            list(warc.records_of(iter([bad])))
    with pytest.raises(zlib.error):
        list(warc.records_of(iter([whole + b"no gzip"])))
    cut = spark.createDataFrame([("a", 0, whole[: len(whole) // 2])], "archive string, seq int, chunk binary")
    with pytest.raises(Exception, match="archive ends"):
        warc.normalise(cut).count()
    assert list(warc.records_of(iter([]))) == []


def test_several_members_in_one_archive_read_on(spark):
    _, rows = archives(spark, 6)
    whole = b"".join(bytes(r.chunk) for r in rows)
    assert len(list(warc.records_of(iter([whole + whole, whole])))) == 18


def test_records_are_read_by_the_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 20_000)
    pages, rows = archives(spark, 60, archive_bytes=90_000, chunk_bytes=5_000)
    stored = spark.createDataFrame(rows, "archive string, seq int, chunk binary")
    files = spark.createDataFrame(warc.normalised_files(stored.coalesce(1)).collect(), warc.normalised_files(stored).schema)
    assert files.select("archive").distinct().count() > 1
    got = {r.page_id: r.payload_digest for r in warc.read_members(files).collect() if r.intact}
    assert got == {i: hashlib.sha1(t.encode()).hexdigest() for i, _, t in pages}
    by = {}
    for r in files.collect():
        by.setdefault(r.archive, {})[r.seq] = (r.start, bytes(r.piece))
    whole = {a: b"".join(p for _, (_, p) in sorted(x.items())) for a, x in by.items()}
    for r in warc.offset_index(files).collect():
        assert f"<{r.record_id}>".encode() in gzip.decompress(whole[r.archive][r.offset : r.offset + r.length])
    moved = files.withColumn("index", F.transform("index", lambda e: F.struct(e["record"].alias("record"), e["record_id"].alias("record_id"), (e["offset"] + 1).alias("offset"), e["length"].alias("length"))))
    with pytest.raises(Exception, match="incorrect header|Error -3"):
        warc.read_members(moved).count()


def test_long_and_repeated_pages(spark):
    long = "<p>é" * 1_500_000
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (2, "u", long), (3, "u", "s"), (3, "u", "s"), (None, None, None)], "page_id long, url string, html string").withColumn("start", F.lit("x")).withColumn("index", F.lit(1))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.intact) for r in warc.round_trip(pages).collect())
    n = len(long.encode())
    assert got == {(1, n, "revisit", 2, True): 1, (2, n, "response", None, True): 2, (3, 1, "response", None, True): 2, (None, 0, "response", None, True): 1}


def test_repeated_rows_are_shared_out(spark):
    words = lambda k: " ".join(["w"] * k)
    rows = [(None, words(10), "hot")] * 400 + [(i, words(10 + i % 3), "b") for i in range(60)] + [(7, words(25), "c")] * 33 + [(8, words(40), None)] * 5 + [(9, "", "c")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("more", F.lit(1)).withColumn("_row", F.lit("x")).repartition(5)
    got = mixing.mix_to_targets(docs).collect()
    assert len(got) == len(rows)
    largest = {"hot": 10, "b": 12, "c": 25, None: 40}
    for source in largest:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) < largest[source], source
        assert all(r.taken == r.copies * r.size and r.taken <= 3 * r.size for r in own)
        assert max(r.copies for r in own if r.size) - min(r.copies for r in own if r.size) <= 1
    again = mixing.mix_to_targets(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("words", [1, 2, 3, 4, 6, 8])
def test_short_lines_with_one_changed_letter_go(spark, words):
    rnd = random.Random(words)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    first = [[word(7) for _ in range(words)] for _ in range(40)]
    again = [list(w) for w in first]
    for w in again:
        k, i = rnd.randrange(words), rnd.randrange(7)
        w[k] = w[k][:i] + "0" + w[k][i + 1 :]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(first + again)], "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.dedup_lines(d).where("n_removed = 1").collect()}
    assert got <= set(range(40, 80)) and len(got) >= 36


def test_one_very_long_word_is_a_line_like_others(spark):
    long = "ab0" * 200_000
    d = spark.createDataFrame([(0, long), (1, long.upper()), (2, "b" + long), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(d).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0}
