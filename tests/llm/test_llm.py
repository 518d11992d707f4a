"""The training-data operators against brute force, and on nulls, empty and repeated rows, ties and clashing columns."""

import gzip
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_rules, repeat_index, secret_scan, tool_calls, url_lists, warc
from vantage.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, **more):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, h long").repartition(3)


def odd(spark):
    """Nulls, empty and blank texts, repeated rows; columns that clash with names used inside."""
    rows = [(1, None, "a", 1), (2, "", None, 2), (3, " \n\t ", "a", 3), (4, "one two three four five six seven", "b", 4), (4, "one two three four five six seven", "b", 4), (5, "one two three four five six seven", "b", 5), (None, "x" * 1000, "c", 6), (6, "x" * 1000, None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id long").withColumn("rid", F.lit(1)).withColumn("size", F.lit("z"))


OPS = {
    "mix": lambda d: mixing.mix_to_targets(d),
    "repeats": lambda d: repeat_index.remove_repeats(d),
    "lines": lambda d: line_dedup.dedup_lines(d),
    "quality": lambda d: quality_rules.host_level_rules(d),
    "join": lambda d: jaccard_join.link_similar(d),
    "secrets": lambda d: secret_scan.link_credentials(d),
}


@pytest.mark.parametrize("name", OPS)
def test_odd_rows_and_empty_tables(spark, name):
    d = odd(spark)
    assert OPS[name](d).count() == d.count()
    assert OPS[name](d.limit(0)).count() == 0


def test_leaks_odd(spark):
    d, b = odd(spark), spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect())
    assert got == [(4, 1), (5, 1)]
    assert decontaminate.find_leaks(d.limit(0), b).count() == 0
    assert decontaminate.find_leaks(d, b.limit(0)).count() == 0


def test_leaks_with_other_slots(spark):
    item = "A train from Paris runs 120 km in 2 hours and then another 120 km so how fast is the train"
    same = item.replace("120", "90").replace("Paris", "Lyon")
    mixed = item.replace("120 km in", "90 km in")
    d = spark.createDataFrame([(1, "intro words here " + item), (2, same + " and more"), (3, mixed), (4, "a plane from nowhere flies over the hills and far away for a long time")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(d, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and not got[1].reparameterised and got[2].reparameterised


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_mixing_targets(spark):
    rnd = random.Random(2)
    d = spark.createDataFrame([(i, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 90))), f"s{min(rnd.randrange(9), 5)}") for i in range(900)], "doc_id long, text string, source string")
    out = mixing.mix_to_targets(d, fan_in=8).toPandas()
    again = mixing.mix_to_targets(d.repartition(5), fan_in=8).toPandas()
    assert sorted(map(tuple, out.values)) == sorted(map(tuple, again.values))
    sizes = out.groupby("source")["size"].sum().sort_index()
    weights = dict(zip(sizes.index, itertools.cycle((5, 2, 1))))
    level_left, open_, target = float(sizes.sum()), set(sizes.index), {}
    while True:
        share = {s: level_left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        level_left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    for s, rows in out.groupby("source"):
        assert rows["target"].iloc[0] == pytest.approx(target[s])
        assert abs(rows["taken"].sum() - target[s]) <= rows["size"].max()
    assert (out["taken"] <= 3 * out["size"]).all()


def test_repeats_against_brute_force(spark):
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefgh é") for _ in range(1500))
    texts = []
    for _ in range(30):
        a, n = rnd.randrange(0, 1200), rnd.choice([30, 39, 40, 41, 80, 200])
        texts.append("".join(rnd.choice("xyz ") for _ in range(rnd.randrange(0, 60))) + base[a : a + n] + "".join(rnd.choice("uvw") for _ in range(rnd.randrange(0, 30))))
    texts += ["a" * 500, "a" * 39, "ab" * 100, "", texts[0], "\0" * 90]
    data = [t.encode() for t in texts]
    counts = Counter(t[i : i + 40] for t in data for i in range(len(t) - 39))
    for part in (4096, 3):
        got = {r.doc_id: r for r in repeat_index.remove_repeats(docs(spark, texts), length=40, gram=8, part_slices=part, shard_bytes=2000).collect()}
        for k, t in enumerate(data):
            gone = np.zeros(len(t), bool)
            for i in range(len(t) - 39):
                if counts[t[i : i + 40]] > 1:
                    gone[i : i + 40] = True
            kept = bytes(np.frombuffer(t, np.uint8)[~gone])
            spans = int((np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1).sum())
            assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_join_against_brute_force(spark):
    rnd = random.Random(3)
    vocabulary, texts = [f"w{i}" for i in range(300)], []
    for _ in range(4):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 4, 20, 60, 200]))]
        for _ in range(20):
            b = list(base)
            for _ in range(rnd.randrange(0, 4)):
                b[rnd.randrange(len(b))] = rnd.choice(vocabulary)
            texts.append(" ".join(b))
    texts += ["", None, "A b", "a B", "x"]
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    for part, best in ((2048, 4), (5, 1)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_similar(docs(spark, texts), n=4, percent=85, part_rows=part, best=best).collect()}
        assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_join_by_links_of_the_last_round(spark):
    """The first two texts link, but either has more than four partners that look nearer by their bitmaps and do not link."""
    rnd = random.Random(1)
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    core = words("c", 356)
    texts = [core + words("p", 44), core + words("q", 44)]
    texts += [rnd.sample(core, 351) + rnd.sample(words("f", 160), 40) for _ in range(60)] + [core + rnd.sample(words("g", 200), 50) for _ in range(60)]
    sets = [set(t) for t in texts]
    assert [b for b in range(1, 122) if 100 * len(sets[0] & sets[b]) >= 80 * len(sets[0] | sets[b])] == [1]
    assert [a for a in range(2, 122) if 100 * len(sets[a] & sets[1]) >= 80 * len(sets[a] | sets[1])] == []
    got = {r.doc_id: r.component_id for r in jaccard_join.link_similar(docs(spark, [" ".join(t) for t in texts]).coalesce(1), n=1).collect()}
    assert got[0] == got[1] == 0 and 0 not in {got[i] for i in range(2, 122)}


def test_lines(spark):
    line = "the quick brown fox jumps over the lazy dog near the old river bank and then it sleeps until morning comes again"
    near = line.replace("sleeps", "sleepz")
    texts = [line + "\nshort one", line.upper() + "!\nshort one", "other words that do not repeat anywhere in here\n" + near, None, ""]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[1].text == "" and (got[1].n_lines, got[1].n_removed) == (2, 2)
    assert got[2].n_removed == 1 and got[3].text is None and got[4].text == ""


def test_lines_with_changed_words_go(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    first = [[word() for _ in range(n)] for n in (12, 20, 20, 50, 50)]
    again = [list(w) for w in first]
    for w, changed in zip(again, (1, 1, 2, 1, 4), strict=True):
        for i in range(changed):
            w[3 + 5 * i] = word()
    other = [[word() for _ in range(20)]]
    texts = ["\n".join(" ".join(w) for w in lines) for lines in (first, again + other)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0].n_removed == 0 and (got[1].n_removed, got[1].text) == (5, " ".join(other[0]))


def test_quality_counts(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["a", "b", "cé", "#d", "\n", "x y"]) for _ in range(rnd.randrange(0, 120))) for _ in range(40)] + [None, "a\na\n a\na", "a b c a b c a b"]
    got = {r.doc_id: r for r in quality_rules.host_level_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        tri = defaultdict(list)
        for k in range(len(w) - 2):
            tri[tuple(w[k : k + 3])].append(k)
        again = {k + j for v in tri.values() if len(v) > 1 for k in v for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_secrets_base(spark):
    texts = ['x token = "abcdef123" y', "é PASSWORD:short1 api_key='zz' apikey=" + "Q" * 9, "AKIA" + "B" * 16 + " and " + "0123456789abcdef" * 2, "\x01 secret=abcdefgh \x01", None, "deadbeef"]
    patterns = [("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 1), ("access", r"(AKIA[A-Z0-9]+)", 20, 1), ("hex", r"([0-9a-f]+)", 24, 1)]
    got = {r.doc_id: r for r in secret_scan.link_credentials(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, least, g) in enumerate(patterns) for m in re.finditer(p, t or "") if len(m[g]) >= least)
        told = ",".join(f"{patterns[k][0]}:{s}:{e}" for s, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[i].spans == told


def test_secrets_linked(spark):
    key, opaque = "AKIA" + "C" * 16, "Zz9" * 14
    texts = [f"id {key} then {opaque} at https://s3.example.com/x", f"only {opaque} here", f"{key}" + " far" * 200 + f" {opaque}"]
    got = {r.doc_id: r for r in secret_scan.link_credentials(docs(spark, texts)).collect()}
    assert got[0].n_linked == 2 and "opaque:" in got[0].spans and "endpoint:" in got[0].spans
    assert got[1].n_linked == 0 and got[2].n_linked == 0


def test_warc_round_trip(spark):
    big = "<html>é" + "x" * 1200
    pages = spark.createDataFrame([(1, "http://a/", big), (2, "http://b/", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big)], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 6 and all(r.intact for r in got.values())
    assert (got[2].record_type, got[1].record_type, got[1].refers_to, got[None].record_type) == ("response", "revisit", 2, "revisit")
    assert got[1].payload_bytes == len(big.encode()) and got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert got[3].record_type == got[4].record_type == "response" and got[5].payload_bytes == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_members_and_index(spark):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("http://x/").alias("url"), F.repeat(F.col("id").cast("string"), 900).alias("html")).coalesce(1)
    archives = warc.write_archives(pages, archive_bytes=20_000, chunk_bytes=700)
    rows = warc.normalise(archives).orderBy("archive", "record").collect()
    assert len({r.archive for r in rows}) > 1 and len(rows) == 50
    for name, group in itertools.groupby(rows, key=lambda r: r.archive):
        group = list(group)
        whole = b"".join(bytes(r.member) for r in group)
        assert all(gzip.decompress(whole[r.offset : r.offset + r.length]).startswith(b"WARC/1.1") for r in group)
        mono = b"".join(bytes(c.chunk) for c in archives.where(F.col("archive") == name).orderBy("seq").collect())
        assert gzip.decompress(mono) == gzip.decompress(whole)


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [("a", 1, 1, "f", '{"y": 1, "x": "s"}', None), ("b", 1, 2, "f", '{"x": 3, "y": 2}', ["a"]), ("c", 1, 3, "g", "{}", ["b", "a"]), ("d", 1, 4, "f", "nope", ["e"]), ("e", 1, 5, "f", '{"x": "t"}', ["d"]), ("a", 1, 1, "f", '{"y": 1, "x": "s"}', None), (None, 1, 1, "f", "{}", None)],
        "call_id string, conv_id long, turn long, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([("a", "r2"), ("a", "r1"), ("zz", "lost")], "call_id string, content string")
    schemas = spark.createDataFrame([("f", "x", "string", True), ("f", "y", "integer", False)], "name string, param string, type string, required boolean")
    got = {r.call_id: r for r in tool_calls.link_calls(calls, results, schemas).collect()}
    assert set(got) == set("abcde") and (got["a"].n_results, got["a"].result, got["a"].valid) == (2, "r1", True)
    assert got["a"].canonical == '{"arguments":{"x":"s","y":1},"id":"a","name":"f"}'
    assert got["b"].errors == "type:x" and got["c"].errors == "tool" and [got[k].level for k in "abc"] == [0, 1, 2]
    assert got["d"].errors == "cycle,json" and got["e"].level is None
    assert tool_calls.link_calls(calls.limit(0), results, schemas).count() == 0


def test_url_lists(spark):
    captures = spark.createDataFrame([(1, "http://a.b.com/x", 5), (2, "http://A.b.com/x", 15), (3, "http://c.com", 25), (4, None, 5), (5, "nonsense", 5), (2, "http://A.b.com/x", 15), (6, "http://c.com", None)], "page_id long, url string, fetched long")
    entries = spark.createDataFrame([("host:a.b.com", 5, "add"), ("host:a.b.com", 10, "remove"), ("domain:b.com", 12, "add"), ("domain:com", 20, "add"), ("domain:com", 25, "remove"), ("domain:com", 25, "add"), (None, 1, "add")], "list_key string, at long, action string")
    got = sorted((r.page_id, r.rules, r.blocked) for r in url_lists.filter_captures(captures, entries, width=7).collect())
    assert got == [(1, "host:a.b.com", True), (2, "domain:b.com", True), (2, "domain:b.com", True), (3, "domain:com", True), (4, "", False), (5, "", False), (6, "", False)]
    assert url_lists.filter_captures(captures, entries.limit(0)).where("blocked").count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    assert len(corpus_pipeline.STAGES) == 5
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert 0 < len(out) < rows.count() and out["doc_id"].is_unique and (out["copies"] > 0).all()
    leaks = decontaminate.find_leaks(rows, spark.read.parquet(f"{sf}/benchmark.parquet")).toPandas()
    assert not set(out["doc_id"]) & set(leaks["doc_id"])


def test_pipeline_stages_tell_rows_apart(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, base), (1, "unique " + " ".join(f"u{i}" for i in range(60))), (2, base + " tail"), (None, base + " end"), (3, None), (4, ""), (4, "")]
    d = spark.createDataFrame([(i, t, "en", "a" if i else None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_row", F.lit(1))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    got = stages["near-duplicate join"](spark, d, str(tmp_path))
    kept = [r.text for r in got.collect()]
    assert sum(t is not None and t.startswith(base) for t in kept) == 1 and sum((t or "").startswith("unique") for t in kept) == 1
    assert kept.count(None) == 1 and kept.count("") == 1
    assert stages["benchmark decontamination"](spark, d, str(tmp_path)).count() == 6
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS


def _edit(a, b, most):
    """Edit distance of two strings, or most + 1."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def test_lines_recall_against_all_pairs(spark):
    """Of the groups that edit similarity of all pairs makes, at least nine tenths of the lines to go do go."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    lines = []
    for _ in range(90):
        first = [word() for _ in range(rnd.choice([5, 8, 11, 15, 30, 50]))]
        lines.append(" ".join(first))
        for _ in range(rnd.randrange(0, 4)):
            w = list(first)
            for _ in range(rnd.randrange(1, 1 + max(1, len(w) // 10))):
                k = rnd.randrange(len(w))
                w[k : k + 1] = rnd.choice([[], [word()], [w[k], word()], [w[k] + "s"]])
            lines.append(" ".join(w))
    rnd.shuffle(lines)
    near = {i: i for i in range(len(lines))}

    def find(x):
        while near[x] != x:
            x = near[x]
        return x

    for a, b in itertools.combinations(range(len(lines)), 2):
        long = max(len(lines[a]), len(lines[b]))
        if min(len(lines[a]), len(lines[b])) >= 0.8 * long and find(a) != find(b) and _edit(lines[a], lines[b], int(0.2 * long + 1e-9)) <= 0.2 * long + 1e-9:
            a, b = find(a), find(b)
            near[max(a, b)] = min(a, b)
    want = {i for i in range(len(lines)) if find(i) != i}
    got = {r.doc_id for r in line_dedup.dedup_lines(docs(spark, lines)).where("n_removed = 1").collect()}
    assert len(want) > 50 and got <= want and len(got) >= 0.9 * len(want)


def test_lines_hot_block_very_long_and_clashing_names(spark):
    shared = " ".join(f"common{i}" for i in range(12))
    rnd = random.Random(9)
    far = [shared + " " + " ".join(f"x{rnd.randrange(10**6)}" for _ in range(rnd.choice([20, 40]))) for _ in range(60)]
    long = " ".join(f"v{rnd.randrange(10**6)}" for _ in range(30_000))
    d = docs(spark, [*far, long, long.replace(" v1", " z1", 3), "ok", "OK!"]).withColumn("row", F.lit("r")).withColumn("lines", F.lit("l")).withColumn("gone", F.lit("g")).withColumn("rid", F.lit("d"))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert sorted(i for i in got if got[i].n_removed) == [61, 63]
    assert all((r.row, r.lines, r.gone, r.rid) == ("r", "l", "g", "d") for r in got.values())


def test_host_verdicts_against_brute_force(spark):
    rnd = random.Random(11)
    rows = [(h, rnd.random() < p) for h, p, n in (("a", 0.6, 60), ("b", 0.1, 80), (None, 0.15, 50), ("d", 0.9, 2), ("e", 0.1, 200)) for _ in range(n)]
    df = spark.createDataFrame(rows, "host string, bad boolean")
    got = {r.host: r for r in quality_rules.host_verdicts(df, "host", {"r": F.col("bad")}, ratio=1.5).collect()}
    n, k = Counter(h for h, _ in rows), Counter(h for h, b in rows if b)
    total = len(rows)
    m = sum(k.values()) / total
    v = sum(n[h] * (k[h] / n[h]) ** 2 for h in n) / total - m * m
    between = max(v - m * (1 - m) / (len(n) / sum(1 / x for x in n.values())), 0)
    strength = m * (1 - m) / between - 1
    for h in n:
        shrunk = (k[h] + m * strength) / (n[h] + strength)
        assert got[h].shrunk == pytest.approx(shrunk) and got[h].bad == (shrunk > 1.5 * m)
    same = quality_rules.host_verdicts(spark.createDataFrame([("a", True), ("b", True)], "host string, bad boolean"), "host", {"r": F.col("bad")})
    assert not any(r.bad for r in same.collect())


def test_host_verdict_drops_soft_failures_only(spark):
    rnd = random.Random(12)
    clean = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(80))
    noisy = lambda: clean() + " # # # # # # # # # #"
    rows = [(i, noisy() if i % 2 else clean(), "bad") for i in range(40)] + [(100 + i, noisy() if i == 0 else clean(), "good") for i in range(60)]
    got = {r.doc_id: r for r in quality_rules.host_level_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept == (i % 2 == 0) and got[i].bad_rules == "symbols" for i in range(40))
    assert all(got[100 + i].kept for i in range(60))


def test_secrets_linked_against_brute_force(spark):
    rnd, scope = random.Random(13), 40
    pieces = ["AKIA" + "D" * 16, "token=abcdef123", "0123456789abcdef" * 2, "Zz9" * 12, "https://h.example/p", "https://h.example/cb?token=abcdef123456", "https://h.example/" + "Q7w" * 14]
    texts = [" ".join(rnd.choice([*pieces, "word", "a much longer run of plain words here"]) for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    got = {r.doc_id: r for r in secret_scan.link_credentials(docs(spark, texts), scope=scope).collect()}
    patterns = {"assign": secret_scan.ASSIGN, "access": secret_scan.ACCESS, "hex": secret_scan.HEX, "opaque": secret_scan.OPAQUE, "endpoint": secret_scan.ENDPOINT}
    for i, t in enumerate(texts):
        found = {k: [(m.start(), m.end()) for m in re.finditer(p, t) if k != "assign" or len(m[2]) >= 6] for k, p in patterns.items()}
        apart = lambda x, y: x[0] >= y[1] or x[1] <= y[0]
        strong = [x for k in ("assign", "access", "hex") for x in found[k]]
        for k in ("opaque", "endpoint"):
            found[k] = [x for x in found[k] if all(apart(x, y) for y in strong)]
        near = lambda x, *kinds: any(apart(x, y) and y[0] <= x[1] + scope and y[1] >= x[0] - scope for k in kinds for y in found[k])  # noqa: E731, B023
        more = [("opaque", x) for x in found["opaque"] if near(x, "access") or (near(x, "endpoint") and near(x, "assign"))]
        more += [("endpoint", x) for x in found["endpoint"] if near(x, "access") and near(x, "assign", "hex", "opaque")]
        kinds = list(secret_scan.KINDS)
        spans = sorted([(x[0], kinds.index(k), x[1]) for k in kinds[:3] for x in found[k]] + [(x[0], kinds.index(k), x[1]) for k, x in more])
        assert got[i].spans == ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans), t
    assert any(r.n_linked for r in got.values())


def test_tool_arguments_are_checked_as_values(spark):
    calls = [("a", '{"o":{"x":"s"},"x":3}'), ("b", '{"x":"s","o":{"k":[1]}}'), ("c", '{"x":null}'), ('d"q', '{"x":"a\\"b","n":1.5,"l":[],"b":true}'), ("e", '{"x":"s","a.b":1}')]
    rows = spark.createDataFrame([(i, 1, k, "f", a, None) for k, (i, a) in enumerate(calls)], "call_id string, conv_id long, turn long, name string, arguments string, depends_on array<string>")
    schemas = spark.createDataFrame([("f", "x", "string", True), ("f", "o", "object", False), ("f", "n", "number", False), ("f", "l", "array", False), ("f", "b", "boolean", False), ("f", "a.b", "mystery", False)], "name string, param string, type string, required boolean")
    got = {r.call_id: r for r in tool_calls.link_calls(rows, spark.createDataFrame([], "call_id string, content string"), schemas).collect()}
    assert {k: r.errors for k, r in got.items()} == {"a": "type:x", "b": "", "c": "type:x", 'd"q': "", "e": "type:a.b"}
    import json

    assert json.loads(got['d"q'].canonical) == {"arguments": {"x": 'a"b', "n": 1.5, "l": [], "b": True}, "id": 'd"q', "name": "f"}


def test_leaks_short_items_names_and_odd_slots(spark):
    items = [(1, "solve this quickly please"), (2, "Поезд из Москва едет быстро до станции и стоит там долго"), (3, "A letter from Anna Maria reached the small town by the sea after nine long days of rain")]
    texts = [(1, "so now solve this quickly please and go on"), (2, items[1][1].replace("Москва", "Казань")), (3, items[2][1].replace("Anna Maria", "Bob")), (4, "solve that quickly please")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3)} and got[2, 2].reparameterised and got[3, 3].reparameterised
    words = [f"word{i}" for i in range(60)]
    item = " ".join([*words[:10], "Paris", *words[10:50], "Paris", *words[50:]])
    text = item.replace("Paris word50", "Lyon word50")
    one = decontaminate.find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert len(one) == 1 and 0.8 <= one[0].coverage < 1
