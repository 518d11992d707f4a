"""Whitening, quality trees and fill-in-middle against plain loops, and on odd rows by value."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.llm import fill_middle, hashing, quality_trees, queries, whitening

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, component string, x int"


def whitened_by_hand(vectors, components=16):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    z = ((n * x - sums) / n) @ axes[:, :k] / np.sqrt(e[:k])
    return n, ((n * x - sums) ** 2).sum(axis=1), z, e[:k] / e.sum()


def test_whitening_by_hand_with_odd_rows(spark):
    draw = np.random.default_rng(3)
    good = (draw.standard_normal((60, 9)) * np.arange(1, 10)).astype(np.float32).tolist()
    rows = [(i, v, "c", 1) for i, v in enumerate(good)]
    rows += [(None, good[0], None, None), (1, good[1], "c", 1), (77, good[2], "c", 1)]  # null key, repeated row, equal vector
    odd = [(80, None, "", 0), (81, [None] + good[0][1:], "", 0), (82, [float("nan")] + good[0][1:], "", 0), (83, [float("inf")] + good[0][1:], "", 0), (84, [], "", 0), (85, [1.0], "", 0), (86, [3e38] + good[0][1:], "", 0)]
    out = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(5)).toPandas()
    n, deviation, z, share = whitened_by_hand(good)
    assert len(out) == 63 * 9 and set(out["n"]) == {60} and out["identity_error"].max() < 1e-10
    assert np.abs(out.groupby("component")["explained"].first().to_numpy() / share - 1).max() < 1e-9
    by = {i: g.sort_values("component") for i, g in out[out.vec_id.notna()].drop_duplicates(["vec_id", "component"]).groupby("vec_id")}
    got = np.array([by[i]["whitened"] for i in range(60)])
    assert np.abs(got * np.sign((got * z).sum(axis=0)) - z).max() < 1e-9
    assert [int(by[i]["deviation"].iloc[0]) for i in range(60)] == deviation.tolist()
    null = out[out.vec_id.isna()].sort_values("component")["whitened"].to_numpy()
    assert np.allclose(null, by[0]["whitened"], rtol=1e-12) and np.allclose(by[77]["whitened"], by[2]["whitened"], rtol=1e-12)


def test_equal_eigenvalues_keep_all_their_vectors(spark):
    corners = [[s if j == i else 0.0 for j in range(6)] for i in range(6) for s in (-2.0, 2.0)]
    flat = [v + [1.0, 1.0] for v in corners]  # two directions along which all agree
    out = whitening.whiten(spark.createDataFrame([(i, v, "", 0) for i, v in enumerate(flat)], VECTORS)).toPandas()
    z = out.sort_values(["vec_id", "component"])["whitened"].to_numpy().reshape(12, -1)
    assert z.shape[1] == 6 and np.abs(z.T @ z / 12 - np.eye(6)).max() < 1e-9 and np.abs(z.mean(axis=0)).max() < 1e-9
    assert np.allclose(out["explained"], 1 / 6)


def test_components_of_a_steep_spectrum_and_few_steps(spark):
    draw = np.random.default_rng(5)
    v = (draw.standard_normal((400, 24)) * 0.5 ** np.arange(24) * 512).tolist()
    df = spark.createDataFrame([(i, x, "", 0) for i, x in enumerate(v)], VECTORS)
    n, _, z, share = whitened_by_hand(v, 5)
    out = whitening.whiten(df, components=5, steps=16).toPandas().sort_values(["vec_id", "component"])
    got = out["whitened"].to_numpy().reshape(400, 5)
    assert np.abs(got * np.sign((got * z).sum(axis=0)) - z).max() < 1e-6 and out["identity_error"].max() < 1e-6


def test_deviations_beyond_a_long_are_null(spark):
    rows = [(0, [1e12, 0.0], "", 0), (1, [-1e12, 1.0], "", 0), (2, [0.0, 5.0], "", 0)]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS)).toPandas()
    assert sorted(out["vec_id"]) == [0, 1, 2]  # beside so wide a direction the other one is null
    assert out[out.vec_id == 0]["deviation"].isna().all() and out[out.vec_id == 2]["deviation"].notna().all()


def test_one_vector_and_no_vectors_have_no_components(spark):
    assert whitening.whiten(spark.createDataFrame([(0, [1.0, 2.0], "", 0), (1, [1.0, 2.0], "", 0)], VECTORS)).count() == 0
    empty = whitening.whiten(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "component", "n"]


def test_op11_on_the_given_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    n, deviation, z, share = whitened_by_hand(rows["embedding"].tolist())
    out = queries.op11_whiten_embeddings(spark, SF).toPandas().set_index("vec_id")
    got = np.array([out.loc[i].sort_values("component")["whitened"] for i in rows["vec_id"]])
    assert np.abs(got * np.sign((got * z).sum(axis=0)) - z).max() < 1e-8 and out["identity_error"].max() < 1e-4
    assert [int(out.loc[i, "deviation"].iloc[0]) for i in rows["vec_id"]] == deviation.tolist()


# Quality trees.

TEXTS = ["", "one", "Aa bb.\naa bb.\nAa bb.\n", "x | y | z #tag $5\n\n\n", "Ärger über Öl äöü. Was? Ja!", "a" * 40 + " " + "b" * 3, "the the the the cat\nthe the\n", " \t\n ", "ends without newline\nthe same\nthe same"]


def stats_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x]
    pairs = list(zip(words, words[1:], strict=False))
    count = lambda xs: {x: xs.count(x) for x in xs}
    again = lambda xs: sum(c - 1 for c in count(xs).values())
    per = lambda a, b: a / max(b, 1)
    mean = per(sum(map(len, words)), len(words))
    chars = lambda rule: per(sum(1 for c in text if re.match(rule, c)), len(text))
    return {
        "n_words": len(words), "n_chars": len(text), "n_lines": len(lines), "word_length": mean, "letters": chars("[A-Za-z]"), "capitals": chars("[A-Z]"), "digits": chars("[0-9]"), "bars": chars(r"\|"), "points": chars("[.!?]"),
        "spaces": chars(r"[\x20\x09-\x0D]"), "words_per_line": per(len(words), len(lines)), "distinct_words": per(len(set(words)), len(words)), "top_word": per(max(count(words).values(), default=0), len(words)),
        "repeated_pairs": per(again(pairs), len(words)), "distinct_pairs": per(len(set(pairs)), len(words)), "repeated_lines": per(again(lines), len(lines)), "short_words": per(sum(len(w) <= 3 for w in words), len(words)), "long_words": per(sum(len(w) >= 12 for w in words), len(words)),
        "word_length_spread": per(sum((len(w) - mean) ** 2 for w in words), len(words)) ** 0.5, "symbol_words": per(sum(bool(re.search(r"[#*$%&<>@^~_={}\[\]\\|]", w)) for w in words), len(words)),
    }


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)


def test_statistics_by_hand():
    texts = TEXTS + [" ".join(f"w{i % 7}" for i in range(300)) + "\n" + "x" * 3]
    got = quality_trees.statistics(*packed(texts))
    assert got.shape == (len(texts), len(quality_trees.STATISTICS)) and np.isfinite(got).all()
    for row, text in zip(got, texts, strict=True):
        for name, value in stats_by_hand(text).items():
            assert row[quality_trees.STATISTICS.index(name)] == pytest.approx(value, rel=1e-5, abs=1e-6), (name, text)


def test_statistics_of_texts_in_pieces(monkeypatch):
    texts = ["alpha beta gamma delta " * 50, "x" * 500, "one two", "", "ü" * 90 + " ende"]
    whole = quality_trees.statistics(*packed(texts))
    monkeypatch.setattr(quality_trees, "PIECE", 64)
    parts = quality_trees.statistics(*packed(texts))
    plain = [quality_trees.STATISTICS.index(c) for c in ("n_words", "n_chars", "word_length", "letters", "distinct_words", "top_word", "symbol_words", "long_words")]
    assert np.allclose(whole[:, plain], parts[:, plain])


def test_first_split_is_the_best_of_all(spark):
    draw = np.random.default_rng(2)
    k = len(quality_trees.STATISTICS)
    values = draw.integers(0, 12, (400, k)).astype(np.float32)
    label = ((values[:, 5] > 6) ^ (draw.random(400) < 0.1)).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(y)) for v, y in zip(values, label, strict=True)], "statistics array<float>, label int")
    model = quality_trees.fit_trees(rows, trees=1, depth=1, least=0.0, rate=1.0)
    p = 1 / (1 + np.exp(-model.base))
    g, s = label - p, p * (1 - p)
    best = max(((side := values[:, f] <= t), sum(g[m].sum() ** 2 / (s * m.sum() + 1) for m in (side, ~side)), f, t)[1:] for f in range(k) for t in range(12))
    assert (model.feature[0, 0], model.edges[model.feature[0, 0]][model.bin[0, 0]]) == best[1:]
    left = values[:, best[1]] <= best[2]
    assert model.leaf[0] == pytest.approx([g[left].sum() / (s * left.sum() + 1), g[~left].sum() / (s * (~left).sum() + 1)], rel=1e-5)


def test_flat_traversal_equals_walking_the_nodes():
    draw = np.random.default_rng(4)
    k = len(quality_trees.STATISTICS)
    edges = [np.arange(10, dtype=np.float32)] * k
    model = quality_trees.Trees(edges, 0.25, 3, draw.integers(0, k, (5, 7)), draw.integers(0, 11, (5, 7)), draw.standard_normal((5, 8)))
    values = draw.uniform(-1, 11, (50, k)).astype(np.float32)
    bins = model.bins(values)
    for row, got in zip(bins, model.margins(bins), strict=True):
        total = model.base
        for t in range(5):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + (row[model.feature[t, node]] > model.bin[t, node])
            total += model.leaf[t, node - 7]
        assert got == pytest.approx(total)


def small_corpus(spark, n=400):
    text = lambda i: " ".join(f"{'%%#' if i % 4 == 0 else ''}word{(i * 7 + j) % 50}" for j in range(30 + i % 17))
    docs = spark.createDataFrame([(i, text(i), "s", "t", 1) for i in range(n)], "doc_id long, text string, source string, statistics string, label int")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, n, 2)], "doc_id long, quality int")
    return docs, labels


def test_scores_do_not_see_held_out_labels_and_reruns_agree(spark):
    docs, labels = small_corpus(spark)
    fit = {"trees": 3, "depth": 2, "least": 0.5}
    first = quality_trees.score_quality(docs, labels, **fit).toPandas().sort_values("doc_id")
    held = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert set(first[first.held_out]["doc_id"]) == held and len(first) == 400
    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin(sorted(held)), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality_trees.score_quality(docs.repartition(7), turned.union(labels.where(~F.col("doc_id").isin(sorted(held)))), **fit).toPandas().sort_values("doc_id")
    assert first["score"].tolist() == other["score"].tolist()
    assert ((first["score"] >= 0.3).astype(int) == first["predicted"]).all() and (first["predicted"] == (first["doc_id"] % 4 != 0)).mean() > 0.95


def test_scores_of_odd_rows(spark):
    docs, labels = small_corpus(spark, 60)
    odd = spark.createDataFrame([(None, None, None, None, None), (900, None, "s", "", 0), (901, "", "s", "", 0), (901, "", "s", "", 0), (902, "long words " * 400_000, "s", "", 0)], docs.schema)
    some = labels.union(spark.createDataFrame([(None, 1), (2, None), (4, 7), (9999, 1)], labels.schema))
    out = quality_trees.score_quality(docs.union(odd), some, trees=2, depth=2, least=0.5).toPandas()
    assert len(out) == 65 and out["score"].between(0, 1).all() and out[out.doc_id.isna()]["held_out"].all()
    assert out[out.doc_id.isin([900, 901])]["score"].nunique() == 1
    none = quality_trees.score_quality(docs, labels.where("false"), trees=2).toPandas()
    assert (none["score"] == 0.5).all() and (none["predicted"] == 1).all()
    ones = quality_trees.score_quality(docs, labels.where("quality = 1"), trees=2).toPandas()
    assert (ones["score"] > 0.9).all()
    assert quality_trees.score_quality(docs.where("false"), labels, trees=2).count() == 0


def test_a_bounded_fit_keeps_its_accuracy(spark):
    docs, labels = small_corpus(spark)
    out = quality_trees.score_quality(docs, labels, fit_rows=60, trees=3, depth=2, least=0.5).toPandas()
    assert len(out) == 400 and (out["predicted"] == (out["doc_id"] % 4 != 0)).mean() > 0.95


def test_op12_on_held_out_rows(spark):
    out = queries.op12_quality_trees(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = out[out.held_out]
    good, bad = held[held.quality == 1]["score"].to_numpy(), held[held.quality == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2 > 0.95
    assert (held["predicted"] == held["quality"]).mean() > 0.95


# Fill-in-middle.


def rewritten_by_hand(doc_id, text, seed="7"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    draw = np.random.default_rng(8)
    lines = ["".join(draw.choice(list("ab <SPM>üñ€𝄞"), draw.integers(0, 90))) for _ in range(3000)]
    clean = [x.replace(">", "}") for x in lines]
    long = "\n".join(clean)
    out = [None, "", "\n", "\n\n", "one", "one\n", "two\nlines", "<P>", "a<S", "<", "<M> inside", "x" * 100_000, "é" * 40_000 + "\n" + "é" * 9, long, long * 30, "n" * 32767 + "<P>", "n" * 32766 + "<P>" + "y", "n" * 32768 + "<P>"]
    return out + ["\n".join(clean[i : i + 40]) + "\n" * (i % 3) for i in range(0, 2000, 40)] + ["\n".join(lines[:50])] + [clean[7]] * 3


def test_rewriting_by_hand(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(odd_texts())] + [(None, "no id\nat all\n", "x", 0)] + [(3, "\n\n", "x", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    out = fill_middle.rewrite(docs)
    got = sorted((repr(r[0]), *r[1:]) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256), F.sha2(fill_middle.restore(F.col("output"), F.col("form")).cast("binary"), 256)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        n, form, p, m, output = rewritten_by_hand(i, t)
        want.append((repr(i), n, form, p, m, sha(output), sha(t or "")))
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert fill_middle.rewrite(docs.where("false")).count() == 0


def test_equal_passages_share_chunks_wherever_they_stand():
    draw = np.random.default_rng(1)
    passage = draw.integers(32, 127, 60_000, np.uint8)
    memory = fill_middle.Memory()
    fill_middle.Located(passage, memory)
    misses = memory.misses
    fill_middle.Located(np.concatenate([draw.integers(32, 127, 777, np.uint8), passage]), memory)
    assert misses > 30 and memory.misses - misses <= 4 and memory.hits >= misses - 3


def test_forgotten_chunks_change_nothing_and_memory_is_bounded():
    texts = [t.encode() for t in odd_texts() if t]
    small = fill_middle.Memory(5000)
    for raw in texts:
        data = np.frombuffer(raw, np.uint8)
        a, b = fill_middle.Located(data, fill_middle.Memory()), fill_middle.Located(data, small)
        assert (a.n, a.marked, [a.cut(k) for k in range(0, a.n + 1, 97)]) == (b.n, b.marked, [b.cut(k) for k in range(0, b.n + 1, 97)])
        assert small.held <= 5000 or len(small.known) == 1


def test_chunks_do_not_depend_on_the_stretch_hashed_at_once(monkeypatch):
    data = np.random.default_rng(6).integers(0, 255, 50_000, np.uint8)
    whole = fill_middle.chunks(data).tolist()
    monkeypatch.setattr(hashing, "CHUNK", 4096)
    assert fill_middle.chunks(data).tolist() == whole and whole[-1] == 50_000


def test_other_rates(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb\nc") for i in range(300)], "doc_id long, text string")
    forms = lambda **x: fill_middle.rewrite(docs, **x).groupBy("form").count().rdd.collectAsMap()
    assert forms(rate=0) == {"plain": 300} and forms(spm_rate=0) == {"psm": 300} and set(forms(rate=50)) == {"plain", "psm", "spm"}
