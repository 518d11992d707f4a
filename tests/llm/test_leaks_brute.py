"""Template leaks against a plain loop over all texts, items and windows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from vantage.llm import decontaminate

SF = "/root/testdata/sf0.001"
PUNCT = set(".,;:!?\"'()[]")


def words_of(text):
    """[(kind, literal or slot text)] of a text, by the rules of the docstring of template()."""
    raw = []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        a, b = m.span()
        for _ in range(3):
            b -= b - a > 1 and text[b - 1] in PUNCT
            a += b - a > 1 and text[a] in PUNCT
        raw.append((a, b))
    out, before = [], None
    for a, b in raw:
        w = text[a:b]
        if re.search("[0-9]", w) and re.fullmatch(r"[0-9.,:/\-+%$()]+", w):
            kind = "number"
        elif w.lower() in decontaminate.UNITS and before == "number":
            kind = "unit"
        else:
            kind = "name" if re.match("[A-ZÀ-ÞΆ-ΫА-ЯЀ-Џ]", w) else None
        if kind == "name" and before == "name":
            out[-1] = ("name", out[-1][1], b)
        else:
            out.append((kind, a, b))
        before = kind
    low = lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
    return [(k, (text[a:b].lower() if k else low(text[a:b]))) for k, a, b in out]


def brute(docs, items, n=5, literals=2, share=0.8):
    """{(doc, item): (coverage, reparameterised)}"""
    mask = lambda ws: tuple(k or ("=", w) for k, w in ws)
    usable = lambda ws: sum(k is None for k, _ in ws) >= min(literals, len(ws))
    parsed = {i: words_of(t) for i, t in items if t}
    index, total = defaultdict(set), {}
    for i, ws in parsed.items():
        k = min(n, len(ws))
        mine = [p for p in range(len(ws) - k + 1) if k and usable(ws[p : p + k])]
        total[i] = len(mine)
        for p in mine:
            index[mask(ws[p : p + k])].add((i, p, k))
    widths = sorted({k for v in index.values() for _, _, k in v})
    got = {}
    for d, t in docs:
        ws = words_of(t or "")
        met = defaultdict(list)
        for k in widths:
            for q in range(len(ws) - k + 1):
                for i, p, _ in index.get(mask(ws[q : q + k]), ()):
                    met[i, q - p].append((p, [(a[1], b[1]) for a, b in zip(parsed[i][p : p + k], ws[q : q + k], strict=True) if a[0]]))
        covered, other = defaultdict(set), defaultdict(bool)
        for (i, _), hits in met.items():
            counts = Counter(x for _, pairs in hits for x in pairs)
            best = {}
            for (a, b), c in counts.items():
                best[a] = max(best.get(a, (0, "")), (c, b))
            for p, pairs in hits:
                if all(best[a][1] == b for a, b in pairs):
                    covered[i].add(p)
                    other[i] |= any(a != b for a, b in pairs)
        got.update({(d, i): (len(c) / total[i], other[i]) for i, c in covered.items() if len(c) / total[i] >= share})
    return got


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r.doc_id, r.item_id): (r.coverage, r.reparameterised) for r in decontaminate.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_of_random_texts(spark, seed):
    rnd = random.Random(seed)
    plain = [f"w{c}" for c in "abcdefghij"]
    word = lambda: rnd.choice([rnd.choice(plain), rnd.choice(plain), rnd.choice(plain), str(rnd.randrange(4)), rnd.choice(["km", "Kg"]), rnd.choice(["Ann", "Bob,", "(Él"])])
    items = [(i, " ".join(word() for _ in range(rnd.choice([2, 3, 4, 8, 14, 30])))) for i in range(25)] + [(90, None), (91, ""), (92, "1 2 3 4 5 6")]
    docs = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(rnd.randrange(6)))]
        for _ in range(rnd.randrange(3)):
            own = rnd.choice(items)[1] or ""
            change = {a: rnd.choice(["0", "1", "2", "3", "Ann", "Eve"]) for a in ("0", "1", "2", "3", "Ann")}
            own = [change.get(w, w) if rnd.random() < 0.9 else word() for w in own.split()] if rnd.random() < 0.7 else own.split()
            parts += [" ".join(own), " ".join(word() for _ in range(rnd.randrange(4)))]
        docs.append((d, "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (102, docs[0][1])]
    want = brute(docs, items)
    assert len(want) > 20 and any(r for _, r in want.values()) and not all(r for _, r in want.values())
    assert found(spark, docs, items) == want


def test_leaks_of_whole_tables(spark):
    rows = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*c).collect()]
    docs, items = rows("documents", "doc_id", "text"), rows("benchmark", "item_id", "text")
    assert found(spark, docs, items) == brute(docs, items)
