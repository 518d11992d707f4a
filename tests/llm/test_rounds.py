"""Rounds of connected components: a round is written once, and none only to find that nothing changes."""

import random

import pytest

from vantage.llm import common, jaccard_join


@pytest.fixture
def written(monkeypatch):
    names, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name="stage": names.append(name) or write(df, name))
    return names


def test_stars_take_one_round(spark, written):
    edges = [(leaf, centre) for centre in (0, 100, 200) for leaf in range(centre + 1, centre + 20)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: x // 100 * 100 for e in edges for x in e} and len(written) == 1


def test_components_stand_for_their_links(spark, written):
    rnd = random.Random(3)
    old, new = ([(rnd.randrange(300), rnd.randrange(300)) for _ in range(n)] for n in (150, 40))
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = [(r.node, r.component) for r in common.connected_components(frame(old)).collect()]
    rounds = len(written)
    step = {tuple(r) for r in common.connected_components(frame(first + new)).collect()}
    assert len(written) - rounds <= rounds
    assert step == {tuple(r) for r in common.connected_components(frame(old + new)).collect()} and len(step) > 200
    assert common.connected_components(frame([])).count() == 0


def test_later_rounds_of_the_join_hold_only_classes_with_partners(spark, monkeypatch):
    """Each two texts share a passage, so they meet in cells, and few of them may link: the others go after the first round."""
    tables, write = {}, jaccard_join.materialize

    def kept(df, name="stage"):
        table = write(df, name)
        if name in ("cells", "offered", "tokens"):
            tables.setdefault(name, []).append({r[0] for r in table.select(*(["ck"] if "ck" in table.columns else ["a"])).union(table.select(*(["ck"] if "ck" in table.columns else ["b"]))).collect()})
        return table

    monkeypatch.setattr(jaccard_join, "materialize", kept)
    far = [[f"s{k // 2}_{i}" for i in range(100)] + [f"x{k}_{i}" for i in range(100)] for k in range(60)]
    near = [[f"n{i}" for i in range(100)] + [f"y{k}"] for k in range(3)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(far + near)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.link_similar(frame, n=4, percent=85).collect()}
    assert got == {i: i for i in range(60)} | {i: 60 for i in (60, 61, 62)}
    first, later = tables["cells"]
    assert later == tables["offered"][0] == tables["tokens"][0] and len(later) == 3 and len(first) > 50
