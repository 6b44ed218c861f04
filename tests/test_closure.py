"""What may be shared, against a walk over the citations."""

import random

import pytest

from tidepool.operators import maintain


def walk(blocked, edges):
    cites, known = {}, set(blocked)
    for i, s in edges:
        cites.setdefault(i, set()).add(s)
    bad = {i for i, b in blocked.items() if b} | {i for i, s in edges if s not in known}
    while more := {i for i, s in edges if s in bad and i not in bad}:
        bad |= more
    return {i: i not in bad for i in known}


def run(spark, blocked, edges):
    nodes = spark.createDataFrame([(i, b) for i, b in blocked.items()], "id long, blocked boolean")
    return {r.id: r.allowed for r in maintain.external_allowed(nodes, spark.createDataFrame(edges, "id long, source long")).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_citations_with_cycles(spark, seed):
    rnd = random.Random(seed)
    n = 120
    blocked = {i: rnd.random() < 0.03 for i in range(n)}
    edges = [(rnd.randrange(n), rnd.randrange(n + (seed == 3))) for _ in range([60, 110, 200, 110][seed])]
    edges += [(i, i) for i in range(0, n, 17)] + [(10, 11), (11, 12), (12, 10)] + edges[:5]
    assert run(spark, blocked, edges) == walk(blocked, edges)


def test_a_chain_of_all_takes_few_rounds(spark, monkeypatch):
    n, cuts, real = 20_000, [], maintain.cut
    monkeypatch.setattr(maintain, "cut", lambda df: cuts.append(1) or real(df))
    nodes = spark.range(n).selectExpr("id", "id = 0 as blocked")
    out = maintain.external_allowed(nodes, spark.range(1, n).selectExpr("id", "id - 1 as source"))
    assert out.where("allowed").count() == 0 and len(cuts) <= 2 * 20


def test_free_cycles_and_empty_tables(spark):
    assert run(spark, {1: False, 2: False, 3: False}, [(1, 2), (2, 3), (3, 1)]) == {1: True, 2: True, 3: True}
    assert run(spark, {1: True, 2: False}, []) == {1: False, 2: True}
    empty = spark.createDataFrame([], "id long, blocked boolean")
    assert maintain.external_allowed(empty, spark.createDataFrame([], "id long, source long")).collect() == []
