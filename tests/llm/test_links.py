"""Rows that the links of large groups of near copies make on their way to components."""

import random

from pyspark.sql import functions as F

from tidemark.llm import graph, similar


def test_each_round_makes_its_edges_once(spark, monkeypatch):
    made, given, step = spark.sparkContext.accumulator(0), [], graph._large_star

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    def large_star(edges):
        given.append(edges.count())
        return step(edges).mapInArrow(counted, "u long, v long")

    monkeypatch.setattr(graph, "_large_star", large_star)
    pick = random.Random(2)
    edges = [(i, pick.randrange(max(0, i - 9), i)) for i in range(1, 300)] + [(1000 + i, 1000 + i // 2) for i in range(1, 50)] + [(7, 7)]
    got = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert sorted((r["node"], r["root"]) for r in got) == [(i, 0) for i in range(1, 300)] + [(i, 1000) for i in range(1001, 1050)]
    assert len(given) > 1 and made.value == sum(given)
    made.add(-made.value)
    given.clear()
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0 and given == []


def test_later_steps_get_a_component_as_a_tree(spark, monkeypatch):
    pick, given, components = random.Random(8), [], graph.components
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(80):
        copy = list(base)
        for _ in range(pick.choice((1, 2, 3))):
            copy[pick.randrange(200)] = f"edit{pick.random()}"
        texts.append(" ".join(copy))

    def counted(edges):
        given.append(edges.count())
        return components(edges)

    monkeypatch.setattr(similar, "components", counted)
    rows = similar.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows.select("root").distinct().count() == 1 and rows.filter(F.col("root").isNull()).count() == 0
    assert given[0] > 2 * len(texts) and max(given[1:]) < len(texts)
