"""Operators 9 and 13: how many edges components are made of, and how often they are joined."""

from __future__ import annotations

import random

from loomatrix.llm import minhash, simhash


def test_edges_of_near_copies(spark, monkeypatch):
    """Copies of an original that isn't there share many buckets; a task connects each of them once, not in each bucket."""
    dice, seen, real = random.Random(9), [], minhash.components
    rows = []
    for k in range(200):
        words = [f"b{n}" for n in range(150)]
        for at in dice.sample(range(150), dice.choice([2, 3, 4])):
            words[at] = f"w{dice.randrange(10**6)}"
        rows.append((k, " ".join(words)))

    def counted(edges):
        ends = edges.select("a").union(edges.select("b")).distinct().count()
        seen.append((edges.count(), ends))
        return real(edges)

    monkeypatch.setattr(minhash, "components", counted)
    minhash.minhash_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert seen[0][1] > 100 and seen[0][0] <= 4 * seen[0][1]  # four tasks


def test_edges_are_joined_once(spark, monkeypatch):
    """A round's table is written before it is read again, else all edges would be joined for each reading."""
    plans, real = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 60)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(31)} | {50: 50, 60: 50}
    assert max(p.count("Join Inner") for p in plans) <= 1
