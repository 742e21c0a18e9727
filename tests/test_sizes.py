"""What a task holds doesn't grow with the table: how entries are dealt before sums."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomatrix.operators import exact, multilevel, ordering, spmv
from loomatrix.plans import tables
from loomatrix.plans.matrix import SparseMatrix

WAYS = {
    "tiled": lambda a, x: spmv.spmmv_tiled(a, x, 5, tile=2),
    "colwise": lambda a, x: spmv.spmmv_colwise(a, x, 5),
    "exact": lambda a, x: exact.spmv_exact(a, x.where("vec = 0").select("i", "x")),
}


@pytest.mark.parametrize("way", WAYS)
def test_sums_are_dealt_by_row(spark, way):
    """Entries come by row before they are summed up; a row with most entries keeps its sum."""
    rows = [(0 if k % 3 else k % 40, k % 17, float(k % 7)) for k in range(900)]
    a = SparseMatrix(spark.createDataFrame(rows, "i bigint, j bigint, v double").repartition(3), 40, 17)
    x = spark.range(17).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("vec")).withColumn("x", (F.col("i") * 3 + F.col("vec")).cast("double"))
    got = WAYS[way](a, x)
    assert "RebalancePartitions" in got._jdf.queryExecution().optimizedPlan().toString()
    want = {(i, vec): 0.0 for i in range(40) for vec in range(5)}
    for i, j, v in rows:
        for vec in range(5):
            want[i, vec] += v * (3 * j + vec)
    assert {(r.i, r.vec if "vec" in r else 0): r.y for r in got.collect()} == {k: y for k, y in want.items() if way != "exact" or k[1] == 0}


def test_links_are_dealt_by_their_number(spark, monkeypatch):
    """More links make more tasks, not larger ones, also where Spark's own number of partitions is small."""
    monkeypatch.setattr(tables, "DEALT_ROWS", 100)
    a = SparseMatrix(spark.createDataFrame([(k, (7 * k + 1) % 1000, 1.0) for k in range(1000)] * 2, "i bigint, j bigint, v double"), 1000, 1000)
    links = ordering.links_of(a)
    assert links.select(F.input_file_name()).distinct().count() >= 30
    pairs = {(k, (7 * k + 1) % 1000) for k in range(1000)}
    assert sorted(map(tuple, links.collect())) == sorted({(x, y) for i, j in pairs if i != j for x, y in ((i, j), (j, i))})


def test_links_are_joined_once(spark, monkeypatch):
    """What a round makes of the links is written before it is read again, else each reading may join all links."""
    plans, real = [], ordering.written
    monkeypatch.setattr(ordering, "written", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    links = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(k + 1, k) for k in range(9)], "i bigint, j bigint")
    assert {r.i: r.component for r in ordering.connected(links).collect()} == {k: 0 for k in range(10)}
    assert max(p.count("Join Inner") for p in plans) <= 1


def test_graph_tables_are_not_broadcast(spark, monkeypatch):
    """Tables with a row for each row of the graph don't go through the driver, however small they are."""
    plans, real = [], multilevel.written
    monkeypatch.setattr(multilevel, "written", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    nodes = spark.createDataFrame([(k, 1) for k in range(8)], "i bigint, w bigint")
    edges = spark.createDataFrame([(k, k ^ 1, 1) for k in range(8)], "i bigint, j bigint, e bigint")
    merged = multilevel._matching(nodes, edges, 4, rounds=1)
    multilevel._coarser(nodes, edges, merged)
    assert {r.i: r.into for r in merged.collect()} == {k: k & ~1 for k in range(8)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
