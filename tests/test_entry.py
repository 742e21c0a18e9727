"""Registered queries against their SQL in DuckDB, and the import guard."""

import os
import pathlib
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

from test_ordering import plain_order

import __spark_entry__
from loomatrix import queries as engine

FOLDER = "/root/testdata/sf0.001"
HERE = pathlib.Path(__spark_entry__.__file__).parent
SAMPLE = ["spmv_coo", "spmv_vector_join", "spmv_sell_c16_s64", "spmmv_colwise_b4", "spmv_power_3", "spmv_ap_dp_sp_hp", "sell_elements", "crs_row_ptrs", "equilibrate", "seg_nnz", "halo_numbering", "row_length_stats", "validate_norms", "matrix_market_round_trip"]


def test_every_query_has_its_sql():
    assert engine.queries().keys() - engine.oracle_sql().keys() == {"rcm_permutation", "rcm_bandwidth", "multilevel_parts"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    got = __spark_entry__.queries()[name](spark, FOLDER)
    db = duckdb.connect()
    for f in os.listdir(FOLDER):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    want = db.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall(), key=repr)


def test_orders_and_parts_of_a_table(spark):
    """Queries that SQL can't express, against plain loops over the whole table."""
    n, pairs = 200, [(r.l_partkey, r.l_suppkey) for r in spark.read.parquet(f"{FOLDER}/lineitem.parquet").collect()]
    assert {r.i_old: r.i_new for r in engine.rcm_permutation(spark, FOLDER).collect()} == plain_order(pairs, n)
    new = plain_order(pairs, n)
    width = lambda some: 1 + max([0, *(i - j for i, j in some)]) + max([0, *(j - i for i, j in some)])
    got = {r.order: r.bandwidth for r in engine.rcm_bandwidth(spark, FOLDER).collect()}
    assert got == {"as given": width(pairs), "reverse Cuthill-McKee": width([(new[i], new[j]) for i, j in pairs])}
    parts = {r.i: r.part for r in engine.multilevel_parts(spark, FOLDER).collect()}
    sizes = [list(parts.values()).count(p) for p in range(engine.PARTS)]
    assert sorted(parts) == list(range(n)) and max(sizes) <= -(-n // engine.PARTS) + 1


def test_nothing_else_imports_the_text_operators():
    for f in (HERE / "loomatrix").rglob("*.py"):
        if "llm" not in f.relative_to(HERE).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f


def test_without_the_text_operators(tmp_path):
    ignore = lambda d, names: [n for n in names if n in ("llm", ".git", "__pycache__", "corpus_pipeline.py")]
    shutil.copytree(HERE, tmp_path / "r", ignore=ignore)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
    assert said.stdout.split() == [str(len(engine.queries())), str(len(engine.oracle_sql()))], said.stderr
