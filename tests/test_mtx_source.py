"""The mtx data source against the text route, at all borders between ranges."""

import pytest

from loomatrix.plans.matrix import SparseMatrix
from loomatrix.sources import matrix_market, mtx_source

GENERAL = "%%MatrixMarket matrix coordinate real general\n% a comment\n\n4 5 6\n1 1 1.5\n2 3  -2e-3\n\n% between\n4 5 1e300\n 1 2\t7\n1 2 7\n3 1 0"
FILES = {
    "general": GENERAL, "ends with a line end": GENERAL + "\n",
    "symmetric": "%%MatrixMarket matrix coordinate integer symmetric\n3 3 4\n1 1 5\n2 1 -7\n3 3 0\n3 2 9\n",
    "pattern": "%%matrixmarket MATRIX coordinate pattern general\n2 2 2\n1 2\n2 1\n", "no entries": "%%MatrixMarket matrix coordinate real general\n2 2 0\n",
}


@pytest.mark.parametrize("name", FILES)
def test_ranges(spark, tmp_path, name):
    path = tmp_path / "m.mtx"
    path.write_text(FILES[name])
    want = [(r.i, r.j, r.v) for r in matrix_market.read_matrix(spark, str(path), square=False).entries.orderBy("seq").collect()]
    for split in (1, 2, 3, 5, 7, 11, 1000):
        reader = mtx_source.MtxReader({"path": str(path), "split": split})
        rows = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [r[1:] for r in sorted(rows)] == want and len({r[0] for r in rows}) == len(rows)
    a = mtx_source.load(spark, str(path), split=3)
    assert [(r.i, r.j, r.v) for r in a.entries.orderBy("seq").collect()] == want
    assert not want or a.entries.rdd.getNumPartitions() > 1


def test_long_lines_and_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mtx_source, "CHUNK", 5)
    path = tmp_path / "m.mtx"
    path.write_text(GENERAL)
    reader = mtx_source.MtxReader({"path": f"file://{path}", "split": 13})
    assert sorted(r["v"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()) == [-2e-3, 0.0, 1.5, 7.0, 7.0, 1e300]


@pytest.mark.parametrize("field, v", [("real", 0.1), ("integer", -3.0), ("pattern", 0.01)])
def test_round_trip(spark, tmp_path, field, v):
    entries = [(i, (i * 7) % 11, v * (i + 1 if field != "pattern" else 1)) for i in range(40)] + [(3, 3, v), (3, 3, v)]
    a = SparseMatrix(spark.createDataFrame(entries, "i bigint, j bigint, v double").repartition(5), 45, 12)
    for _ in range(2):  # the second replaces the first
        mtx_source.save(a, str(tmp_path / "out"), field)
    back = mtx_source.load(spark, str(tmp_path / "out"), split=50)
    assert (back.n_rows, back.n_cols) == (45, 12) and sorted((r.i, r.j, r.v) for r in back.entries.collect()) == sorted(entries)
    text = matrix_market.read_matrix(spark, str(tmp_path / "out"), square=False)
    assert [(r.i, r.j, r.v) for r in text.entries.orderBy("seq").collect()] == [(r.i, r.j, r.v) for r in back.entries.orderBy("seq").collect()]
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".")]


def test_refusals(spark, tmp_path):
    path = tmp_path / "m.mtx"
    for text, said in ((GENERAL.replace("4 5 6", "4 5 7"), "size line says 7"), (GENERAL.replace("4 5 6", "3 5 6"), "outside 3 x 5"), ("1 2 3", "banner"), (GENERAL.replace("real", "complex"), "only real"), (GENERAL.replace("3 1 0", "3"), "fewer than 3")):
        path.write_text(text)
        with pytest.raises(Exception, match=said):
            mtx_source.load(spark, str(path))
    with pytest.raises(ValueError, match="nothing at"):
        mtx_source.header(str(tmp_path / "none"))
    (tmp_path / "there").mkdir()
    mtx_source.register(spark)
    df = spark.createDataFrame([(0, 0, 1.0)], "i bigint, j bigint, v double")
    with pytest.raises(Exception, match="already"):
        df.write.format("mtx").mode("append").save(str(tmp_path / "there"))
