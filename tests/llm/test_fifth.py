"""Operator 3: items of one template, and the words that the corpus judges."""

from __future__ import annotations

import pyarrow as pa
import pytest

from loomatrix.llm import common, decontaminate


@pytest.mark.parametrize("any_case", [False, True])
@pytest.mark.parametrize("n", [3, 8, 9, 30])
def test_items_of_one_template(spark, n, any_case):
    """A copy with other values is found beside however many items of its template."""
    ask = lambda k: f"A train leaves the old station with {k} passengers on board, drops {k + 7} of them at the second stop and then takes the rest of them to the harbour before noon."
    items = [(k, ask(100 + k)) for k in range(n)]
    rows = [(1, "so then " + ask(900) + " and that was all"), (2, ask(100)), (3, "A train leaves the old station and nothing else happens in that town.")]
    found = decontaminate.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), any_case=any_case).collect()
    verdicts = {(r.doc_id, r.item_id): r.verdict for r in found}
    assert verdicts == {(d, k): "verbatim" if (d, k) == (2, 0) else "reparameterised" for d in (1, 2) for k in range(n)}


def test_edge_hashes():
    """Equal words have equal numbers wherever they stand; words told by other bytes than the inner ones differ."""
    words = ["a", "ab", "abcdefgh", "abcdefghi", "bcdefghi", "é", "abcdefghXabcdefgh", "abcdefghYabcdefgh", "Zbcdefgh"]
    got = common.edge_hashes(pa.array(words)).tolist()
    assert got == common.edge_hashes(pa.array(["other", *words])[1:]).tolist()
    assert got[6] == got[7] and len(set(got)) == len(words) - 1
