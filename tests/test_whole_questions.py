"""Queries that take what users asked in every message, not in those whose id is divisible by 100."""

import numpy as np
import pytest

from orrery.operators import search
from orrery.plans import queries as _queries  # noqa: F401
from orrery.plans import registry


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    asked = [(7, "lithium at Vantor", "user"), (100, "lithium at Vantor", "user"), (101, "Debt of Vantor in lithium", " Human "), (102, "lithium", "assistant"), (103, "the", "user"), (104, None, "user")]
    spark.createDataFrame(asked, "id long, content string, role string").write.parquet(f"{at}/messages.parquet")
    rows = [("c1", "lithium prices", "Vantor, Inc.", "VNTR", "f1", "10-K", 2020, "2020-12-31", "Item 1", "2024-01-01"), ("c2", "other words " + "x" * 400, "Kolm, Inc.", "KOLM", "f2", "10-K", 2020, "2020-12-31", "Item 1", "2024-01-01")]
    spark.createDataFrame(rows, "chunk_id string, text string, company string, ticker string, source_file string, form_type string, fiscal_year int, period_end string, item_section string, ingested_at string").write.parquet(f"{at}/chunks.parquet")
    spark.createDataFrame([("VNTR", "Vantor, Inc.", "f1"), ("KOLM", "Kolm, Inc.", "f2")], "ticker string, company string, source_file string").write.parquet(f"{at}/filings.parquet")
    return lambda name: sorted(map(tuple, registry.QUERIES[name](spark, at).collect()))


def test_coverage_sentence_of_every_question(run):
    words = "Evidence comes from VNTR (1 of 1 filings). Only one filing is held for VNTR."
    assert run("coverage_sentence") == [(q, words) for q in (7, 100, 101)]


def test_coverage_thin_of_every_question(run):
    assert run("coverage_thin") == [(q, "VNTR") for q in (7, 100, 101)]


def test_entity_coverage_of_every_question(run):
    assert run("entity_coverage_at_k") == [(q, 1.0) for q in (7, 100, 101)]


def test_citations_of_every_question(run):
    assert [(r[0], r[1], r[-1]) for r in run("list_citations")] == [(q, "C1", "lithium prices") for q in (7, 100, 101)]


def test_many_sets_of_words_are_searched_exactly():
    """Against sums of all weights, with ties, floors that rise, sets within sets, one of many words, and small blocks."""
    rng = np.random.default_rng(11)
    import pyarrow as pa

    sets = {tuple(sorted(rng.choice(30, rng.integers(1, 7), replace=False).tolist())) for _ in range(400)} | {tuple(range(40)), (0,), (0, 1)}
    words = sorted(sets)
    docs = [rng.choice(40, rng.integers(1, 9)).tolist() for _ in range(3000)]
    vocabulary = [f"w{i:02}" for i in range(40)]
    b = pa.RecordBatch.from_arrays([pa.array([f"k{i % 1500:04}{i}" for i in range(3000)]), pa.array([[vocabulary[j] for j in d] for d in docs])], names=["key", "t"])
    held = next(search._counted(iter([b]), vocabulary))
    m = search._weights(held.column(1), held.column(2), held.column(3), 40, None)
    keys = held.column(0).to_pylist()
    for k, floored in ((1, 0), (20, 0), (20, 0.9)):
        exact = {}
        for i, w in enumerate(words):
            x = np.floor(m[list(w)].sum(axis=0) * 1e6 + 0.5) / 1e6
            exact[i] = [(keys[d], x[d]) for d in sorted(np.flatnonzero(x), key=lambda d: (-x[d], keys[d]))[:k]]
        floor = np.array([(exact[i][-1][1] - 0.01) * (rng.random() < floored) if len(exact[i]) == k else 0.0 for i in range(len(words))])
        lists = search._Lists(words, 40, None, floor, k, True)
        for part in (held.slice(0, 900), held.slice(900, 64), held.slice(964)):
            lists.add(part)
        q, d, x = lists.cut()
        for i in range(len(words)):
            got = [(keys[j], y) for j, y in zip(d[q == i], x[q == i])]
            assert [g[0] for g in got] == [g[0] for g in exact[i]] and np.allclose([g[1] for g in got], [g[1] for g in exact[i]], atol=1.1e-6, rtol=0)
