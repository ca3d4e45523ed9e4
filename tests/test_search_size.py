"""Searches send lists cut by rank, not a row for each pair of a question and a passage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import search
from orrery.plans import queries as _queries  # noqa: F401
from orrery.plans import registry

QUESTIONS, PASSAGES = 60, 3000


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Questions all of which share a word with all passages."""
    at = str(tmp_path_factory.mktemp("size"))
    rows = [(f"c{i:05}", f"lithium {'lithium ' * (i % 7)}" + " ".join(f"w{i}x{j}" for j in range(8)), "Vantor, Inc.", "VNTR", f"f{i % 900}", "10-K", 2020, "2020-12-31", "Item 1", "2024-01-01") for i in range(PASSAGES)]
    spark.createDataFrame(rows, "chunk_id string, text string, company string, ticker string, source_file string, form_type string, fiscal_year int, period_end string, item_section string, ingested_at string").write.parquet(f"{at}/chunks.parquet")
    spark.createDataFrame([(100 * i, f"w{i}x1 lithium at Vantor", "user") for i in range(QUESTIONS)], "id long, content string, role string").write.parquet(f"{at}/messages.parquet")
    spark.createDataFrame([("VNTR", "Vantor, Inc.", f"f{i}") for i in range(900)], "ticker string, company string, source_file string").write.parquet(f"{at}/filings.parquet")
    return at


def shuffled(spark, f) -> int:
    """The rows that the stages of ``f`` shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = max(stages(), default=-1)
    f()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k > before)


SEARCHES = [
    "bm25_topk",
    "coverage_by_company",
    "rrf_fusion",
    "rrf_lexical",
    "entity_coverage_at_k",
    "list_citations",
    "suspect_scores",
    "bm25_idf_topk",
    "companies_present",
    "coverage_sentence",
    "evaluation_run",
    "near_dup_suppress",
    "rerank_order",
    "context_prompts",
    "coverage_absent",
    "coverage_thin",
    "evidence_cut",
    "file_diverse_cut",
    "metrics_grouping_sets",
    "retrieval_metrics",
]


@pytest.mark.parametrize("name", SEARCHES)
def test_pairs_are_not_shuffled(spark, tables, name):
    assert shuffled(spark, lambda: registry.QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()) < QUESTIONS * PASSAGES * 0.7


@pytest.mark.parametrize("idf", [False, True])
@pytest.mark.parametrize("k", [1, 7, 40])
def test_best_documents_equal_all_scored(spark, monkeypatch, k, idf):
    """Against the scores of all pairs, with ties, null keys and texts, blocks of questions, and floors found first."""
    monkeypatch.setattr(search, "HELD", 3 * k)
    monkeypatch.setattr(search, "FLOORED", 0)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(f"k{i:03}é" if i % 3 else f"K{i:03}", " ".join(rng.choice(words, rng.integers(0, 6)))) for i in range(300)] + [(None, "w1 w1"), ("n", None)]
    d = spark.createDataFrame(docs, "id string, text string").repartition(5)
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, 3))) for i in range(10)] + [(90, "the"), (91, "unheard"), (92, None)], "q long, text string")
    got = sorted(map(tuple, search.bm25(d, "id", "text", q, "q", "text", k, idf).collect()), key=lambda r: (r[0], r[3]))
    want = sorted(map(tuple, search.top(search.bm25(d, "id", "text", q, "q", "text", None, idf), k).collect()), key=lambda r: (r[0], r[3]))
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1.1e-6, rtol=0)
    assert search.bm25(d, "id", "text", q.where("q > 91"), "q", "text", k, idf).collect() == []


def test_nearest_score_a_bounded_table():
    """4,096 queries against a batch of 10,000 rows: no table of all pairs (328 MB) in a task, and the same rows."""
    import tracemalloc

    import pyarrow as pa

    rng, k = np.random.default_rng(7), 3
    v, m = rng.integers(0, 3, (10_000, 4)).astype(float), search._unit(rng.integers(0, 3, (4096, 4)) + 1)
    b = pa.RecordBatch.from_arrays([pa.array([f"k{i:05}" for i in range(10_000)]), pa.array(v.tolist())], names=["key", "vector"])
    tracemalloc.start()
    out = next(search._nearest(iter([b]), m, list(range(4096)), None, k, (pa.int64(), pa.string()), ("question",)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
    got = list(zip(*(c.to_pylist() for c in out.columns)))
    for q in range(0, 4096, 512):
        s = np.round(m[q] @ search._unit(v).T, 6)
        assert [r[1:] for r in got if r[0] == q] == [(f"k{i:05}", s[i]) for i in np.lexsort((np.arange(10_000), -s))[:k]]


def test_words_are_counted_by_row(spark):
    import pyarrow as pa

    lists = pa.array([["a", "b", "a"], None, [], ["c", "b"]])
    assert [x.tolist() for x in search._occurrences(lists, pa.array(["a", "b"]))] == [[0, 0, 3], [0, 1, 1], [2, 1, 1], [3, 3, 2]]


def test_means_of_a_run_are_rounded_once(spark):
    """A recall of 1/6 and one of 0: 0.0833, not 0.0834 by way of 0.1667."""
    from orrery.operators import evaluation

    gold = spark.createDataFrame([("a", "x", ["T"], [f"f{i}" for i in range(6)], []), ("b", "x", ["T"], ["g"], [])], "id string, category string, tickers array<string>, source_files array<string>, expect_fiscal_years array<int>")
    got = spark.createDataFrame([("a", "f0", "T", 1), ("b", "h", "T", 1)], "question string, file string, ticker string, rank int")
    run = evaluation.run(gold, got, "own", F.lit("2031-01-01T00:00:00")).first()
    assert run.overall.recall_10 == 0.0833 and sorted(r.recall_10 for r in run.per_question) == [0.0, 0.1667]
