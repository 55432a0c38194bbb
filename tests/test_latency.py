"""Latencies of questions that are answered as one batch."""

import math
import time

import pytest

from quarryline.engine import CodeIndex
from quarryline.operators import evaluation


def test_shares_of_stages_sum_to_the_measured_time(spark):
    rows = [("a.py", "class Rule:\n    def add(self):\n        return check()\n\ndef check():\n    return 1\n"), ("b.py", "from a import Rule\n\ndef start():\n    return Rule().add()\n")]
    index = CodeIndex.build(spark.createDataFrame(rows, "file string, text string"))
    cases = spark.createDataFrame([(1, "how does Rule.add work", "Rule.add"), (2, "start", "start"), (3, "", "none")], "qid long, query string, expected string")
    began = time.perf_counter()
    stages = evaluation.Stages()
    found = index.search(cases.select("qid", "query"), 5, 20, stages=stages)
    outer = time.perf_counter() - began
    got = evaluation.latencies(cases.select("qid", "query"), stages).collect()
    # Nothing of the search lies outside its stages.
    assert math.isclose(sum(r.seconds for r in got), stages.seconds, rel_tol=1e-9) and outer - 0.2 < stages.seconds <= outer
    assert math.isclose(sum(spent for _, spent, _ in stages.spent), stages.seconds, rel_tol=1e-9)
    assert [r.stage for r in got if r.qid == 1] == ["features", "bm25", "semantic", "graph", "results"] and len(got) == 15
    assert {r.qid: r.n_rows for r in got if r.stage == "results"} == {q: sum(r.qid == q for r in found.collect()) for q in (1, 2, 3)}
    assert min(r.seconds for r in got) > 0
    plain = [(r.qid, r.rank, r.qualified_name) for r in index.search(cases.select("qid", "query"), 5, 20).collect()]
    assert sorted(plain) == sorted((r.qid, r.rank, r.qualified_name) for r in found.collect())
    row = index.timed_evaluation(cases).first()
    assert row.n_cases == 3 and row.recall > 0.6 and 0 < row.mean_latency <= row.max_latency * (1 + 1e-9)


def test_a_question_with_more_rows_has_more_of_a_stage(spark):
    stages = evaluation.Stages()
    stages.spent = [("one", 6.0, spark.createDataFrame([(1,), (1,), (1,), (None,)], "qid long")), ("two", 3.0, spark.createDataFrame([], "qid long"))]
    queries = spark.createDataFrame([(1,), (2,), (2,), (None,)], "qid long")
    got = {(r.qid, r.stage): (r.n_rows, r.seconds) for r in evaluation.latencies(queries, stages).collect()}
    assert got == {(1, "one"): (3, pytest.approx(24 / 7)), (2, "one"): (0, pytest.approx(6 / 7)), (None, "one"): (1, pytest.approx(12 / 7)), (1, "two"): (0, 1.0), (2, "two"): (0, 1.0), (None, "two"): (0, 1.0)}
    assert evaluation.latencies(queries.limit(0), stages).count() == 0
