import math
import random

import pytest

from evidlake.operators import runs

KIND = "qid string, arm string, hits array<struct<artefact:string,score:double>>, ms double, error string"


def test_one_table_of_a_complete_run(spark):
    questions = spark.createDataFrame([(f"q{i}", f"a{i}", "issue" if i % 2 else "commit") for i in range(6)], "qid string, target string, entity_type string")
    # arm A has all but q0 first; B only even ones, and fails on q5; C nothing
    hit = lambda arm, i: {"A": i > 0, "B": i % 2 == 0, "C": False}[arm]
    rows = [(f"q{i}", arm, [(f"a{i}" if hit(arm, i) else "x", 0.9), ("y", 0.5)], 10.0 * i, "boom" if (arm, i) == ("B", 5) else None) for arm in "ABC" for i in range(6)]
    results = spark.createDataFrame(rows, KIND)
    got = {(r.section, r["name"], r.metric): (r.value, r.note) for r in runs.study(results, questions, ["A", "B", "C"], [("A", "B")], resamples=200, seed=5).collect()}
    value = lambda *k: got[k][0]
    assert (value("arm", "A", "n"), value("arm", "A", "top1"), value("arm", "B", "errors"), value("arm", "B", "n")) == (6, pytest.approx(5 / 6), 1, 5)
    assert value("arm", "A", "p50_ms") == 20 and value("arm", "A", "median_margin") == pytest.approx(0.4)
    assert value("type", "B/commit", "top1") == 1 and value("type", "B/issue", "n") == 2
    deltas = [-1.0, 1.0, 0.0, 1.0, 0.0]  # of q0 to q4, by id
    serial = random.Random(5)
    means = sorted(math.fsum(serial.choices(deltas, k=5)) / 5 for _ in range(200))
    assert value("comparison", "A-B", "mean") == pytest.approx(0.2) and value("comparison", "A-B", "ci_low") == pytest.approx(means[4]) and value("comparison", "A-B", "ci_high") == pytest.approx(means[194])
    assert got["comparison", "A-B", "mean"][1]
    assert {n for s, n, _ in got if s == "exploratory"} == {"C-A", "C-B", "B-A"}
    with pytest.raises(ValueError, match="not complete"):
        runs.study(results.where("qid <> 'q3' or arm <> 'C'"), questions, ["A", "B", "C"], [("A", "B")])
