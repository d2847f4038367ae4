import math
import random

import numpy as np
import pytest

from evidlake.functions import twister
from evidlake.operators import evaluation


def test_the_recurrence_has_the_generators_degree():
    assert twister.polynomial().bit_length() == twister.DEGREE + 1
    assert twister.shortest_recurrence([0, 1, 1, 0, 1, 1, 0, 1, 1, 0]) == 0b111


@pytest.mark.parametrize("step", [2, 624, 1_000_002])
def test_jumps_land_in_the_serial_stream(step):
    serial = random.Random(77)
    want = [serial.random() for _ in range(step + 3)]
    found = twister.states(77, step, 3)
    for i, state in enumerate(found):
        at = i * step // 2  # a draw takes two words
        assert twister.generator(state).random_sample(3).tolist() == want[at : at + 3]


def test_bootstrap_is_that_of_one_serial_generator(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(0.1, 1, 37).tolist(), "b": [0.5], None: rng.normal(0, 1, 12).tolist()}
    rows = [(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)] + [("a", 99, None)]
    df = spark.createDataFrame(rows, "comparison string, qid int, delta double").repartition(5)
    got = {r.comparison: tuple(r)[1:] for r in evaluation.bootstrap_exact(df, resamples=203, seed=9, tasks=7).collect()}
    for g, xs in groups.items():
        serial = random.Random(9)
        means = sorted(math.fsum(serial.choices(xs, k=len(xs))) / len(xs) for _ in range(203))
        at = lambda p: round(means[math.ceil(p * 203 / 1000) - 1], 12) + 0.0  # noqa: B023, E731
        assert got[g] == (len(xs), round(math.fsum(xs) / len(xs), 12) + 0.0, at(25), at(975))
    assert evaluation.bootstrap_exact(df.where("qid > 1000")).collect() == []
