import random

import pytest
from pyspark.sql import functions as F

from evidlake.operators import text, textindex

QUERIES = ["alpha beta", '"alpha beta"', '"beta alpha" gamma', "alpha or gamma", 'delta -alpha', '-alpha', '"gamma delta" or "delta gamma" -beta', "running runs", "nothing", "the", "", '"alpha alpha"', "alpha -\"beta gamma\""]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "the", "running", "other", "words"], [1 + i % 7, 2, 2, 1, 4, 1, 9, 9], k=rng.randrange(0, 40)))) for i in range(600)]
    return spark.createDataFrame([*rows, (600, None), (601, "Alpha's BETA, gamma; alpha-beta!")], "chunk_id long, content string")


@pytest.fixture(scope="module")
def index(chunks, tmp_path_factory):
    return textindex.write_index(chunks, f"{tmp_path_factory.mktemp('i')}/index", block_chunks=20)


@pytest.mark.parametrize("query", QUERIES)
def test_the_index_finds_what_the_scan_finds(spark, chunks, index, query):
    want = {(r.chunk_id, round(r.text_score, 9)) for r in text.ranked(chunks.where("content is not null"), query).collect()}
    got = {(r.chunk_id, round(r.text_score, 9)) for r in textindex.search_index(index, query).collect()}
    assert {x for x in got if x[0] != 600} == want


def test_the_best_are_found_without_decoding_all_blocks(spark, chunks, index, monkeypatch):
    monkeypatch.setattr(textindex, "FIRST_BLOCKS", 4)
    decoded, judged = [], textindex._judged
    monkeypatch.setattr(textindex, "_judged", lambda i, blocks, s, names: (decoded.append(blocks.count()), judged(i, blocks, s, names))[1])
    for query in ("alpha", "alpha beta", '"alpha beta" gamma'):
        want = [tuple(r) for r in textindex.search_index(index, query).orderBy(F.desc("text_score"), "chunk_id").limit(5).collect()]
        decoded.clear()
        assert [tuple(r) for r in textindex.search_index(index, query, k=5).collect()] == want
        if query == "alpha":
            assert 0 < sum(decoded) < 0.6 * index.select("block").distinct().count()
    few = textindex.search_index(index, '"alpha beta gamma delta"', k=50).collect()
    assert {r.chunk_id for r in few} == {r.chunk_id for r in textindex.search_index(index, '"alpha beta gamma delta"').collect()}
