from evidlake.operators import ivf, textindex
from evidlake.tools import Corpus, registry


def test_search_of_a_stored_corpus(spark, tmp_path):
    rows = [(i, "commit" if i % 2 else "issue", f"k{i}", f"note {i} about {'planner' if i % 5 == 0 else 'parser'} {'x' * 600}", [1.0, i / 10]) for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_id long, entity_type string, entity_key string, content string, embedding array<float>")
    stored = Corpus(df, ivf.build(df, f"{tmp_path}/v"), textindex.write_index(df, f"{tmp_path}/t", block_chunks=10))
    tool = registry(lambda q: [1.0, 2.0])["search_corpus"]
    got = tool(stored, {"query": "planner"})
    assert got.error is None and len(got.rows) == 5 and list(got.rows[0]) == ["artefact", "type", "excerpt", "score"]
    # id 20 is nearest by vector and one of those with the word
    assert got.rows[0]["artefact"] == "issue:k20" and len(got.rows[0]["excerpt"]) == 500
    assert [r["score"] for r in got.rows] == sorted((r["score"] for r in got.rows), reverse=True)
    assert len(tool(stored, {"query": '"note 3"', "top": 1}).rows) == 1
    for bad in ({}, {"query": " "}, {"query": "x", "top": 0}, {"query": "x", "top": 11}, {"query": "x", "top": "3"}):
        assert tool(stored, bad).error
