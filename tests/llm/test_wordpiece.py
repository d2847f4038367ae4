import json
import random

import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from evidlake.llm import queries, wordpiece

SF = "/root/testdata/sf0.001"


def greedy(word, starts, later):
    """Longest match first, from the left, with the tokens themselves."""
    n, at = 0, 0
    while at < len(word):
        pool = starts if at == 0 or later is None else later
        size = next((k for k in range(len(word) - at, 0, -1) if tuple(word[at : at + k]) in pool), 0)
        if not size:
            return -1
        n, at = n + (tuple(word[at : at + size]) != (256,)), at + size
    return n


def test_whole_table_against_greedy_matching(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    of = wordpiece.byte_symbols()
    vocab = {(256,)}
    for t in json.load(open(path))["model"]["vocab"]:
        if not t.startswith("<|"):
            vocab.add((*(of[c] for c in t.removesuffix("</w>")), *((256,) if t.endswith("</w>") else ())))
    t = pq.read_table(f"{SF}/documents.parquet")
    known, want = {}, {}
    for i, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True):
        words = (x or "").lower().encode().split()
        for w in words:
            if w not in known:
                known[w] = greedy((*w, 256), vocab, None)
        want[i] = (len(words), sum(known[w] for w in words), 0)
    assert {r.doc_id: tuple(r)[1:] for r in queries.op4_token_counts(spark, SF).collect()} == want


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=4), max_size=12), st.lists(st.text("abc", min_size=1, max_size=4), max_size=12), st.text("abcd", max_size=12), st.booleans())
def test_any_vocabulary(starts, later, word, marked):
    a, b = {tuple(x.encode()) for x in starts}, {tuple(x.encode()) for x in later} if marked else None
    machine = wordpiece.Automaton(sorted(a), sorted(b) if marked else None)
    assert machine.count(word.encode()) == greedy(tuple(word.encode()), a, b)


def test_continuations_unknown_and_edges(spark, tmp_path):
    of = wordpiece.from_tokens(["un", "aff", "##aff", "##able", "a", "##a"], continuation="##", byte_level=False)
    assert (of[b"unaffable"], of[b"aa"], of[b"able"]) == (3, 2, wordpiece.UNKNOWN + 1)
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": {"a": 0, "ab</w>": 1, "b": 2, "a</w>": 3}, "end_of_word_suffix": "</w>"}}))
    rng = random.Random(0)
    long = "".join(rng.choice("ab") for _ in range(50_000)) + "a"
    df = spark.createDataFrame([(1, "ab A x", 1), (2, None, 1), (None, "", 1), (3, long, 1), (1, "aab", 1), (4, "bb", 1)], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in wordpiece.count_tokens(df, str(path)).collect()), key=str)
    assert got == sorted([(1, 3, 3, 1), (2, 0, 0, 0), (None, 0, 0, 0), (3, 1, 50_001, 0), (1, 1, 2, 0), (4, 1, 2, 0)], key=str)
    assert wordpiece.count_tokens(df.where("doc_id > 9"), str(path)).collect() == []
