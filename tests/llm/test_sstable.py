import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidlake.llm import queries, sstable
from evidlake.llm.shared import open_fs
from evidlake.llm.tokens import WordTokens

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
WORDS = WordTokens(PATH)


def whole(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


def digest(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_whole_table_against_the_tokenizer(spark):
    t = pq.read_table(f"{SF}/documents.parquet").sort_by("doc_id")
    want, start = [], 0
    for i, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True):
        ids = whole(x or "") + [2]
        want.append((i, start, len(ids), digest(ids)))
        start += len(ids)
    got = sorted(tuple(r)[:4] for r in queries.op2_token_shards(spark, SF).collect())
    assert got == want


ALPHABET = "aAbzZéÉßñ'’.,!#|<>019 \n\t  \x1ćΣσςİıǅⅧ²µ漢🙂_"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_words_encode_as_the_whole(text):
    assert np.frombuffer(WORDS.ids([text.encode()])[0], WORDS.dtype).tolist() == whole(text)


def test_special_strings_and_full_caches():
    texts = ["a<|endoftext|>b <|startoftext|>", "I'm they've don't O'Neil's 'tis", "THERHAOU!! ciónñue | x### 4785"]
    small = WordTokens(PATH)
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(small.ids([t.encode()])[0], small.dtype).tolist() == whole(t)
    import evidlake.llm.tokens as tokens

    for most in (3, 300):
        tiny = WordTokens(PATH)
        tiny.words, tiny.cores = tokens.Cache(most), tokens.Cache(most)
        for _ in range(3):
            got = [np.frombuffer(x, tiny.dtype).tolist() for x in tiny.ids([t.encode() for t in texts * 2])]
            assert got == [whole(t) for t in texts * 2]
        assert tiny.words.keys.nbytes + tiny.words.values.nbytes <= most
    assert tiny.ids([]) == [] and tiny.ids([b"", b" \n"]) == [b"", b""]


def test_tokenizers_of_another_form_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, library = WordTokens(path), Tokenizer.from_file(path)
    texts = ["a  b\n c", "", " Word's éñ ", "\t\t42"]
    assert not other.by_words and WORDS.by_words
    assert [np.frombuffer(x, other.dtype).tolist() for x in other.ids([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_shard_round_trip_and_lookup():
    rng = random.Random(1)
    rows = sorted((sstable.key_of(i), np.array([rng.randrange(60_000) for _ in range(rng.randrange(0, 4000))], "<u2").tobytes()) for i in [None, *range(-500, 500, 3), 7, 7, 2**63 - 1, -(2**63)])
    out = io.BytesIO()
    w = sstable.ShardWriter(out, 2)
    for k, v in rows:
        w.add(k, v)
    w.close()
    r = sstable.ShardReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert list(r.scan()) == rows and r.entries == len(rows) and len(r.places) > 3
    assert [sstable.value_of(k, True) for k, _ in rows][:3] == [None, -(2**63), -500]
    for i in (None, -500, 7, 499, 2**63 - 1):
        assert [x.tobytes() for x in r.get(i)] == [v for k, v in rows if k == sstable.key_of(i)]
    assert not any(r.get(i) for i in range(-499, 500, 3))
    bad = bytearray(out.getvalue())
    bad[10] ^= 1
    with pytest.raises(ValueError):
        list(sstable.ShardReader(io.BytesIO(bytes(bad)), len(bad)).scan())


def test_nulls_ties_and_empty_table(spark, tmp_path):
    rows = [(5, "b c", 1), (5, "a", 1), (None, "z", 1), (-3, None, 1), (9, "", 1), (5, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    folder = f"file://{tmp_path}/out"
    shards = sstable.write_shards(df, folder, PATH, shards=3)
    got = sstable.read_shards(shards).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted((i, len(whole(t or "")) + 1, digest(whole(t or "") + [2])) for i, t, _ in rows if i is not None)
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert starts[0][2] is None and [s for s, _, _ in starts] == np.cumsum([0] + [n for _, n, _ in starts])[:-1].tolist()
    assert [d for _, _, d in starts[1:]] == [-3, 5, 5, 5, 9]
    for s in shards.collect():
        fs, name = open_fs(s.path)
        with fs.open_input_file(name) as f:
            reader = sstable.ShardReader(f, fs.get_file_info(name).size)
            assert reader.entries == s.entries
    assert sstable.token_output(df.where("doc_id > 100"), PATH, folder=f"file://{tmp_path}/none").collect() == []


def test_rows_that_repeat_are_spread_and_long_texts_kept(spark, tmp_path):
    long = "ab cd, " * 400_000
    df = spark.range(0, 20_000, 1, 16).selectExpr("7L as doc_id", "'x y' as text").union(spark.createDataFrame([(8, long)], "doc_id long, text string"))
    shards = sstable.write_shards(df, f"file://{tmp_path}/out", PATH, shards=4).collect()
    assert max(s.entries for s in shards) < 10_000 and sum(s.entries for s in shards) == 20_001
    got = sstable.read_shards(spark.createDataFrame(shards)).collect()
    assert sorted(r.start for r in got if r.doc_id == 7) == list(range(0, 60_000, 3))
    ids = whole(long) + [2]
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got if r.doc_id == 8] == [(60_000, len(ids), digest(ids))]
