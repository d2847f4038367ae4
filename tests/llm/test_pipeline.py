import pyarrow.parquet as pq
import test_decontam
import test_mixing
import test_neardup
import test_quality
import test_sstable

import corpus_pipeline
from evidlake.llm import quality

SF = "/root/testdata/sf0.001"


def scores(text):
    n, chars, symbols, dup, rep, _ = test_quality.brute(text)
    lines = [x for x in (text or "").split("\n") if x.strip(test_quality.SPACE)]
    capitals = sum("A" <= c <= "Z" for c in text or "")
    words = (text or "").encode().split()
    stutters = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return {"stuttered_words": stutters / max(n, 1), "symbols_per_word": symbols / max(n, 1), "duplicate_lines": dup / max(len(lines), 1), "repeated_words": rep / max(n, 1), "capital_letters": capitals / max(chars, 1)}


def kept_by_rules(docs, labels):
    good = {i for i, q in labels if q == 1}
    fine = [d for d in docs if not test_quality.brute(d["text"])[-1]]
    strata = {d["lang"] for d in fine if d["doc_id"] in good}
    chosen, measured = {}, {id(d): scores(d["text"]) for d in fine}
    rejects = lambda x, levels: any(n and x[rule] > cuts[n - 1] for n, (rule, cuts) in zip(levels, quality.RULES.items(), strict=True))
    for s in strata:
        own = [d for d in fine if d["lang"] == s]
        ids, proven = {d["doc_id"] for d in own if d["doc_id"] in good}, []
        for path, share in zip(quality.PATHS, quality.SHARES, strict=True):
            for levels in path:
                lost = {d["doc_id"] for d in own if d["doc_id"] in ids and rejects(measured[id(d)], levels)}
                if quality.binomial_at_most(len(lost), len(ids), quality.ALPHA) > share * quality.DELTA / len(strata):
                    break
                proven.append(levels)
        if proven:
            chosen[s] = max(proven, key=lambda levels: sum(rejects(measured[id(d)], levels) for d in own))  # noqa: B023
    return [d for d in fine if not rejects(measured[id(d)], chosen.get(d["lang"], (0,) * 5))]


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    labels = test_decontam.rows_of(SF, "labels", "doc_id", "quality")
    df, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        out.write.parquet(path := f"{tmp_path}/{name}")
        df = spark.read.parquet(path)
        seen.append(sorted(r.doc_id for r in df.collect()))
    docs = kept_by_rules(docs, labels)
    assert seen[0] == sorted(d["doc_id"] for d in docs)
    keep = {i for i, c, _ in test_neardup.brute([(d["doc_id"], d["text"]) for d in docs]) if i == c}
    docs = [d for d in docs if d["doc_id"] in keep]
    assert seen[1] == sorted(keep)
    bad = {r[0] for r in test_decontam.brute([(d["doc_id"], d["text"]) for d in docs], test_decontam.rows_of(SF, "benchmark", "item_id", "text")) if r[-1]}
    docs = [d for d in docs if d["doc_id"] not in bad]
    assert bad and seen[2] == sorted(d["doc_id"] for d in docs)
    weights = {i: {1: 2.0, 0: 0.5}[q] for i, q in labels}
    copies = {r[0]: r[4] for r in test_mixing.brute([(d["doc_id"], d["text"], d["source"]) for d in docs], weights)}
    assert seen[3] == sorted(i for i, n in copies.items() for _ in range(n))
    want, start = [], 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = test_sstable.whole(d["text"] or "") + [2]
        for _ in range(copies[d["doc_id"]]):
            want.append((d["doc_id"], start, len(ids), test_sstable.digest(ids)))
            start += len(ids)
    assert sorted(tuple(r)[:4] for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_no_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        assert df.collect() == []
