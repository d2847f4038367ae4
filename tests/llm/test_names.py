"""Every operator beside columns whose names differ from its own in case only."""

import pytest
from pyspark.sql import functions as F

from evidlake.llm import codes, decontam, langid, licenses, mixing, multiindex, neardup, quality, queries, sstable, substrings, warczip, whitening, wordpiece

SF = "/root/testdata/sf0.001"
TOKENIZER = queries.tokenizer_path("word_bpe_49k.json")

OPERATORS = {
    "langid": ("documents", lambda d, t: langid.identify(d)),
    "sstable": ("documents", lambda d, t: sstable.token_output(d, TOKENIZER)),
    "mixing": ("documents", lambda d, t: mixing.mix(d, quality=mixing.label_weights(t("labels")))),
    "wordpiece": ("documents", lambda d, t: wordpiece.count_tokens(d, TOKENIZER)),
    "decontam": ("documents", lambda d, t: decontam.contaminate(d, t("benchmark"))),
    "warczip": ("pages", lambda d, t: warczip.archive_pages(d)),
    "substrings": ("documents", lambda d, t: substrings.cut_repeats(d).select("doc_id", "text")),
    "licenses": ("documents", lambda d, t: licenses.scan(d, path_col="source").select("id", "license")),
    "quality": ("documents", lambda d, t: quality.judge(d, t("labels"))),
    "neardup": ("documents", lambda d, t: neardup.jaccard_classes(d)),
    "codes": ("embeddings", lambda d, t: codes.compress(d).codes),
    "whitening": ("embeddings", lambda d, t: whitening.whiten(d).where("component = 1").select("id", "deviation")),
    "multiindex": ("embeddings", lambda d, t: multiindex.search(d, d, 3)),
}


def shadowed(df):
    """The frame with a second column for each, named in capitals, and some names that operators use inside."""
    return df.select(*[F.lit("other").alias(c.upper()) for c in df.columns], *df.columns, *[F.lit(7).alias(c) for c in ("row", "node", "stratum", "c", "v", "w", "_key", "h", "part")])


@pytest.mark.parametrize("name", OPERATORS)
def test_names_that_differ_in_case(spark, name):
    table, apply = OPERATORS[name]
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    want, got = apply(read(table), read), apply(shadowed(read(table)), lambda t: shadowed(read(t)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
