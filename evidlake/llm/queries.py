"""Queries of the operators in this folder, as functions of (spark, folder of tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import codes, decontam, langid, licenses, mixing, multiindex, neardup, quality, sstable, substrings, warczip, whitening, wordpiece
from .shared import few, settle


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_source_mix(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = mixing.mix(docs, quality=mixing.label_weights(labels))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_decontaminate(spark, sf_dir):
    return decontam.contaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark, sf_dir):
    out = substrings.cut_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


def op9_quality_rules(spark, sf_dir):
    out = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, F.array_join("rejected_by", ",").alias("rejected_by"))


def op10_jaccard_join(spark, sf_dir):
    return neardup.jaccard_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_shingles")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_shards(spark, sf_dir):
    return sstable.token_output(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_page_archives(spark, sf_dir):
    out = warczip.archive_pages(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir):
    return wordpiece.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_license_scan(spark, sf_dir):
    path = F.concat(F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string")), F.lit(".txt"))
    out = licenses.scan(_table(spark, sf_dir, "documents").withColumn("path", path))
    return out.select(F.col("id").alias("doc_id"), "path", "license", "score", "origin", F.array_join("licenses", ",").alias("licenses"), "from_folder")


def op11_vector_codes(spark, sf_dir):
    out = codes.compress(_table(spark, sf_dir, "embeddings"))
    totals = out.codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    rows = out.codes.join(few(settle(totals)), F.col("label").eqNullSafe(F.col("l")))
    return rows.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(out.digest()).alias("codebooks_sha256"), "label")


def op12_embedding_whitening(spark, sf_dir):
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)")).withColumnRenamed("id", "vec_id")


def op13_nearest_neighbours(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    return multiindex.search(rows, rows.where("vec_id % 100 = 0"), 10).withColumnRenamed("id", "vec_id")


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_token_shards, op3_source_mix, op4_token_counts, op5_decontaminate, op6_page_archives, op7_substring_dedup, op8_license_scan, op9_quality_rules, op10_jaccard_join, op11_vector_codes, op12_embedding_whitening, op13_nearest_neighbours)}
