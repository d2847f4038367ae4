"""Language identification: nearest of several clustered centroids per language.

A text becomes counts of 1- to 3-grams of its letters (lower case, other characters one blank),
hashed into DIMENSIONS buckets, times the inverse document frequency of the sample, of length 1. Each
language's sample is clustered into CENTROIDS by cosine, all but every HELD-th text of it; a text takes
the language of the nearest centroid, and its score is that cosine. The texts left out tell how far own
texts are: farther away than REJECT of those nearest to that centroid (of all, where that one has none),
a text is marked rejected; the nearest language is given all the same.

The model is fitted on at most SAMPLE texts of each language, chosen by hash; grouping by language is
bounded by that. It holds no text and about 64 KB a language, in every task; more than MOST_LANGUAGES
languages are refused with an error, none is left out.

Edge cases: null texts and texts without a letter are `und` with score 0; so is everything when no
row can be learned from; null languages are not learned; ties go to the language first in order; rows
that repeat, null ids too, are predicted one by one; a very long text is counted whole, as a slice of
its own; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import memo, picked, settle

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE = 1000
MOST_LANGUAGES = 1000
REJECT = 0.995
HELD = 4
SLICE_CHARS = 1 << 20
ROUNDS = 12


def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts of each text, (texts, DIMENSIONS), and which texts have a letter."""
    letter = memo("letters", _is_letter)
    code = np.frombuffer("".join(f" {t} " for t in (x.lower() for x in texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t.lower()) + 2 for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    is_letter = letter[code]
    keep = is_letter | np.r_[True, is_letter[:-1]]
    keep[np.cumsum(sizes) - sizes] = True
    c = np.where(is_letter, code, np.uint32(32))[keep].astype(np.uint64)
    owner, is_letter = owner[keep], is_letter[keep]
    has = np.bincount(owner, weights=is_letter, minlength=len(texts)) > 0
    total = np.zeros(len(texts) * DIMENSIONS, dtype=np.float32)
    gram = np.zeros(len(c), dtype=np.uint64)
    for n in range(1, 4):
        size = max(0, len(c) - n + 1)
        gram = gram[:size] * np.uint64(0x100000001B3) + c[n - 1 :]
        bucket = ((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)
        same = owner[:size] == owner[n - 1 :] if n > 1 else is_letter
        total += np.bincount(owner[:size][same] * DIMENSIONS + bucket[same], minlength=len(total)).astype(np.float32)
    return total.reshape(len(texts), DIMENSIONS), has


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = counts * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart starts: unit centroids, none empty."""
    picked = [int(np.argmax(v @ v.mean(axis=0)))]
    while len(picked) < min(k, len(v)):
        picked.append(int(np.argmin((v @ v[picked].T).max(axis=1))))
    c = v[picked]
    for _ in range(ROUNDS):
        near = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def centroids_of(v: np.ndarray, k: int) -> tuple[np.ndarray, list[float]]:
    """Centroids of a language's vectors, and the least cosine that isn't rejected, from the texts that the fit left out."""
    v = v[np.linalg.norm(v, axis=1) > 0]
    if not len(v):
        return v, []
    out = np.arange(len(v)) % HELD == HELD - 1
    c = cluster(v[~out], k)
    cosine = (v[out] if out.any() else v) @ c.T
    near, own = cosine.argmax(axis=1), cosine.max(axis=1)
    return c, [float(np.quantile(own[near == i] if (near == i).any() else own, 1 - REJECT)) for i in range(len(c))]


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    nearest: np.ndarray  # least cosine of a text that isn't rejected, by centroid

    def classify(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        counts, has = vectors(texts)
        if not len(self.languages):
            return [("und", 0.0, True)] * len(texts)
        cosine = weighted(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        return [(self.languages[b], float(s), bool(s < self.nearest[b])) if h else ("und", 0.0, True) for b, s, h in zip(best, score, has, strict=True)]


def _slices(texts: list[str]):
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or (size + len(texts[end]) <= SLICE_CHARS and end - at < 2000)):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def _all_counts(texts: list[str]) -> np.ndarray:
    return np.concatenate([vectors(x)[0] for x in _slices(texts)])


def fit(rows: DataFrame, *, text_col="text", lang_col="lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from rows with a language; everything collected is bounded by the parameters."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: fit a model for each group of them")
    if not sizes:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros(0))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(min(1.0, 1.3 * sample / r["count"] + 0.0)))])
    place = (F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)).cast("double")
    some = rows.withColumn("h", F.xxhash64("text")).where(place < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    some = settle(some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= sample).select("lang", "text"))

    def frequencies(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        seen = (_all_counts(table.column("text").to_pylist()) > 0).sum(axis=0)
        return pa.table({"lang": [key[0].as_py()], "n": pa.array([table.num_rows], pa.int64()), "df": pa.array([seen.tolist()], pa.list_(pa.int64()))})

    found = some.groupBy("lang").applyInArrow(frequencies, "lang string, n bigint, df array<bigint>").collect()
    n, df = sum(r.n for r in found), np.sum([r.df for r in found], axis=0)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def centres(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        c, least = centroids_of(weighted(_all_counts(sorted(table.column("text").to_pylist())), idf), centroids)
        return pa.table({"lang": [key[0].as_py()] * len(c), "i": pa.array(range(len(c)), pa.int32()), "c": pa.array([x.tolist() for x in c], pa.list_(pa.float32())), "least": pa.array(least, pa.float64())})

    parts = sorted(some.groupBy("lang").applyInArrow(centres, "lang string, i int, c array<float>, least double").collect(), key=lambda r: (r.lang, r.i))
    return Model([r.lang for r in parts], np.array([r.c for r in parts], np.float32).reshape(len(parts), DIMENSIONS), idf, np.array([r.least for r in parts]))


def predict(text: Column, model: Model) -> Column:
    """struct(lang_pred, score, rejected) for whole texts."""

    def run(texts: pa.Array) -> pa.Array:
        out = [x for part in _slices([t or "" for t in texts.to_pylist()]) for x in model.classify(part)]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], names=["lang_pred", "score", "rejected"])

    return F.arrow_udf(run, "struct<lang_pred:string,score:double,rejected:boolean>")(text)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the documents that aren't held out."""
    docs = picked(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = fit(docs.where(~held_out("doc_id")))
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), predict(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", "p.*")
