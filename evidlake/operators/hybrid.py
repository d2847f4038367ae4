"""Hybrid retrieval: a vector pool and a text pool, blended by weight.

Text scores are divided by the largest of the pool, against a floor of zero; rows that one arm alone
found keep a zero for the other. Texts are searched once: the matches, as (id, score), are settled, and
the text pool, its largest score and the exact number of matches are read from them. No window gathers
all rows; both pools are bounded by `pool`, and so is what is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..plans import settle
from . import text, windows

ALPHA = 0.6


@dataclass(frozen=True)
class Request:
    """k results of a search. Dates and paths hold for commits only and leave everything else out."""

    query: str
    vector: list[float]
    k: int = 8
    alpha: float = ALPHA
    entity_type: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    path: str | None = None

    @property
    def pool(self) -> int:
        return max(50, 4 * self.k)


def scoped(chunks: DataFrame, request: Request, commits: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Chunks under the request's filters; keys are joined, and nothing is multiplied."""
    out = chunks if request.entity_type is None else chunks.where(F.col("entity_type") == request.entity_type)
    if request.since is not None or request.until is not None:
        dated = commits.where(windows.closed(F.col("committed_at"), request.since, request.until)).select(F.col("sha").alias("entity_key"))
        out = out.where("entity_type = 'commit'").join(dated, "entity_key", "left_semi")
    if request.path is not None:
        touched = files.where(F.col("path").ilike(f"%{request.path}%")).select(F.col("sha").alias("entity_key"))
        out = out.where("entity_type = 'commit'").join(touched, "entity_key", "left_semi")
    return out


def blend(vectors: DataFrame, texts: DataFrame, alpha: float = ALPHA, *, id_col="chunk_id") -> DataFrame:
    """(id, vector_score, text_score, blended) of the pools' rows; each side at most a pool."""
    top = texts.agg(F.max("text_score").alias("_top"))
    both = vectors.select(id_col, "vector_score").join(texts.select(id_col, "text_score"), id_col, "full")
    scored = both.crossJoin(F.broadcast(top)).select(id_col, F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce(F.col("text_score").cast("double"), F.lit(0.0)).alias("text_score"), "_top")
    share = F.when(F.col("_top") > 0, F.col("text_score") / F.col("_top")).otherwise(0.0)
    return scored.withColumn("blended", alpha * F.col("vector_score") + (1 - alpha) * share).drop("_top")


def retrieve(chunks: DataFrame, embeddings: DataFrame, request: Request, *, commits: DataFrame | None = None, files: DataFrame | None = None, cover: bool = False) -> DataFrame:
    """The k best chunks: columns of chunks, vector_score, text_score, blended, text_match_count.

    cover=True reads the query as a web search and ranks by cover density, else by occurrences of all
    its words. The limit k is the feature.
    """
    inside = scoped(chunks, request, commits, files)
    q = F.array(*[F.lit(float(x)) for x in request.vector])
    with_vector = embeddings.select("chunk_id", cosine(F.col("embedding"), q).alias("vector_score")).where("vector_score is not null")
    near = with_vector.join(inside.select("chunk_id"), "chunk_id", "left_semi").orderBy(F.desc("vector_score"), "chunk_id").limit(request.pool)
    if cover:
        found = text.ranked(inside, request.query)
    else:
        found = text.matching(inside, sorted(set(request.query.lower().split()))).select("chunk_id", "text_score")
    found = settle(found)
    pool = found.orderBy(F.desc("text_score"), "chunk_id").limit(request.pool)
    best = blend(near, pool, request.alpha).orderBy(F.desc("blended"), "chunk_id").limit(request.k)
    total = found.agg(F.count("*").alias("text_match_count"))
    rows = chunks.join(F.broadcast(best), "chunk_id")  # k rows
    return rows.crossJoin(F.broadcast(total)).orderBy(F.desc("blended"), "chunk_id")


def notes(returned: int, text_matches: int, request: Request) -> list[str]:
    """What a caller must know about a page: whether fewer came back than asked, whether the text pool was cut."""
    out = []
    if returned < request.k:
        out.append(f"{returned} of the requested {request.k} chunks exist; no limit cut them")
    if text_matches > request.pool:
        out.append(f"{text_matches} chunks match the text, more than the pool of {request.pool}; the text candidates were cut before blending")
    return out
