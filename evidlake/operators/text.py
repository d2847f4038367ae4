"""Full-text search over chunks: matching, counting, ranking, and a stored index of terms.

A search of whole texts needs one scan and no shuffle: words are counted in the row. The index, for
many searches of one corpus, holds a row per chunk and term with positions, and is written once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import let

#: A short list; searches take their own.
STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: Texts whose words are gathered at once.
GATHERED_TEXTS = 1000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def occurrences(low: Column, term: str) -> Column:
    """How often a term is a word of a lower-case text. A term with other characters than those of words never is."""
    if not re.fullmatch(r"[^\W_]+", term):
        return F.lit(0).cast("long")
    # The term comes first and what is before it is looked at afterwards, so that the search skips to it.
    return F.regexp_count(low, F.lit(rf"{term}(?<![\p{{L}}\p{{N}}]{term})(?![\p{{L}}\p{{N}}])")).cast("long")


def matching(chunks: DataFrame, terms: list[str], *, text_col="content") -> DataFrame:
    """Chunks that hold every term, with text_score, the number of occurrences of all.

    Terms are counted in place, without splitting the text into words, and once: what counts rows also drops them.
    """
    if not terms:
        return chunks.withColumn("text_score", F.lit(0).cast("long")).where(F.lit(False))
    total = lambda tf: F.when(F.forall(tf, lambda n: n > 0), F.array(F.aggregate(tf, F.lit(0).cast("long"), lambda a, n: a + n)))
    tally = let(F.lower(text_col), lambda low: let(F.array(*[occurrences(low, t) for t in terms]), total))
    return chunks.select("*", F.explode(tally).alias("text_score"))


@dataclass
class Search:
    """Alternatives of conjunctions of phrases, and phrases that must not occur; terms are stems."""

    any_of: list[list[tuple[str, ...]]] = field(default_factory=list)
    none_of: list[tuple[str, ...]] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return sorted({t for c in self.any_of for p in c for t in p})


def read_search(query: str) -> Search:
    """Web-search syntax: words are all wanted, "quoted" ones in a row, `or` gives another way, -word excludes.

    Never an error; what holds no word is ignored.
    """
    out, current = Search(), []
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query or ""):
        if bare.lower() == "or" and not minus:
            if current:
                out.any_of.append(current)
            current = []
            continue
        phrase = tuple(stem(w) for w in re.findall(r"[^\W_]+", (quoted or bare).lower()) if w not in STOP)
        if phrase:
            (out.none_of if minus else current).append(phrase)
    if current:
        out.any_of.append(current)
    return out


def spelling(stemmed: bool, stop: frozenset[str]) -> Callable[[str], str | None]:
    """The term of a word: its stem unless told otherwise; a stop word has none."""
    return lambda w: None if w in stop else stem(w) if stemmed else w


def gathered(words: pa.ListArray, term_of: Callable[[str], str | None]) -> tuple[np.ndarray, pa.Array, pa.ListArray]:
    """The distinct terms of each text, given as a list of words: (places of the texts, terms, positions from 1), by term and then by text."""
    flat, sizes = words.flatten().dictionary_encode(), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = [term_of(w) for w in flat.dictionary.to_pylist()]
    names = sorted({t for t in spelled if t is not None})
    code = {t: i for i, t in enumerate(names)}
    term = np.array([code.get(t, -1) for t in spelled] or [-1])[flat.indices.to_numpy()]
    kept = np.flatnonzero(term >= 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    key = term[kept] * max(1, len(sizes)) + owner[kept]
    order = np.argsort(key, kind="stable")  # positions stay in order
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    first = kept[order[starts]]
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(kept)), pa.int32()), pa.array(place[kept[order]], pa.int32()))
    return owner[first], pa.array(names, pa.string()).take(pa.array(term[first])), positions


def postings(chunks: DataFrame, *, id_col="chunk_id", text_col="content", stemmed: bool = True, stop: frozenset[str] = STOP) -> DataFrame:
    """(id, term, positions from 1) of every chunk: words are stemmed unless told otherwise, stop words leave gaps.

    A text's words are gathered where the text is, without a shuffle. An id of several chunks has rows for each.
    """
    ws = chunks.select(id_col, words(F.col(text_col)).alias("w"))
    kind, term_of = chunks.schema[id_col].dataType.simpleString(), spelling(stemmed, stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, GATHERED_TEXTS):
                part = batch.slice(first, GATHERED_TEXTS)
                owner, terms, positions = gathered(part.column(1), term_of)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), terms, positions], names=[id_col, "term", "positions"])

    return ws.mapInArrow(run, f"`{id_col}` {kind}, term string, positions array<int>")


def cover_density(positions: list[list[int]]) -> float:
    """Sum over minimal covers, spans that hold every term and no shorter span that does, of 1 over the gap they leave.

    Cover density ranking (Clarke, Cormack and Tudhope, 2000): a cover of n terms over w words weighs n / w
    divided by 1 plus the words within that aren't terms.
    """
    if not positions or not all(positions):
        return 0.0
    events = sorted((p, i) for i, ps in enumerate(positions) for p in ps)
    seen, inside, left, total = [0] * len(positions), 0, 0, 0.0
    for right, (end, i) in enumerate(events):
        inside += seen[i] == 0
        seen[i] += 1
        moved = False
        while inside == len(positions):
            begin, j = events[left]
            seen[j] -= 1
            inside -= seen[j] == 0
            left += 1
            moved = inside < len(positions)
        if moved:
            n, width = right - left + 2, end - begin + 1
            total += (n / width) / (1 + max(0, width - n))
    return total


def _phrase_at(index: dict[str, list[int]], phrase: tuple[str, ...]) -> list[int]:
    later = [set(index.get(t, ())) for t in phrase]
    return [p for p in index.get(phrase[0], ()) if all(p + i in later[i] for i in range(1, len(phrase)))]


def _judge(search: Search, index: dict[str, list[int]]) -> tuple[bool, float]:
    """Whether a text with these positions of terms matches a search, and its score."""
    ways = [c for c in search.any_of if all(_phrase_at(index, p) for p in c)]
    good = bool(ways or not search.any_of) and bool(search.any_of or search.none_of) and not any(_phrase_at(index, p) for p in search.none_of)
    return good, max((cover_density([_phrase_at(index, p) for p in c]) for c in ways), default=0.0)


def ranked(chunks: DataFrame, query: str, *, id_col="chunk_id", text_col="content") -> DataFrame:
    """(id, text_score) of chunks that match a web-style search, scored by cover density over stems.

    Only chunks that can hold every term of some way leave the JVM: a word begins with all but the last
    letter of its stem, so they must contain that.
    """
    search = read_search(query)
    keep = {*search.terms, *(t for p in search.none_of for t in p)}
    low, may = F.lower(text_col), F.lit(not search.any_of)
    for way in search.any_of:
        all_in = F.lit(True)
        for t in sorted({t for p in way for t in p}):
            all_in = all_in & F.contains(low, F.lit(t[:-1]))
        may = may | all_in
    spelled = chunks.where(F.coalesce(may, F.lit(False)) if search.any_of else F.lit(True)).select(F.col(id_col), words(F.col(text_col)).alias("w"))

    begins = tuple({t[:-1] for t in keep})
    names = sorted(keep)
    none = _judge(search, {})

    def run(ws: pa.Array) -> pa.Array:
        flat, sizes = ws.flatten().dictionary_encode(), pc.list_value_length(ws).fill_null(0).to_numpy(zero_copy_only=False)
        # Only distinct words that begin like a wanted stem are stemmed; the others can't have it.
        code = {t: i for i, t in enumerate(names)}
        wanted = np.array([code.get(stem(w), -1) if w.startswith(begins) and w not in STOP else -1 for w in flat.dictionary.to_pylist()] or [-1])
        term = wanted[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        hits, ends = np.flatnonzero(term >= 0), np.cumsum(sizes)
        owner = np.searchsorted(ends, hits, side="right")
        out, cuts = [none] * len(ws), np.flatnonzero(np.diff(owner)) + 1
        for at in np.split(np.arange(len(hits)), cuts) if len(hits) else ():
            i, index = int(owner[at[0]]), {}
            for p, t in zip((hits[at] - (ends[i] - sizes[i]) + 1).tolist(), term[hits[at]].tolist(), strict=True):
                index.setdefault(names[t], []).append(p)
            out[i] = _judge(search, index)
        return pa.StructArray.from_arrays([pa.array([m for m, _ in out], pa.bool_()), pa.array([x for _, x in out], pa.float64())], names=["matched", "text_score"])

    score = F.arrow_udf(run, "struct<matched:boolean,text_score:double>")
    score = score.asNondeterministic()  # else the filter would evaluate it once more
    return spelled.withColumn("r", score("w")).where("r.matched").select(id_col, "r.text_score")


def search_postings(index: DataFrame, terms: list[str], *, id_col="chunk_id", stemmed: bool = True) -> DataFrame:
    """(id, text_score) of chunks that hold all terms, from a stored index: the filter reaches the scan."""
    wanted = sorted({stem(t) if stemmed else t for t in terms})
    hit = index.where(F.col("term").isin(*wanted)).groupBy(id_col).agg(F.size(F.collect_set("term")).alias("n"), F.sum(F.size("positions")).alias("text_score"))
    return hit.where(F.col("n") == len(wanted)).drop("n")
