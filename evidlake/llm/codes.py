"""Vector code compression: product quantisation by Lloyd's rounds with Elkan's bounds, in whole numbers.

A vector of integers floor(1024 x) is cut into equal consecutive parts; each part position has a
codebook, and a vector's code is the index of the nearest entry (squared Euclidean distance, ties to
the lower index) for each part. Codebooks start as the parts of the vectors with the smallest ids and
are moved `rounds` times to the floor of the mean of their parts; entries without parts stay.

The state of a round is a Parquet table in the shared folder with, for each vector, its integers, its
code, an upper bound of the distance to its entry for each part, and one lower bound for each part and
entry. A round shifts the bounds by how far the entries moved and leaves out entries that can't be as
near as the one a part has, by the triangle inequality and strictly: what could tie is always decided on
exact integers. Lower bounds are kept as bytes of the row's largest, rounded down; upper bounds are
rounded up. Entries that bounds leave are evaluated pair by pair, or at once for a part with many. Only
the state of the round before is kept. Sums for the new entries are added up by task, then by Spark;
the driver holds codebooks only, whose size is entries times dimensions.

Edge cases: rows whose vector is null or holds a null or non-finite component have no code; a null id
ranks after all ids; of rows that repeat an id the vector decides, and every row counts; with fewer rows
than entries, codebooks have as many entries as there are rows; without rows there are no codebooks; an
empty vector has parts without components, all at distance 0. Vectors of several lengths, lengths that
the parts don't divide, and components so large (8192 or more at 16 components a part) that distances
would not be exact are errors. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, give_back, new_folder
from .vectors import kept_vectors, matrix, pack, unpack, whole

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows handled at once in a task, of a dimension of up to about a thousand.
SLICE_ROWS = 2048
#: Pairs of part and entry evaluated at once.
SLICE_PAIRS = 1 << 16


@dataclass
class Codes:
    """codes: (id, label, code binary, error long, evaluated long); books: for each part the entries, as integers."""

    codes: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        return books_sha256(self.books)


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def restore(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The integers that a matrix of codes stands for."""
    return np.concatenate([book[codes[:, p]] for p, book in enumerate(books)], axis=1)


def largest(width: int) -> int:
    """Components below this have squared distances that doubles hold exactly."""
    return 1 << ((51 - math.ceil(math.log2(max(1, width)))) // 2)


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-12) + 1e-9


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, x * (1 - 1e-12) - 1e-9)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """All squared distances, exactly: every term is a whole number that doubles hold."""
    x, c = x.astype(np.float64), book.astype(np.float64)
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)


def own_squares(x: np.ndarray, book: np.ndarray, at: np.ndarray) -> np.ndarray:
    d = x - book[at]
    return (d * d).sum(axis=1)


@dataclass
class Book:
    """A codebook with what pruning needs: half the distances between entries, and how far each entry moved."""

    entries: np.ndarray
    halves: np.ndarray
    nearest: np.ndarray
    moved: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None = None) -> Book:
        halves = down(np.sqrt(squares(entries, entries)) / 2)
        others = halves + np.where(np.eye(len(entries), dtype=bool), np.inf, 0.0)
        moved = np.zeros(len(entries)) if before is None else up(np.sqrt(((entries - before) ** 2).sum(axis=1).astype(np.float64)))
        return cls(entries, halves, others.min(axis=1), moved)


def assign_first(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper bound, lower bounds, distances evaluated) of a first round: all entries are evaluated."""
    d = squares(x, book.entries)
    at = d.argmin(axis=1)
    return at, up(np.sqrt(d[np.arange(len(x)), at])), down(np.sqrt(d)), np.full(len(x), len(book.entries))


def assign_again(x: np.ndarray, book: Book, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for a later round: entries are left out where the bounds prove them farther than the present one."""
    n = len(book.entries)
    at, upper, lower, count = at.copy(), up(upper + book.moved[at]), down(lower - book.moved), np.zeros(len(x), dtype=np.int64)
    todo = np.flatnonzero(upper >= book.nearest[at])

    def candidates(rows: np.ndarray) -> np.ndarray:
        u = upper[rows, None]
        out = (lower[rows] <= u) & (book.halves[at[rows]] <= u)
        out[np.arange(len(rows)), at[rows]] = False
        return out

    todo = todo[candidates(todo).any(axis=1)]
    own = own_squares(x[todo], book.entries, at[todo])
    count[todo] += 1
    upper[todo] = up(np.sqrt(own.astype(np.float64)))
    lower[todo, at[todo]] = down(np.sqrt(own.astype(np.float64)))
    open_ = candidates(todo)
    key = own * n + at[todo]  # least distance first, then lower index
    many = open_.sum(axis=1) > n // 8
    rows = np.flatnonzero(many)
    if len(rows):
        d = squares(x[todo[rows]], book.entries)
        mine = open_[rows]
        lower[todo[rows]] = np.where(mine, down(np.sqrt(d)), lower[todo[rows]])
        keys = np.where(mine, d.astype(np.int64) * n + np.arange(n), np.iinfo(np.int64).max)
        key[rows] = np.minimum(key[rows], keys.min(axis=1))
        count[todo[rows]] += mine.sum(axis=1)
    r, j = np.nonzero(open_ & ~many[:, None])
    for i in range(0, len(r), SLICE_PAIRS):
        ri, ji = r[i : i + SLICE_PAIRS], j[i : i + SLICE_PAIRS]
        d = own_squares(x[todo[ri]], book.entries, ji)
        lower[todo[ri], ji] = down(np.sqrt(d.astype(np.float64)))
        np.minimum.at(key, ri, d * n + ji)
    count[todo] += np.where(many, 0, open_.sum(axis=1))
    at[todo], upper[todo] = key % n, up(np.sqrt((key // n).astype(np.float64)))
    return at, upper, lower, count


def _round(books: list[Book], dim: int, first: bool):
    """A task's part of a round: batches of the table, or of the state before, to batches of the new state."""
    parts, entries = len(books), len(books[0].entries)
    width = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, SLICE_ROWS):
                batch = whole_batch.slice(i, SLICE_ROWS)
                n = batch.num_rows
                if first:
                    x, evaluated = whole(matrix(batch.column("v"), dim), largest(width)), np.zeros(n, dtype=np.int64)
                else:
                    x, evaluated = unpack(batch.column("x"), np.int32, dim).astype(np.int64), batch.column("evaluated").to_numpy().copy()
                    old, uppers = unpack(batch.column("code"), np.uint8, parts).astype(np.int64), unpack(batch.column("upper"), np.float64, 2 * parts)
                    bytes_ = unpack(batch.column("lower"), np.uint8, parts * entries)
                code, upper, lower, error = np.zeros((n, parts), np.uint8), np.zeros((n, 2 * parts)), np.zeros((n, parts * entries), np.uint8), np.zeros(n, np.int64)
                for p, book in enumerate(books):
                    own, of = x[:, p * width : (p + 1) * width], slice(p * entries, (p + 1) * entries)
                    if first:
                        at, u, low, count = assign_first(own, book)
                    else:
                        at, u, low, count = assign_again(own, book, old[:, p], uppers[:, 2 * p], bytes_[:, of] * uppers[:, 2 * p + 1, None])
                    step = low.max(axis=1) / 255
                    code[:, p], upper[:, 2 * p], upper[:, 2 * p + 1] = at, u, step
                    lower[:, of] = np.floor(low / np.where(step > 0, step, 1.0)[:, None] * (1 - 1e-12))
                    error += own_squares(own, book.entries, at)
                    evaluated += count
                state = {"x": pack(x.astype(np.int32)), "code": pack(code), "upper": pack(upper), "lower": pack(lower), "error": pa.array(error), "evaluated": pa.array(evaluated)}
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *state.values()], names=["id", "label", *state])
            give_back()

    return run


def _sums(parts: int, entries: int, dim: int):
    width = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x, code = unpack(batch.column("x"), np.int32, dim), unpack(batch.column("code"), np.uint8, parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                found, start = np.unique(code[order, p], return_index=True)
                counts[p, found] += np.diff(np.r_[start, len(order)])
                if len(found):
                    sums[p, found] += np.add.reduceat(x[order, p * width : (p + 1) * width].astype(np.int64), start, axis=0)
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def moved(state: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """Codebooks at the floors of the means of their parts; at most entries times dimensions numbers reach the driver."""
    part = state.select("x", "code").mapInArrow(_sums(len(books), len(books[0]), dim), "part bigint, entry bigint, n bigint, sums array<bigint>")
    each = part.select("part", "entry", "n", F.posexplode_outer(F.when(F.size("sums") > 0, F.col("sums"))))
    total = each.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).where("pos is not null")
    out = [book.copy() for book in books]
    for r in total.collect():
        out[r.part][r.entry, r.pos] = int(r.total) // r.n
    return out


def compress(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all rows with finite vectors, and the codebooks that they were made with."""
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("1 to 256 entries, 1 part and 0 rounds at least")
    spark = rows.sparkSession
    table = kept_vectors(rows, vec_col, id=id_col, label=label_col)
    kind = {n: f.dataType.simpleString() for n, f in zip(table.columns, table.schema, strict=True)}
    state_kind = f"id {kind['id']}, label {kind['label']}, x binary, code binary, upper binary, lower binary, error bigint, evaluated bigint"
    start = [r.v for r in table.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not start:
        return Codes(spark.createDataFrame([], state_kind).select("id", "label", "code", "error", "evaluated"), [])
    dim = len(start[0])
    if dim % parts:
        raise ValueError(f"{parts} parts don't divide {dim} components")
    width = dim // parts
    first = whole(np.array(start, dtype=np.float64).reshape(len(start), dim), largest(width))
    books = [first[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    state, folder, ready = table, None, [Book.of(b) for b in books]
    for n in range(rounds + 1):
        new = new_folder(spark, "codes")
        out = state.mapInArrow(_round(ready, dim, n == 0), state_kind)
        (out if n < rounds else out.select("id", "label", "code", "error", "evaluated")).write.parquet(new)
        if folder:
            discard(spark, folder)
        state, folder = spark.read.parquet(new), new
        if n < rounds:
            before, books = books, moved(state, books, dim)
            ready = [Book.of(b, a) for a, b in zip(before, books, strict=True)]
    return Codes(state, books)
