"""N-gram Jaccard join by MinHash banding: which documents share at least `threshold` of their shingles.

A document is the set of its SHINGLE-word windows (all its words, if fewer). Documents with equal sets
become one node with a count. Bands of minima are chosen for the target recall: documents at the
threshold meet in some band with that probability, more similar ones nearly always. Nodes that meet
are joined to the least node of their band, never in pairs; the connected pieces then hold every pair
that met. Two nodes are linked if they met in some band and their full shingle sets reach the threshold,
however a piece is verified: one of up to BLOCK_NODES within one task, a larger one as a whole or band by
band, whichever has fewer pairs: near copies of one text meet in nearly every band, while a long chain of
pieces has small bands. Band by band, a pair counts in the first band in which it met. What is above
BLOCK_NODES or BLOCK_SHINGLES is cut into blocks, and each pair of blocks is a task's work, so a task is
bounded. Tasks return a count of links and a root per node, not pairs. Links are weighted by copies.

Result: class_id is the least doc_id of the documents connected by links, n_links the number of other
documents linked directly (copies counted).

Edge cases: null and wordless texts have no shingles and link to nothing (their class is their own
id); rows that repeat count as separate documents; a null id still counts in links and classes, and
a class of null ids only has a null id; a pair exactly at the threshold is linked; of several rows with
the least id of a class the one with the least hash is its keeper; a very long text is one set like
others, by itself in its task's slice; an empty table gives no rows; other columns, whatever their names,
are ignored by `jaccard_classes` and returned unchanged by `one_of_each`. Nodes are named by 64 bits of a
hash of their shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import few, give_back, picked, plain, settle
from .wordhash import mixed, new_cache, windows

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 256
BLOCK_NODES = 512
BLOCK_SHINGLES = 1 << 20
GROUP_SHINGLES = 1 << 18
SLICE_BYTES = 4 << 20
COLUMNS = 2048
#: Pairs whose bands are compared at once.
PAIRS = 1 << 15


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest meetings below the threshold, that reach the recall within `most` minima."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band count reaches that recall")
    return best


def shingle_sets(texts: list[bytes], n: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text laid end to end, and how many each has."""
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    h = np.fromiter(map(cache.__getitem__, (x for w in words for x in w)), dtype=np.uint64, count=int(lengths.sum()))
    run, start = windows(h, lengths, n)
    owner = np.repeat(np.arange(len(texts)), lengths)[start]
    short = [(i, xxhash.xxh3_64_intdigest(b" ".join(words[i]))) for i in np.flatnonzero((lengths > 0) & (lengths < n))]
    owner = np.r_[owner, np.array([i for i, _ in short], dtype=np.int64)]
    run = np.r_[run, np.array([x for _, x in short], dtype=np.uint64)]
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    first = np.r_[True, (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])] if len(run) else np.zeros(0, bool)
    return run[first], np.bincount(owner[first], minlength=len(texts)).astype(np.int64)


def band_hashes(values: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Hash of each band of minima of each non-empty set: (sets, bands)."""
    rng = np.random.Generator(np.random.PCG64(20240501))
    factor = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), bands), dtype=np.uint64)
    buf = np.empty_like(x)
    for band in range(bands):
        acc = np.full(len(sizes), band, dtype=np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            np.multiply(x, factor[i], out=buf)
            np.add(buf, shift[i], out=buf)
            acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(buf, starts))
        out[:, band] = acc
    return out


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_BYTES):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(row, doc_id, node, n, bands) for every document; node and bands are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = new_cache()
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            for at, end in _slices(texts):
                values, sizes = shingle_sets(texts[at:end], shingle, cache)
                some = np.flatnonzero(sizes)
                ends = np.cumsum(sizes)
                nodes: list = [None] * (end - at)
                for i in some:
                    nodes[i] = np.int64(np.uint64(xxhash.xxh3_64_intdigest(values[ends[i] - sizes[i] : ends[i]].tobytes())).view(np.int64))
                hashes: list = [None] * (end - at)
                if len(some):
                    for i, row in zip(some, band_hashes(values, sizes[some], bands, rows).view(np.int64), strict=True):
                        hashes[i] = row
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "node", "n", "bands"],
                )
            del texts
            give_back()

    source = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"row bigint, doc_id {kind}, node bigint, n bigint, bands array<bigint>")


def _shared(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n sets share: (n, n)."""
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count[place] > 1
    _, place = np.unique(place[keep], return_inverse=True)
    owner = owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((n, n), dtype=np.float32)
    for left in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [left, left + COLUMNS])
        part = np.zeros((n, COLUMNS), dtype=np.float32)
        part[owner[a:b], place[a:b] - left] = 1
        total += part @ part.T
    return total


def first_met(bands: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The place of the first band that the nodes of each pair share; as many as there are bands where they share none."""
    out = np.full(len(left), bands.shape[1])
    for i in range(0, len(left), PAIRS):
        same = bands[left[i : i + PAIRS]] == bands[right[i : i + PAIRS]]
        out[i : i + PAIRS] = np.where(same.any(axis=1), same.argmax(axis=1), bands.shape[1])
    return out


def verify(node: np.ndarray, copies: np.ndarray, block: np.ndarray, a: int, b: int, texts: list[bytes], shingle: int, threshold: float, cache: dict, bands: np.ndarray, band: int | None = None):
    """Pairs between blocks a and b of a piece that met, first in `band` if one is given: (links, root) of each node, links weighted by copies."""
    values, sizes = shingle_sets(texts, shingle, cache)
    n = len(node)
    inter = _shared(values, np.repeat(np.arange(n), sizes), n)
    union = sizes[:, None] + sizes[None, :] - inter
    linked = inter >= threshold * union - 1e-9
    linked &= (block[:, None] != block[None, :]) if a != b else ~np.eye(n, dtype=bool)
    left, right = np.nonzero(linked)
    first = first_met(bands, left, right)
    met = first < bands.shape[1] if band is None else first == band
    linked[left[~met], right[~met]] = False
    links = linked.astype(np.float64) @ copies
    root = np.arange(n)
    while True:  # least label among linked ones, until nothing changes
        near = np.where(linked, root[None, :], n).min(axis=1, initial=n)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return links.astype(np.int64), node[root]
        root = new


def _matched(docs: DataFrame, pieces_of: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, groups: int) -> DataFrame:
    """(node, links, root) from every task that holds a node; pieces_of: (row, node, copies, comp, k, band, bands), band null for whole pieces."""
    text = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))
    # Only texts of pieces are shuffled; rows that repeat are cut to one before that.
    text = text.join(few(pieces_of.select("row")), "row", "left_semi").groupBy("row").agg(F.any_value("text").alias("text"))
    block = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least(j, F.col("block")).cast("int").alias("a"), F.greatest(j, F.col("block")).cast("int").alias("b")))
    dealt = text.join(pieces_of.withColumn("block", block), "row").withColumn("pair", F.explode(pairs)).select("node", "copies", "comp", "block", "pair.a", "pair.b", "band", "bands", "text")
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("comp", "band", "a", "b"), F.lit(groups)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        col = {c: np.array(table.column(c).to_pylist(), dtype=np.int64) for c in ("node", "copies", "comp", "block", "a", "b")}
        texts, bands, cache, out = table.column("text"), table.column("bands"), new_cache(), ([], [], [])
        whole = np.asarray(table.column("band").is_null())
        col["band"] = np.array(table.column("band").fill_null(0).to_pylist(), dtype=np.int64)
        order = np.lexsort((col["node"], col["b"], col["a"], col["band"], whole, col["comp"]))
        keys = np.stack([col["comp"], whole, col["band"], col["a"], col["b"]], axis=1)[order]
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for at in np.split(order, cuts) if len(order) else []:
            at = at[np.r_[True, np.diff(col["node"][at]) != 0]]  # a row that repeats is one node
            if len(at) > 1:
                own = np.array(bands.take(pa.array(at)).to_pylist(), dtype=np.int64)
                band = None if whole[at[0]] else int(np.flatnonzero(own[0] == col["band"][at[0]])[0])
                links, root = verify(col["node"][at], col["copies"][at].astype(np.float64), col["block"][at], col["a"][at[0]], col["b"][at[0]], texts.take(pa.array(at)).to_pylist(), shingle, threshold, cache, own, band)
                some = links > 0
                for to, x in zip(out, (col["node"][at][some], links[some], root[some]), strict=True):
                    to.append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in zip(("node", "links", "root"), out, strict=True)})

    return dealt.groupBy("g").applyInArrow(run, "node bigint, links bigint, root bigint")


def cheaper_by_band(sized: DataFrame, comps: DataFrame, block_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Pieces above a block with fewer pairs in their bands than in all, (root), and their bands, (root, band, nodes, total); settled."""
    large = comps.where(F.col("nodes") > block_nodes).select("root", F.col("nodes").alias("all"))
    bands = sized.join(few(large.select("root")), "root").select("root", "n", F.explode("bands").alias("band"))
    bands = settle(bands.groupBy("root", "band").agg(F.count("*").alias("nodes"), F.sum("n").alias("total")).where("nodes > 1"))
    square = lambda c: F.col(c).cast("double") * F.col(c)
    met = bands.groupBy("root").agg(F.sum(square("nodes")).alias("met")).join(large, "root")
    by_band = settle(met.where(F.col("met") < square("all")).select("root"))
    return by_band, bands.join(few(by_band), "root", "left_semi")


def jaccard_classes(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle=SHINGLE, threshold=THRESHOLD, recall=RECALL, block_nodes=BLOCK_NODES) -> DataFrame:
    """One row per document: row (hash of id and text), doc_id, class_id, n_links, n_shingles, keeper.

    keeper is the row hash of the class's document with the least id (least hash on ties, nulls last).
    """
    docs, id_col, text_col = picked(docs, doc_id=id_col, text=text_col), "doc_id", "text"
    bands, rows = choose_bands(threshold, recall)
    sk = settle(sketches(docs, id_col, text_col, shingle, bands, rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("first")
    nodes = sk.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands"), first)
    banded = nodes.select("node", F.explode("bands").alias("band"))
    met = banded.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("c")).where("c > 1").select("band", "least")
    pieces = components(banded.join(met, "band").where("node <> least").select("node", "least"), "node", "least")

    sized = settle(nodes.select("node", "copies", "row", "n", "bands").join(pieces, "node"))
    k = F.greatest(F.ceil(F.col("nodes") / block_nodes), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    summed = [F.count("*").alias("nodes"), F.sum("n").alias("total")]
    comps = settle(sized.groupBy("root").agg(*summed).withColumn("k", k))
    held = sized.join(comps.select("root", "k"), "root").select("row", "node", "copies", F.col("root").alias("comp"), "k", F.lit(None).cast("long").alias("band"), "bands")
    work = [comps.select("total", "k")]
    if comps.where(F.col("nodes") > block_nodes).limit(1).count():
        by_band, bands_of = cheaper_by_band(sized, comps, block_nodes)
        bands_of = settle(bands_of.withColumn("k", k))
        held = held.join(few(by_band.select(F.col("root").alias("comp"))), "comp", "left_anti")
        each = sized.join(few(by_band), "root").select("root", "row", "node", "copies", "bands", F.explode("bands").alias("band")).join(bands_of.select("root", "band", "k"), ["root", "band"])
        held = held.unionByName(each.select("row", "node", "copies", F.col("root").alias("comp"), "k", "band", "bands"))
        work = [comps.join(by_band, "root", "left_anti").select("total", "k"), bands_of.select("total", "k")]
    held = settle(held)
    work = sum(w.agg(F.sum(F.col("total") * F.col("k"))).first()[0] or 0 for w in work)
    groups = max(8, math.ceil(work / GROUP_SHINGLES))
    found = settle(_matched(docs, held, id_col, text_col, shingle, threshold, groups))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "root"), "node", "root")
    named = links.join(roots, "node", "left").select("node", "links", F.coalesce("root", "node").alias("class"))
    # Both sides of the joins that follow are settled, so that Spark can split a node or class of very many rows.
    every = settle(nodes.select("node", "copies", "first").join(named, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("class", "node").alias("class"), "first"))
    best = settle(every.groupBy("class").agg(F.min("first").alias("best")))
    known = settle(every.join(best, "class").select("node", "n_links", "best"))
    out = sk.drop("bands").join(known, "node", "left")
    alone = F.col("node").isNull()  # a document without words is a class of its own
    return out.select("row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("n").alias("n_shingles"), F.when(alone, F.col("row")).otherwise(F.col("best.row")).alias("keeper"))


def one_of_each(docs: DataFrame, *, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """Documents without their near copies, all columns: of each class the keeper stays, once.

    Rows that repeat with the same id and text stay once, wordless ones too. What goes is sent to the
    documents as hashes of rows, by broadcast up to a counted bound.
    """
    rows, name = plain(docs)
    judged = jaccard_classes(rows, id_col=name(id_col), text_col=name(text_col), **how)
    gone = settle(judged.where("row <> keeper").select("row").distinct())
    twice = settle(judged.where("row = keeper").groupBy("row").agg(F.count("*").alias("times")).where("times > 1").select("row"))
    marked = rows.withColumn("row", F.xxhash64(name(id_col), name(text_col)))
    kept = marked.join(few(gone), "row", "left_anti")
    if twice.limit(1).count():
        kept = kept.join(few(twice), "row", "left_anti").unionByName(marked.join(few(twice), "row", "left_semi").dropDuplicates(["row"]))
    return kept.select(*rows.columns).toDF(*docs.columns)
