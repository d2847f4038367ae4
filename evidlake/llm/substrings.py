"""Substring deduplication by fixed-block anchors: repeated runs of SPAN words are cut out.

Each text is cut into blocks of BLOCK words from its start, the last partial one left out. Any SPAN =
2 * BLOCK - 1 words in a row hold a whole block, so when they also stand elsewhere, that block equals
a rolling window there. Blocks are indexed by hash, every rolling window of BLOCK words probes the
index, and a hit is extended to the windows of SPAN words around it, which are compared by two hashes
of 95 bits together, over 64-bit hashes of their words; windows that occur twice or more, joined, are
the maximal exact repeats.

Documents are dealt to groups by a hash of the row and its place in the input, so that rows that
repeat are spread, and stay there (one shuffle of text, which Spark reuses for
all three passes); only hashes travel. A group sends each distinct hash once, with a mark when it
occurs there more than once, so a passage shared by a third of all documents costs each group one
entry. Groups and hash buckets hold a bounded share of the input. No pairs are made.

Edge cases: null has no words; a text shorter than SPAN keeps all its words; repeats within one
document count, overlapping ones too; rows that repeat are separate texts, so each loses what they
share; null and repeated ids are kept as they are; a very long text is one group's work by itself; there
are no ties to decide; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import picked, pieces
from .wordhash import BASE, OTHER, hash_words, mixed, windows

SPAN = 35
GROUP_BYTES = 2 << 20
MAX_GROUPS = 1 << 18
TAIL = np.uint64((1 << 30) - 1)
#: Two hashes of a window; the last bit of the second is a mark.
PAIR = np.dtype([("a", "<u8"), ("o", "<u4")])


def _pairs(a: np.ndarray, other: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), dtype=PAIR)
    out["a"], out["o"] = a, (other >> np.uint64(32)).astype(np.uint32) & ~np.uint32(1)
    return out


def _groups(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct pair, and which of them each pair is."""
    a, o = np.ascontiguousarray(pairs["a"]), np.ascontiguousarray(pairs["o"])
    order = np.argsort(a, kind="stable")
    if ((a[order][1:] == a[order][:-1]) & (o[order][1:] != o[order][:-1])).any():  # first hashes alone won't tell
        order = np.lexsort((o, a))
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (o[order][1:] != o[order][:-1])
    place = np.empty(len(a), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _among(pairs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each pair is among the known ones."""
    known = known[np.argsort(known["a"], kind="stable")]
    ka, ko = np.ascontiguousarray(known["a"]), np.ascontiguousarray(known["o"])
    at, found = np.searchsorted(ka, pairs["a"]), np.zeros(len(pairs), dtype=bool)
    open_ = np.arange(len(pairs))
    while len(open_):  # as often as a first hash repeats among the known ones
        open_ = open_[at[open_] < len(ka)]
        open_ = open_[ka[at[open_]] == pairs["a"][open_]]
        found[open_] |= ko[at[open_]] == pairs["o"][open_]
        at[open_] += 1
    return found


def _texts(table: pa.Table, span: int):
    """Words of each text; which texts are long enough; their words' hashes laid end to end, and lengths."""
    words = [t.split() if t else [] for t in table.column("text").to_pylist()]
    long = [i for i, w in enumerate(words) if len(w) >= span]
    lengths = np.array([len(words[i]) for i in long], dtype=np.int64)
    return words, long, hash_words([x for i in long for x in words[i]]), lengths


def _probes(h, lengths, block: int, buckets: int):
    """Distinct rolling hashes by (bucket, tail), each window's place among them, and the windows' starts."""
    r, at = windows(h, lengths, block)
    key = ((r >> np.uint64(34)) % np.uint64(buckets)) << np.uint64(30) | (r & TAIL)
    uniq, place, count = np.unique(key, return_inverse=True, return_counts=True)
    return uniq, place, count, at


def _dealt(bucket: np.ndarray, values: np.ndarray):
    """Slices of values by bucket; bucket is sorted."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(bucket)]
    return [(int(bucket[a]), values[a:b].tobytes()) for a, b in zip(starts, ends, strict=True) if b > a]


def cut_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", span: int = SPAN, groups: int | None = None) -> DataFrame:
    """One row per document: doc_id, text (kept words, one space between), n_words, n_removed, spans of removed words."""
    block = (span + 1) // 2
    n = groups or pieces(docs, GROUP_BYTES, most=MAX_GROUPS)
    docs, id_col, text_col = picked(docs, doc_id=id_col, text=text_col), "doc_id", "text"

    def send_probes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, _, h, lengths = _texts(table, span)
        uniq, place, count, at = _probes(h, lengths, block, n)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        is_block = np.zeros(len(uniq), dtype=np.uint32)
        is_block[place[(at - starts[at]) % block == 0]] = 1
        value = ((uniq & TAIL).astype(np.uint32) << np.uint32(2)) | (is_block << np.uint32(1)) | (count > 1)
        rows = _dealt(uniq >> np.uint64(30), value.astype("<u4"))
        return pa.table({"b": pa.array([b for b, _ in rows], pa.int32()), "g": pa.array([key[0].as_py()] * len(rows), pa.int32()), "v": pa.array([v for _, v in rows], pa.binary())})

    def answer_probes(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(v, dtype="<u4") for v in table.column("v").to_pylist()]
        v = np.concatenate(parts)
        _, place = np.unique(v >> np.uint32(2), return_inverse=True)
        total = np.bincount(place, weights=1 + (v & 1))
        indexed = np.bincount(place, weights=(v >> np.uint32(1)) & 1)
        return _bits(table, parts, ((total >= 2) & (indexed > 0))[place])

    def send_windows(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, h, lengths = _texts(left, span)
        uniq, place, _, at = _probes(h, lengths, block, n)
        found = _read_bits(right, uniq >> np.uint64(30))
        hit = np.zeros(len(h) + 1, dtype=np.int64)
        hit[at + 1] = found[place]
        hits = np.cumsum(hit)
        a, start = windows(h, lengths, span)
        near = hits[start + span - block + 1] > hits[start]
        a, start = a[near], start[near]
        pair = _pairs(a, windows(h, lengths, span, OTHER)[0][near])
        first, place = _groups(pair)
        pair, count = pair[first], np.bincount(place, minlength=len(first))
        b = (pair["a"] >> np.uint64(20)) % np.uint64(n)
        pair["o"] |= (count > 1).astype(np.uint32)
        order = np.argsort(b, kind="stable")
        rows = _dealt(b[order], pair[order])
        return pa.table({"b": pa.array([x for x, _ in rows], pa.int32()), "g": pa.array([key[0].as_py()] * len(rows), pa.int32()), "v": pa.array([x for _, x in rows], pa.binary())})

    def answer_windows(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(v, dtype=PAIR) for v in table.column("v").to_pylist()]
        v = np.concatenate(parts)
        more = (v["o"] & np.uint32(1)).astype(np.int64)
        v["o"] &= ~np.uint32(1)
        _, place = _groups(v)
        twice = (np.bincount(place, weights=1 + more) >= 2)[place]
        ends = np.cumsum([len(p) for p in parts])
        out = [(g, v[e - len(p) : e][twice[e - len(p) : e]].tobytes()) for g, p, e in zip(table.column("g").to_pylist(), parts, ends, strict=True)]
        out = [(g, x) for g, x in out if x]
        return pa.table({"g": pa.array([g for g, _ in out], pa.int32()), "v": pa.array([x for _, x in out], pa.binary())})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        words, long, h, lengths = _texts(left, span)
        repeated = np.concatenate([np.frombuffer(v, dtype=PAIR) for v in right.column("v").to_pylist()] or [np.zeros(0, PAIR)])
        a, start = windows(h, lengths, span)
        start = start[_among(_pairs(a, windows(h, lengths, span, OTHER)[0]), repeated)] if len(repeated) else start[:0]
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + span, -1)
        gone = np.cumsum(edge)[:-1] > 0
        texts, removed, spans = [b" ".join(w) for w in words], [0] * len(words), [[] for _ in words]
        for i, end, size in zip(long, np.cumsum(lengths), lengths, strict=True):
            mask = gone[end - size : end]
            if mask.any():
                step = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
                spans[i] = [{"start": int(s), "end": int(e)} for s, e in zip(step[::2], step[1::2], strict=True)]
                removed[i] = int(mask.sum())
                texts[i] = b" ".join([w for w, m in zip(words[i], mask.tolist(), strict=True) if not m])
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "text": pa.array(texts, pa.binary()).cast(pa.string()),
                "n_words": pa.array([len(w) for w in words], pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    id_type = docs.schema[id_col].dataType.simpleString()
    # The place is the same whenever the same files are read, so that a task that is tried again finds the same groups.
    g = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.monotonically_increasing_id()), F.lit(n)).cast("int")
    dealt = docs.select(g.alias("g"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sent = "b int, g int, v binary"
    hits = dealt.groupBy("g").applyInArrow(send_probes, sent).groupBy("b").applyInArrow(answer_probes, "g int, b int, v binary")
    wide = dealt.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(send_windows, sent)
    repeated = wide.groupBy("b").applyInArrow(answer_windows, "g int, v binary")
    out = f"doc_id {id_type}, text string, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>"
    return dealt.groupBy("g").cogroup(repeated.groupBy("g")).applyInArrow(remove, out)


def _bits(table: pa.Table, parts: list[np.ndarray], flags: np.ndarray) -> pa.Table:
    ends = np.cumsum([len(p) for p in parts])
    rows = [(g, b, flags[e - len(p) : e]) for g, b, p, e in zip(table.column("g").to_pylist(), table.column("b").to_pylist(), parts, ends, strict=True)]
    rows = [(g, b, np.packbits(f).tobytes()) for g, b, f in rows if f.any()]
    return pa.table({"g": pa.array([r[0] for r in rows], pa.int32()), "b": pa.array([r[1] for r in rows], pa.int32()), "v": pa.array([r[2] for r in rows], pa.binary())})


def _read_bits(table: pa.Table, bucket: np.ndarray) -> np.ndarray:
    """Flags of a group's distinct hashes, from the answers of the buckets."""
    flags = np.zeros(len(bucket), dtype=bool)
    for b, v in zip(table.column("b").to_pylist(), table.column("v").to_pylist(), strict=True):
        s, e = np.searchsorted(bucket, [b, b + 1])
        flags[s:e] = np.unpackbits(np.frombuffer(v, dtype=np.uint8), count=e - s)
    return flags
