"""Token counts by a linear longest-match automaton (LinMaxMatch; Song et al., 2021).

The vocabulary is a trie over symbols. Where no edge fits, a failure link leads to the node of what
remains after popping the longest tokens, and the number of popped tokens was counted beforehand; so
a word's greedy longest-match length is found in one pass over its symbols, and no piece is built.

Vocabularies of two kinds: those that mark word ends (a token ends with `end`, the word gets one more
symbol; where a last piece has no form with the mark, its plain form counts) and those that mark continuations (a token begins with `continuation`). A word that can't be
split into tokens counts as one unknown token.

Edge cases: null and wordless texts have no tokens; very long words are walked like others; repeated
rows are counted one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import memo, picked

END_SYMBOL = 256
CACHE_WORDS = 300_000
UNKNOWN = 1 << 40


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return out


class Automaton:
    """Nodes are numbers; node 0 is the root, node 1 the root of continuations (0 if there are none)."""

    def __init__(self, starts: list[tuple[int, ...]], later: list[tuple[int, ...]] | None = None):
        self.edge: dict[int, int] = {}
        token, depth = [False], [0]
        self.again = 0

        def node() -> int:
            token.append(False)
            return len(token) - 1

        if later is not None:
            self.again = node()
        for root, words in ((0, starts), (self.again, later or [])):
            for word in words:
                at = root
                for s in word:
                    key = at << 9 | s
                    if key not in self.edge:
                        self.edge[key] = node()
                    at = self.edge[key]
                if word:
                    token[at] = True
        self.fail, self.pops = [-1] * len(token), [0] * len(token)
        children: dict[int, list[tuple[int, int]]] = {}
        lone = self.edge.get(0 << 9 | END_SYMBOL)  # the mark that follows a plain last piece is no token of its own
        for key, v in self.edge.items():
            children.setdefault(key >> 9, []).append((key & 511, v))
        queue = [0, self.again] if self.again else [0]
        for u in queue:  # breadth first: a node's parent is done before it
            for s, v in children.get(u, ()):
                if token[v]:
                    self.fail[v], self.pops[v] = self.again, int(v != lone)
                else:
                    z, popped = self.fail[u], 0
                    while z >= 0 and (z << 9 | s) not in self.edge:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.edge[z << 9 | s], self.pops[u] + popped
                queue.append(v)

    def count(self, word) -> int:
        """How many tokens the greedy longest match makes of a word; -1 if it can't."""
        edge, fail, pops = self.edge, self.fail, self.pops
        at = n = 0
        for s in word:
            while (to := edge.get(at << 9 | s)) is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return -1
            at = to
        while at != self.again and len(word):
            n += pops[at]
            at = fail[at]
            if at < 0:
                return -1
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton, end: bool):
        self.automaton, self.tail = automaton, (END_SYMBOL,) if end else ()

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count((*word, *self.tail))
        n = UNKNOWN + 1 if n < 0 else n
        if len(self) < CACHE_WORDS:
            self[word] = n
        return n


def from_tokens(tokens: list[str], *, end: str | None = None, continuation: str | None = None, byte_level: bool = True) -> _Counts:
    of = byte_symbols() if byte_level else None

    def symbols(t: str) -> tuple[int, ...] | None:
        if of is None:
            return tuple(t.encode())
        return tuple(of[c] for c in t) if all(c in of for c in t) else None

    starts, later = [(END_SYMBOL,)] if end else [], [] if continuation else None
    for t in tokens:
        if end and t.endswith(end):
            s = symbols(t.removesuffix(end))
            s = None if s is None else (*s, END_SYMBOL)
        elif continuation and t.startswith(continuation):
            s = symbols(t.removeprefix(continuation))
            if s:
                later.append(s)
            continue
        else:
            s = symbols(t)
        if s:
            starts.append(s)
    return _Counts(Automaton(starts, later), bool(end))


def load(path: str) -> _Counts:
    """Counts for the vocabulary of a tokenizer file that marks word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return from_tokens([t for t in spec["model"]["vocab"] if t not in special], end=spec["model"].get("end_of_word_suffix"))


def token_counts(text: Column, path: str) -> Column:
    """struct(n_words, n_tokens, n_unknown) of whole texts in lower case; path: as for load()."""

    def run(texts: pa.Array) -> pa.Array:
        of = memo(f"pieces:{path}", lambda: load(path))
        words = [(t or "").lower().encode().split() for t in texts.to_pylist()]
        found = np.array([sum(map(of.__getitem__, w)) for w in words], dtype=np.int64)
        cols = [np.array([len(w) for w in words], dtype=np.int64), found & (UNKNOWN - 1), found >> 40]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["n_words", "n_tokens", "n_unknown"])

    return F.arrow_udf(run, "struct<n_words:bigint,n_tokens:bigint,n_unknown:bigint>")(text)


def count_tokens(docs: DataFrame, path: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    return picked(docs, doc_id=id_col, text=text_col).select("doc_id", token_counts(F.col("text"), path).alias("c")).select("doc_id", "c.*")
