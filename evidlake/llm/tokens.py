"""Token ids of whole texts with a public tokenizer, word by word from a cache where its form allows it.

Tokenizers of the form FORM drop white space and split letters from other characters before merging, so
the ids of a text are those of its words in order. Words of Latin letters, perhaps followed by ASCII
marks, are split once more there; their lower-case letters are encoded many at a time and told apart by
the tokens that end a word. Everything else is encoded as it stands. Words and ids stay in Arrow arrays,
so that the work in Python is per new word. Caches are bounded in bytes: one that is full is cut to what
the latest texts used. A tokenizer of any other form encodes whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BYTES = 16 << 20
CORE_BYTES = 8 << 20
CHUNK = 1000
END = 2
BYTES = pa.large_binary()
AS_TEXT = pc.CastOptions(pa.large_string(), allow_invalid_utf8=True)
SIMPLE = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"

#: The normalizer and pre-tokenizer of tokenizers that can be applied word by word.
FORM = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(spec: dict) -> bool:
    """Whether a tokenizer, as read from its file, has the form that makes words independent."""
    parts = ((spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers"))
    plain = all(spec.get(x) is None for x in ("post_processor", "truncation", "padding"))
    model = spec["model"]
    return plain and parts == (FORM["normalizer"], FORM["pretokenizers"]) and model.get("type", "BPE") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout")


class Cache:
    """Values by key in two Arrow arrays of at most `most` bytes."""

    def __init__(self, most: int):
        self.most = most
        self._set(pa.array([], BYTES), pa.array([], BYTES))

    def _set(self, keys: pa.Array, values: pa.Array) -> None:
        self.keys, self.values = keys, values

    def get(self, keys: pa.Array, make: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """Values of distinct keys; make gives those of the unknown ones."""
        at, known = pc.index_in(keys, self.keys), len(self.keys)
        new = keys.filter(pc.is_null(at))
        every, values = self.keys, self.values
        if len(new):
            every, values = pa.concat_arrays([every, new]), pa.concat_arrays([values, make(new)])
        place = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = known + np.arange(len(new))
        out = values.take(pa.array(place))
        if every.nbytes + values.nbytes > self.most:
            every, values = (keys, out) if keys.nbytes + out.nbytes <= self.most else (keys[:0], out[:0])
        self._set(every, values)
        return out


class WordTokens:
    """ids(texts) for texts as bytes; width is 2 bytes an id where the vocabulary allows, else 4."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values()) < 1 << 16 and END < 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.words, self.cores = Cache(WORD_BYTES), Cache(CORE_BYTES)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_words = by_words(spec)
        if self.by_words:
            model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            # The same merges for words that are normalized and split already; words come once, so its own cache is off.
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.merge = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=suffix))
            self.merge.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), CHUNK):  # what the library returns is far larger than the ids
            out += [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts[at : at + CHUNK], add_special_tokens=False)]
        return out

    def _plain(self, words: pa.Array) -> pa.Array:
        return pa.array(self._encode([w.decode("utf-8", "replace") for w in words.to_pylist()]), BYTES)

    def _merged(self, cores: pa.Array) -> pa.Array:
        """Ids of words of lower-case letters."""
        out = []
        for at in range(0, len(cores), CHUNK):
            part = cores.slice(at, CHUNK)
            text = b" ".join(part.to_pylist()).decode()
            ids = np.array(self.merge.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                out.append(pa.Array.from_buffers(BYTES, len(part), [None, pa.py_buffer(np.r_[0, cut] * self.width), pa.py_buffer(ids)]))
            else:
                out.append(self._plain(part))
        return pa.concat_arrays(out) if out else pa.array([], BYTES)

    def _learn(self, words: pa.Array) -> pa.Array:
        parts = pc.extract_regex(pc.cast(words, options=AS_TEXT), SIMPLE)
        simple = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        fit = parts.filter(pa.array(simple))
        cores = pc.utf8_lower(pc.struct_field(fit, "core")).cast(BYTES).dictionary_encode()
        marks = pc.struct_field(fit, "marks").cast(BYTES).dictionary_encode()
        first = self.cores.get(cores.dictionary, self._merged).take(cores.indices)
        last = self._plain(marks.dictionary).take(marks.indices)
        found = pa.concat_arrays([pc.binary_join_element_wise(first, last, pa.scalar(b"", BYTES)), self._plain(words.filter(pa.array(~simple)))])
        place = np.empty(len(words), dtype=np.int64)
        place[simple], place[~simple] = np.arange(len(fit)), np.arange(len(fit), len(words))
        return found.take(pa.array(place))

    def ids(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        """Ids of each text (binary, no nulls) as little-endian integers of `width` bytes, without an end id."""
        if not self.by_words:
            return self._encode([t.decode("utf-8", "replace") for t in (texts if isinstance(texts, list) else texts.to_pylist())])
        texts = pa.array(texts, BYTES) if isinstance(texts, list) else texts
        split = pc.ascii_split_whitespace(pc.cast(texts, options=AS_TEXT))
        coded = split.values.cast(BYTES).dictionary_encode()
        # Taking the ids of the words in order lays those of each text end to end.
        laid = self.words.get(coded.dictionary, self._learn).take(coded.indices)
        _, offsets, data = laid.buffers()
        starts = np.frombuffer(offsets, dtype=np.int64)[laid.offset :]
        at = starts[split.offsets.to_numpy()].tolist() if len(laid) else [0] * (len(texts) + 1)
        data = data.to_pybytes() if data is not None else b""
        out = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        del split, coded, laid, starts, offsets
        pa.default_memory_pool().release_unused()  # a worker lives on after its task, and so would what it has freed
        return out
