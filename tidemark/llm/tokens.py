"""Token ids of whole texts by a public tokenizer file, with Arrow and numpy instead of a loop over words.

The word-level tokenizer drops white space and splits texts by a pattern that never crosses it, so the ids of a text are
those of its white-space separated chunks in turn. Of a batch of texts only the distinct chunks are looked at. A chunk of
Latin letters and trailing ASCII punctuation is two words, each of which is one pre-token and ends at an id with the
end-of-word mark; so many new words are encoded in one call and cut at the marks, and a worker keeps at most GENERATION
of them. Any other chunk goes to the plain tokenizer as it is. A tokenizer of another kind encodes whole texts.
"""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker keeps the ids of, at most, between batches.
GENERATION = 400_000
#: Bytes of text that are encoded together.
TEXTS_AT_ONCE = 8_000_000
#: Words in one call of the tokenizer.
_CALL = 2_000
#: The capital I with a dot becomes two characters in lower case, of which the second splits the word.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1)
_ENCODERS: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _joined(lists: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(lists) if lists else np.empty(0, "<u4")


def _edges(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        split = json.dumps(spec.get("pre_tokenizer") or {})
        self.by_word = bool(suffix) and "\\\\s" in split and '"behavior": "Removed"' in split
        if self.by_word:
            from tokenizers import normalizers, pre_tokenizers

            #: For lower-case Latin words and marks, of which each is one pre-token: nothing is left to normalise or split.
            self.single = Tokenizer(self.tokenizer.model)  # the same model, held once
            self.single.normalizer = normalizers.Sequence([])
            self.single.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 16, bool)
            self.ends[[i for w, i in spec["model"]["vocab"].items() if w.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        """The cache: a word's number, and by numbers the edges of the words' ids in ``ids``. The empty word is number 0."""
        self.number: dict[str, int] = {"": 0}
        self.edges, self.ids = np.zeros(2, np.int64), np.empty(0, "<u4")

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and edges of ``words``, of which each is one pre-token."""
        ids, counts = [], []
        for start in range(0, len(words), _CALL):
            part = words[start : start + _CALL]
            own = np.asarray(self.single.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[own]) + 1
            if len(cut) != len(part):  # a word was not one pre-token after all
                each = [np.frombuffer(x, "<u4") for x in self.plain(part)]
                own, cut = _joined(each), np.cumsum([len(x) for x in each], dtype=np.int64)
            ids.append(own)
            counts.append(np.diff(cut, prepend=0))
        return _joined(ids), _edges(np.concatenate(counts) if counts else np.empty(0, np.int64))

    def _learn(self, words: list[str]) -> np.ndarray:
        """The number of each of ``words``; new ones enter the cache, which starts anew when it is full."""
        if len(self.number) > GENERATION:
            self._forget()
        new = [w for w in words if w not in self.number]
        if new:
            ids, edges = self._ids_of(new)
            first = len(self.number)
            self.number.update(zip(new, range(first, first + len(new)), strict=True))
            self.edges = np.concatenate((self.edges, self.edges[-1] + edges[1:]))
            self.ids = np.concatenate((self.ids, ids))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The table of ids, its edges, and the two places in it of every chunk of ``chunks`` (distinct)."""
        core = pc.utf8_rtrim(chunks, characters=string.punctuation)
        marks = pc.utf8_ltrim(chunks, characters=_LETTERS)
        easy = pc.equal(pc.add(pc.binary_length(core), pc.binary_length(marks)), pc.binary_length(chunks))
        both = pa.concat_arrays([pc.utf8_lower(core.filter(easy)), marks.filter(easy)]).dictionary_encode()
        places = self._learn(both.dictionary.to_numpy(zero_copy_only=False).tolist())[both.indices.to_numpy()]
        odd = self.plain(chunks.filter(pc.invert(easy)).to_pylist())
        edges = np.concatenate((self.edges, self.edges[-1] + np.cumsum([len(x) // 4 for x in odd], dtype=np.int64))) if odd else self.edges
        table = np.concatenate((self.ids, *(np.frombuffer(x, "<u4") for x in odd))) if odd else self.ids
        pair = np.zeros((len(chunks), 2), np.int64)
        at = np.flatnonzero(easy.to_numpy(zero_copy_only=False))
        pair[at, 0], pair[at, 1] = places[: len(at)], places[len(at) :]
        rest = np.ones(len(chunks), bool)
        rest[at] = False
        pair[rest, 0] = len(self.edges) - 1 + np.arange(len(odd))
        return table, edges, pair

    def encode(self, texts: pa.Array, lengths_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """The ids of all ``texts`` in one array, and the edges between the texts' ids; a null text is an empty one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_word:
            raw = self.plain(texts.to_pylist())
            return np.frombuffer(b"".join(raw), "<u4"), _edges(np.asarray([len(x) // 4 for x in raw], np.int64))
        lists = pc.ascii_split_whitespace(texts)
        held = lists.flatten().dictionary_encode()  # the split leaves empty strings at a text's ends
        table, edges, pair = self._chunks(held.dictionary)
        words = pair[held.indices.to_numpy()].ravel()
        counts = (edges[1:] - edges[:-1])[words]
        before = _edges(counts)
        offsets = lists.offsets.to_numpy()
        of_texts = before[2 * (offsets - offsets[0])]
        if lengths_only:
            return None, of_texts
        return table[np.repeat(edges[words] - before[:-1], counts) + np.arange(before[-1])], of_texts


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it stays for the worker's later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def parts_of(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of TEXTS_AT_ONCE bytes, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, done + TEXTS_AT_ONCE, "right")), start + 1)
        yield texts[start:stop]
        start = stop


def encode_all(texts: Iterable[str | None], path: str) -> Iterator[bytes]:
    """The little-endian 32-bit ids of each text in turn; null counts as empty."""
    for part in parts_of(pa.array(texts, pa.large_string())):
        ids, edges = encoder(path).encode(part)
        yield from (ids[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False))
