"""Token ids of a word-level BPE tokenizer, one word or run of symbols at a time.

The tokenizer drops white space, its pre-token pattern never crosses white space nor the border between an ASCII letter and an ASCII
symbol other than the apostrophe, and each pre-token is merged alone, so a text's ids are its words' ids in order. A word's ids are found
once and kept by the word's 64-bit hash (about 25 bytes a word); texts with added special strings go to the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lattica.llm.words import Words, split_words, text_buffers

TOKENIZER = "word_bpe_49k.json"

_loaded: dict = {}


def tokenizer_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def load(path: str | None = None):
    """The tokenizer, loaded once in each Python worker."""
    from tokenizers import Tokenizer

    path = tokenizer_path(path)
    if path not in _loaded:
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


class WordIds:
    """Ids of the words met, in two sorted tables of hashes: a large one, and a young one that is merged into it now and then.

    Beyond max_words all are forgotten.
    """

    def __init__(self, path: str | None = None, max_words: int = 1_000_000):
        self.tokenizer, self.max_words = load(path), max_words
        self._forget()

    def _forget(self) -> None:
        empty = (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.old, self.young = empty, empty
        self.ids, self.size = np.empty(1 << 16, np.uint32), 0  # an entry: the number of ids, then the ids

    def _places(self, words: Words) -> np.ndarray:
        """Place of each word's entry."""
        if len(self.old[0]) + len(self.young[0]) > self.max_words:
            self._forget()
        u, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.full(len(u), -1, np.int64)
        for h, place in (self.old, self.young):
            if len(h):
                k = np.minimum(np.searchsorted(h, u), len(h) - 1)
                found = h[k] == u
                at[found] = place[k[found]]
        new = np.flatnonzero(at < 0)
        if len(new):
            encode, entries = self.tokenizer.encode, []
            for k in first[new].tolist():
                ids = encode(words.word(k).decode("utf-8", "replace"), add_special_tokens=False).ids
                entries.append(len(ids))
                entries += ids
            entries = np.array(entries, np.uint32)
            lengths, p = np.empty(len(new), np.int64), 0
            for k in range(len(new)):
                lengths[k] = p
                p += int(entries[p]) + 1
            while self.size + len(entries) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint32)])
            self.ids[self.size : self.size + len(entries)] = entries
            at[new] = self.size + lengths
            self.size += len(entries)
            self.young = self._merged(self.young, (u[new], at[new]))
            if len(self.young[0]) > 100_000:
                self.old, self.young = self._merged(self.old, self.young), (np.empty(0, np.uint64), np.empty(0, np.int64))
        return at[back]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        h, at = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(h, kind="stable")
        return h[order], at[order]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (strings or binaries in UTF-8; null: none)."""
        words = split_words(texts, lower=True, split=True)
        at = self._places(words)
        n = self.ids[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.repeat(at + 1 - ends[:-1], n) + np.arange(ends[-1])]
        out = np.split(flat, ends[words.ends[1:-1]]) if len(texts) else []
        data, texts_at = text_buffers(texts)
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|": perhaps an added special string, told by case
        for k in np.unique(np.searchsorted(texts_at, special, "right") - 1).tolist():
            text = data[texts_at[k] : texts_at[k + 1]].tobytes().decode("utf-8", "replace")
            out[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


def word_ids(path: str | None = None) -> WordIds:
    """One table for each Python worker and tokenizer."""
    key = ("ids", tokenizer_path(path))
    if key not in _loaded:
        _loaded[key] = WordIds(path)
    return _loaded[key]
