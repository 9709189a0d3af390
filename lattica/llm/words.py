"""Words of a batch of texts and their 64-bit hashes, found for the whole batch at once by numpy, without a table of words.

A word is what stands between `[\\x20\\x09-\\x0D]` bytes of the UTF-8 text. Its hash is the sum of a random number for each
(byte, place in the word), mixed at the end. What is held beside the texts is about 25 bytes for each byte of a slice of SLICE bytes, and 20 for
each word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once.
SLICE = 1 << 20
#: Rows and bytes of the batches that go to Python workers, where the session leaves Spark's defaults.
ROWS, BYTES = 1_000, "8m"

_PLACES = 64
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1: ASCII letters, 2: ASCII symbols but the apostrophe, 0: all else.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[x for x in range(33, 127) if not chr(x).isalnum() and x != 39]] = 2

_TABLE = np.random.default_rng(20).integers(1, 1 << 64, (_PLACES, 256), np.uint64)
_TABLE[:, _BLANK] = 0
_TABLE = _TABLE.reshape(-1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[0]
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """hashes, first bytes (in data) and lengths of the words; of text i those from ends[i] to ends[i + 1]."""

    data: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    lengths: np.ndarray
    ends: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.ends[i] : self.ends[i + 1]]

    def __iter__(self):
        """The hashes of each text."""
        return (self.of(i) for i in range(len(self.ends) - 1))

    def word(self, k: int) -> bytes:
        return self.data[self.at[k] : self.at[k] + self.lengths[k]].tobytes()


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of an Arrow array of strings or binaries; null counts as empty."""
    n, kind = len(texts), np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, places, data = texts.buffers()
    if not n or data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(places, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _cut(data: np.ndarray, texts: np.ndarray, at: int) -> int:
    """The first place from `at` on where no word is cut."""
    stop = int(texts[np.searchsorted(texts, at)])
    while at < stop:
        blank = np.flatnonzero(_BLANK[data[at : min(stop, at + SLICE)]])
        if len(blank):
            return at + int(blank[0])
        at = min(stop, at + SLICE)
    return at


def split_words(texts: pa.Array, lower: bool = True, split: bool = False) -> Words:
    """lower: A-Z count as a-z. split: a word also ends between an ASCII letter and an ASCII symbol other than the apostrophe."""
    data, texts_at = text_buffers(texts)
    hashes, places, lengths, a = [], [], [], 0
    while a < len(data):
        e = _cut(data, texts_at, min(len(data), a + SLICE))
        part = data[a:e]
        blank = _BLANK[part]
        first = ~blank
        inner = texts_at[np.searchsorted(texts_at, a, "right") : np.searchsorted(texts_at, e)] - a
        begins = first[inner]
        if split:
            kind = _KIND[part]
            first[1:] &= blank[:-1] | (kind[1:] + kind[:-1] == 3)
        else:
            first[1:] &= blank[:-1]
        first[inner] = begins
        start = np.flatnonzero(first)
        if len(start):
            place = np.arange(len(part), dtype=np.int32) - start.astype(np.int32)[np.cumsum(first, dtype=np.int32) - 1]
            x = _TABLE[((place & (_PLACES - 1)) << 8) | (_LOWER[part] if lower else part)]
            far = np.flatnonzero(place >= _PLACES)
            if len(far):
                x[far] *= (place[far] // _PLACES).astype(np.uint64) * (_M[1] & ~np.uint64(1)) + np.uint64(1)
            hashes.append(mixed(np.add.reduceat(x, start)))
            places.append(start + a)
            lengths.append(np.add.reduceat((~blank).view(np.uint8), start, dtype=np.int64))
        a = e
    none = np.empty(0, np.int64)
    at = np.concatenate([*places, none])
    return Words(data, np.concatenate([*hashes, np.empty(0, np.uint64)]), at, np.concatenate([*lengths, none]), np.searchsorted(at, texts_at))


def bounded_batches(spark) -> None:
    """Batches for Python workers hold ROWS rows and BYTES at most, unless the session asks for other than Spark's default: texts can be long."""
    for key, default, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(ROWS)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", BYTES)):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
