"""Words and five-word shingles of many texts at once, as numpy arrays.

Words are runs of bytes other than the ASCII blanks ``\\x09-\\x0D`` and
``\\x20`` of a text's UTF-8 form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in a shingle; bytes of text hashed at a time.
WORDS, BLOCK = 5, 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << 12) - 1, _MIX)]), dtype=np.uint64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = np.where(_BLANK, np.uint64(0), mixed(np.arange(1, 257)))


def portions(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Slices (first, end) of ``texts`` of about ``most`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, a = np.cumsum(sizes, dtype=np.int64), 0
    while a < len(ends):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + most, "right")))
        b = min(b, a + 4096)
        yield a, b
        a = b


def _block(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at ``starts`` (the first at 0)."""
    sizes = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    long = int(sizes.max()) > len(_POWERS)
    value = _BYTE[data] * _POWERS[place & (len(_POWERS) - 1) if long else place]
    if long:  # words over 4096 bytes: each 4096 count apart
        value = mixed(value + (place >> 12).astype(np.uint64)) * (value != 0)
    return mixed(np.add.reduceat(value, starts))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """uint64 hashes of all words, and where each text's words begin in them
    (one bound more than texts).  Null texts have no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.empty(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    out, i = [np.empty(0, dtype=np.uint64)], 0
    while i < len(starts):  # blocks that end before a word, one word at least
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        end = starts[j] if j < len(starts) else len(data)
        out.append(_block(data[starts[i] : end], starts[i:j] - starts[i]))
        i = j
    return np.concatenate(out), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the ``WORDS`` words from each place on."""
    n = len(words) - WORDS + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        out = (out + words[k : k + n]) * _MIX + np.uint64(k)
    return mixed(out)


def shingle_sequence(text: str | None) -> np.ndarray:
    """Shingle hashes of one text, in order."""
    return shingle_hashes(word_hashes(pa.array([text], pa.string()))[0])


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; a text of fewer than ``WORDS``
    words has one shingle of all its words, one without words none."""
    words, bounds = word_hashes(texts)
    whole, out = shingle_hashes(words), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(whole[a : b - WORDS + 1]))
        elif b > a:
            few = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                few = mixed(few + words[i : i + 1])
            out.append(few)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
