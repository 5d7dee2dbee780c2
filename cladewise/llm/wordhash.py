"""Word positions and 64-bit word hashes of a batch of texts, in whole-array numpy steps.

Works on the UTF-8 buffers of an Arrow string array. A byte table maps each byte to its lower-case
form (A-Z only) or to 0 for a separator, so words, hashes and n-grams need no loop over texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
#: Bytes of text that are worked on at once; a longer text stands alone.
CHUNK_BYTES = 1 << 19


def _table(separators: list[int]) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[separators] = 0
    return out


#: Words [^\x20\x09-\x0D]+ ; byte 0 is a word byte there, so it gets a free value (0xFF never stands in UTF-8).
BLANK_WORDS = _table([32, 9, 10, 11, 12, 13])
BLANK_WORDS[0] = 255
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, letters, everything beyond ASCII.
ALNUM_WORDS = _table([b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def text_chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about ``size`` bytes; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends (exclusive), and the index of each text's first word (one more at the end)."""
    low = table[data]
    inside = low != 0
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets[:-1]] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    last = np.zeros(len(data) + 1, dtype=bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(inside & (~after | last[1:])) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 2 * CHUNK_BYTES), ODD, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes; equal words get equal hashes in every batch and process."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    reverse = powers(len(low))[::-1]  # weight of byte i is ODD^(n-1-i)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * reverse, dtype=np.uint64)))
    raw = total[ends] - total[starts]
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    # Divide by ODD^(n - end): multiply by the inverse's power.
    back = _inverse_powers(len(low) + 1, inverse)
    return mix(raw * back[len(low) - ends] + (ends - starts).astype(np.uint64))


_INVERSE = np.ones(1, dtype=np.uint64)


def _inverse_powers(n: int, inverse: np.uint64) -> np.ndarray:
    global _INVERSE
    if len(_INVERSE) < n:
        p = np.full(max(n, 2 * CHUNK_BYTES), inverse, dtype=np.uint64)
        p[0] = 1
        _INVERSE = np.multiply.accumulate(p)
    return _INVERSE[:n]


def gram_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, the text of each and its first word's index in the text."""
    count = np.maximum(np.diff(bounds) - (k - 1), 0)
    text = np.repeat(np.arange(len(count)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = bounds[text] + within
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        h = mix(h * ODD + words[at + j] + np.uint64(j + 1))
    return h, text, within
