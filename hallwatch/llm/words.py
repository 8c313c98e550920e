"""Words of Arrow text columns as NumPy arrays: byte spans, 64-bit hashes, rolling window hashes.

Everything works on the UTF-8 bytes of whole texts. A null text counts as empty. Word hashes are polynomial
(a random value per byte, an odd multiplier modulo 2^64), so all words of a batch come from one prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19  # bytes of text handled at once; a longer text is a chunk of its own

_BYTE_VALUES = np.random.RandomState(20240101).randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_STEP, _WORD_STEP = 0x9E3779B97F4A7C15 & ~7 | 3, 0xD6E8FEB86659FD93 & ~7 | 3
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: everything in ASCII but digits and letters
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the word."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) ^ (h >> np.uint64(17))


def _steps(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(step)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        ways = []
        for base in (step, pow(step, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            ways.append(np.multiply.accumulate(p))
        have = _powers[step] = (ways[0], ways[1])
        if size > CHUNK_BYTES + 1:  # one very long text: do not keep its tables
            _powers.pop(step)
    return have


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text); words never cross texts."""
    n = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    word = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, ~word[:-1]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, ~word[1:]
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = _steps(_BYTE_STEP, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text), in chunks of bounded memory."""
    hashes, counts = [], []
    for i, j in chunks(offsets):
        part = data[offsets[i]:offsets[j]]
        part = LOWER[part] if lower else part
        starts, ends, n = spans(part, offsets[i:j + 1] - offsets[i], separators)
        hashes.append(hash_spans(part, starts, ends))
        counts.append(n)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def owners(counts: np.ndarray) -> np.ndarray:
    """The text of every word."""
    return np.repeat(np.arange(len(counts)), counts)


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every window of ``width`` consecutive words of one text (Rabin-Karp)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = owners(counts)
    first = np.flatnonzero(text[:n] == text[width - 1:])
    up, down = _steps(_WORD_STEP, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=total[1:])
    return mix((total[first + width] - total[first]) * down[first]), first


def distinct_within(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, value), sorted by both; ``group`` is ascending."""
    if len(values) == 0:
        return values, group
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    return v[keep], g[keep]
