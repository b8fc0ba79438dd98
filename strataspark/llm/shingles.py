"""Word shingles and MinHash values of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text handled at once, unless one text is longer
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2, _STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(1, 257, dtype=np.uint64)
_FOLD[65:91] = np.arange(98, 124)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, CHUNK) + 1, base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words (one run of all words, if fewer), and how many each text has.

    Words are what blanks part, A-Z lower-cased. A word's hash is a polynomial of its bytes mod 2**64, mixed."""
    n = len(offsets) - 1
    blank = _BLANK[data]
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[inner] = ~blank[inner]
    last[inner - 1] = ~blank[inner - 1]
    b, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_FOLD[data] * _power(_BASE, len(data)), out=sums[1:])
    words = mix((sums[e] - sums[b]) * _power(_INVERSE, len(data) + 1)[b])
    of = np.searchsorted(b, offsets)  # words before each text
    per = np.diff(of)
    run = words.copy()
    short = np.flatnonzero((per > 0) & (per < width))
    for k in range(1, width):
        run[: len(words) - k] = mix(run[: len(words) - k] * _STEP + words[k:]) if k < len(words) else run[: len(words) - k]
    keep = np.zeros(len(words) + 1, np.int64)
    full = np.maximum(per - width + 1, 0)
    starts, stops = of[:-1], of[:-1] + full
    np.add.at(keep, starts[full > 0], 1)
    np.add.at(keep, stops[full > 0], -1)
    mask = np.cumsum(keep[:-1]) > 0
    for i in short:
        x = words[of[i] : of[i] + 1].copy()
        for w in words[of[i] + 1 : of[i + 1]]:
            x = mix(x * _STEP + w)
        run[of[i]] = mix(x + np.uint64(per[i]))[0]
        mask[of[i]] = True
    return run[mask], np.where(per >= width, full, (per > 0).astype(np.int64))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of an Arrow string column: first and last row, bytes, offsets."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def minhash(run: np.ndarray, counts: np.ndarray, hashes: int, seed: int = 11) -> np.ndarray:
    """A row of MinHash values for each text; texts without shingles have the largest value throughout."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 2**31, hashes, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    b = rng.integers(0, 2**32, hashes, dtype=np.uint32)
    out = np.full((len(counts), hashes), np.uint32(2**32 - 1))
    has = np.flatnonzero(counts)
    if len(has):
        starts = (np.cumsum(counts) - counts)[has]
        x = (run >> np.uint64(32)).astype(np.uint32)
        low = run.astype(np.uint32)
        for k in range(hashes):
            out[has, k] = np.minimum.reduceat((x * a[k] + b[k]) ^ (low >> np.uint32(k % 13)), starts)
    return out


def bands(values: np.ndarray, width: int) -> np.ndarray:
    """Keys of runs of width MinHash values, different from run to run."""
    n = values.shape[1] // width
    key = np.zeros((len(values), n), np.uint64) + np.arange(1, n + 1, dtype=np.uint64) * _STEP
    for k in range(width):
        key = mix(key * _STEP + values[:, k::width][:, :n])
    return key.view(np.int64)
