"""Words of byte texts as numpy arrays: places, 64-bit hashes, hashes of runs of words.

A word is a maximal run of bytes other than space and \\t..\\r, which is what bytes.split() takes.
Work goes through the bytes in slices of a few megabytes, cut between words, so memory stays bounded
for any text length.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_U = np.uint64
_rng = np.random.RandomState(20240607)
_TABLES = [(_rng.randint(0, 2**63, 256).astype(_U) << _U(1)) ^ _rng.randint(0, 2**63, 256).astype(_U) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03 | 1]
_RUN = [_U(0xBF58476D1CE4E5B9 | 1), _U(0x94D049BB133111EB | 1)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pow(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _powers or len(_powers[which][0]) < n:
        n = max(n, SLICE + 4096)
        base = _BASES[which]
        up = np.full(n, base, _U)
        up[0] = 1
        down = np.full(n, pow(base, -1, 1 << 64), _U)
        down[0] = 1
        _powers[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[which]


def words(texts: list[bytes | None], hashes: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """(counts, hashes): words per text, and for each asked hash one uint64 per word in order. None has no word."""
    blob = b"\n".join(t or b"" for t in texts)
    ends = np.cumsum(np.array([len(t or b"") + 1 for t in texts], np.int64)) if texts else np.zeros(0, np.int64)
    data = np.frombuffer(blob, np.uint8)
    starts_all, out = [], [[] for _ in range(hashes)]
    at = 0
    while at < len(data):
        to = min(len(data), at + SLICE)
        while to < len(data) and not _SPACE[data[to]]:  # the slice ends between words
            more = np.flatnonzero(_SPACE[data[to : to + 65536]])
            to = to + (int(more[0]) if len(more) else min(65536, len(data) - to))
        part = data[at:to]
        gap = _SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        first, last = edge[0::2], edge[1::2]
        starts_all.append(first + at)
        for k in range(hashes):
            up, down = _pow(k, len(part) + 1)
            total = np.zeros(len(part) + 1, _U)
            np.cumsum(_TABLES[k][part] * up[: len(part)], out=total[1:])
            out[k].append(mix((total[last] - total[first]) * down[first]))
        at = to
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends)))) if len(ends) else np.zeros(0, np.int64)
    return counts.astype(np.int64), [np.concatenate(h) if h else np.zeros(0, _U) for h in out]


def runs(word_hash: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of the run of length words from each position on; the last length-1 positions have none."""
    n = len(word_hash) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for k in range(length):
        total *= _RUN[which]
        total += word_hash[k : k + n]
    return mix(total)


def inside(counts: np.ndarray, length: int) -> np.ndarray:
    """Whether the run of length words from each position on stays in one text."""
    n = int(counts.sum()) - length + 1
    if n <= 0:
        return np.zeros(0, bool)
    text = np.repeat(np.arange(len(counts)), counts)
    return text[:n] == text[length - 1 :]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over width neighbours from each position on."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def slices(sizes: list[int], most: int):
    """Ranges [i, j) of consecutive items of at most `most` in sum, one item at least."""
    i = total = 0
    for j, s in enumerate(sizes):
        if j > i and total + s > most:
            yield i, j
            i, total = j, 0
        total += s
    if i < len(sizes):
        yield i, len(sizes)


def portions(batches, rows: int = 500, size: int = 4 << 20):
    """The batches in slices of a few hundred rows and about `size` bytes, so that their Python objects never exist for a whole batch at once.

    At the end the worker gives back the memory it no longer uses: Spark keeps idle workers alive.
    """
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)
    give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
