"""Hashed word shingles and one-permutation sketches, on numpy arrays of bytes."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

U = np.uint64
#: Bytes of text hashed at once; a longer text is hashed part by part, cut between words (so only a word may be longer).
CHUNK = 1 << 17
#: Odd multiplier of the rolling word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
SPACES = (0x20, *range(0x09, 0x0E))
GAP = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def byte_codes() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit code per byte, A-Z as a-z; and which bytes are white space."""
    lower = np.arange(256)
    lower[65:91] += 32
    codes = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))[lower]
    space = np.zeros(256, dtype=bool)
    space[list(SPACES)] = True
    return codes, space


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    size = max(n, CHUNK + 1)
    if size > CHUNK + 1 or size not in _POWERS:
        made = tuple(np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, U(b))])) for b in (BASE, BASE_INVERSE))
        if size > CHUNK + 1:
            return made  # for one long text; not kept
        _POWERS[size] = made
    return _POWERS[size]


def parts_of(texts: list[bytes]):
    """(number of the text, part): texts, long ones cut at white space after CHUNK bytes each."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > CHUNK:
            gap = GAP.search(t, at + CHUNK)
            end = gap.start() if gap else len(t)
            yield i, t[at:end]
            at = end
        yield i, t[at:] if at else t


def chunks(texts: list[bytes]):
    """Runs of (number, part) of about CHUNK bytes together."""
    run, size = [], 0
    for i, t in parts_of(texts):
        if run and size + len(t) + 1 > CHUNK:
            yield run
            run, size = [], 0
        run.append((i, t))
        size += len(t) + 1
    if run:
        yield run


def _hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes (the last one white space) start, and their hashes."""
    codes, space = byte_codes()
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space[raw]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    total = codes[raw]
    total *= up[:len(raw)]
    np.cumsum(total, out=total)
    words = total[end - 1]
    words[start > 0] -= total[start[start > 0] - 1]
    words *= down[start]
    words += (end - start).astype(U)
    return start, mix(words)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Per text the 64-bit hashes of its words, in order."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for run in chunks(texts):
        start, words = _hashes(np.frombuffer(b"\n".join(t for _, t in run) + b"\n", dtype=np.uint8))
        bounds = np.cumsum([len(t) + 1 for _, t in run])[:-1]
        for (i, _), own in zip(run, np.split(words, np.searchsorted(start, bounds))):
            out[i].append(own)
    return [own[0] if len(own) == 1 else np.concatenate(own) for own in out]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words; fewer words make one
    shingle of the whole sequence, none make an empty set."""
    n = min(size, len(words))
    if not n:
        return np.empty(0, dtype=U)
    total = np.zeros(len(words) - n + 1, dtype=U)
    for i in range(n):
        total = total * U(0x2545F4914F6CDD1D) + words[i:i + len(total)]
    return np.unique(mix(total + U(n)))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    return [shingle_set(w, size) for w in word_hashes([(t or "").encode() for t in texts])]


@lru_cache(maxsize=4)
def probe_order(bins: int) -> np.ndarray:
    """rank[i, j]: when bin i, being empty, asks bin j (a random order for each i)."""
    keys = mix(np.arange(bins * bins, dtype=U) * U(0xA0761D6478BD642F) + U(7)).reshape(bins, bins)
    return keys.argsort(axis=1).argsort(axis=1).astype(np.int32)


def one_permutation(found: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each of ``bins`` equal ranges of the hash space; an empty
    bin takes that of the first non-empty bin in its own random order (optimal
    densification: bins borrow independently of each other). ``found``: sorted, not empty."""
    bin_of = ((found >> U(40)) * U(bins)) >> U(24)
    first = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]]))
    full = bin_of[first].astype(np.int64)
    if len(full) == bins:
        return found[first]
    sketch = np.zeros(bins, dtype=U)
    sketch[full] = found[first]
    empty = np.setdiff1d(np.arange(bins), full, assume_unique=True)
    lender = full[probe_order(bins)[np.ix_(empty, full)].argmin(axis=1)]
    sketch[empty] = sketch[lender]
    return sketch


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band; equal bands of two sketches have equal keys."""
    rows = sketch.reshape(bands, -1)
    total = np.arange(1, bands + 1, dtype=U)
    for i in range(rows.shape[1]):
        total = mix(total * U(0x2545F4914F6CDD1D) + rows[:, i])
    return total
