"""Periodic runs of words by grammar compression.

A run is a stretch of consecutive words that repeats with a smallest period
(words one period apart are the same), at least ``LEAST`` words and
``PERIODS`` periods long, and that neither neighbour extends.

The word numbers of all documents of an Arrow batch are compressed by Re-Pair
together: in each round a document's most frequent pairs become new symbols,
all those at once that do not compete for a place. What is left of a document
is folded in pairs into one symbol. A run lies within the smallest symbol of the
derivation tree that holds it whole, so it crosses the boundary between the two
parts of that symbol: runs are searched once per symbol, around its boundary
only, carried to all places where the symbol is derived, and merged.

Re-Pair makes no rule of a pair that occurs once, and no run holds one. By the same
argument a run holds no nine words in a row that occur but once in the document
(see ``stretches``); documents are cut there first, which loses no run.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmail.llm.common import python_ready
from sparkmail.llm.shingles import U, mix

#: A run has so many words and periods at least.
LEAST, PERIODS = 24, 3
#: Every window of so many words within a run occurs in it at least twice.
WINDOW = 9
#: Words of an Arrow batch that are compressed together (or one document).
CHUNK = 1 << 18

SCHEMA = ("id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed string, collapsed_sha256 string")


def stretches(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks the words that may lie in a run: those of WINDOW-word windows that occur twice in their document.

    In a run of period q and length L >= max(24, 3 q), a window of L - 2 q + 1 words or
    fewer also fits one period before or after; that number is 9 at least (q = 8).
    """
    n = len(ids) - WINDOW + 1
    marked = np.zeros(len(ids) + 1, dtype=np.int64)
    if n <= 0:
        return marked[:-1].astype(bool)
    codes = mix(ids.astype(U) + U(1))
    key = mix(doc[:n].astype(U) + U(0x51ED2701))
    for i in range(WINDOW):
        key = key * U(0x2545F4914F6CDD1D) + codes[i:i + n]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice & (doc[:n] == doc[WINDOW - 1:]))
    np.add.at(marked, at, 1)
    np.add.at(marked, at + WINDOW, -1)
    return np.cumsum(marked[:-1]) > 0


def _greatest(of: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    np.maximum.at(out, key, of)
    return out


class Grammar:
    """Symbols of two parts each: ``left``, ``right``, ``size`` (words), ``first`` (a place where the symbol is
    derived); ``tops`` has the symbol of each stretch of the input. Words are the numbers below ``base``."""

    def __init__(self, words: np.ndarray, stretch: np.ndarray):
        self.base = int(words.max()) + 1 if len(words) else 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.made = self.base
        self.count = int(stretch[-1]) + 1 if len(stretch) else 0
        sym, at, seg = words.astype(np.int64), np.arange(len(words)), stretch
        size = np.ones(len(words), dtype=np.int64)
        while True:
            chosen, name = self._frequent(sym, seg)
            if not len(chosen):
                break
            sym, at, seg, size = self._replace(sym, at, seg, size, chosen, name)
        while len(sym) > self.count:
            # What is left of each stretch, folded in pairs from its first symbol on.
            head = np.concatenate([[True], seg[1:] != seg[:-1]])
            place = np.arange(len(seg)) - np.maximum.accumulate(np.where(head, np.arange(len(seg)), 0))
            chosen = np.flatnonzero((place[:-1] % 2 == 0) & (seg[1:] == seg[:-1]))
            sym, at, seg, size = self._replace(sym, at, seg, size, chosen, np.arange(len(chosen)))
        # (symbol, place) that derives each stretch.
        self.tops = list(zip(sym.tolist(), at.tolist()))
        self.left, self.right, self.size, self.first = (
            np.concatenate([p[i] for p in self.parts]) if self.parts else np.empty(0, dtype=np.int64) for i in range(4))

    def _frequent(self, sym, seg) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs to replace now and the number of each place's pair (from 0)."""
        none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        place = np.flatnonzero(seg[1:] == seg[:-1])
        if not len(place):
            return none
        # Symbols are shared by stretches, pairs are not: their counts are those of one stretch.
        a, b, own = sym[place], sym[place + 1], seg[place]
        pair = np.unique(a * self.made + b, return_inverse=True)[1].astype(np.int64)
        # Of overlapping equal pairs (a a a) every second one counts.
        follows = np.concatenate([[False], (place[1:] == place[:-1] + 1) & (pair[1:] == pair[:-1]) & (own[1:] == own[:-1])])
        step = np.arange(len(place)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(place))))
        free = step % 2 == 0
        place, pair, own = place[free], pair[free], own[free]
        code, pair, count = np.unique(pair * self.count + own, return_inverse=True, return_counts=True)
        code_seg = code % self.count
        best = _greatest(count, code_seg, self.count)
        top = (count >= 2) & (count == best[code_seg])
        keep = top[pair]
        place, pair = place[keep], pair[keep]
        if not len(place):
            return none
        # Of pairs that overlap somewhere only the one that comes first in a random order is replaced now.
        rank = mix(np.arange(len(code), dtype=U) + U(self.made))
        close = np.flatnonzero(place[1:] == place[:-1] + 1)
        x, y = pair[close], pair[close + 1]
        loser = np.where(rank[x] < rank[y], y, x)[x != y]
        lost = np.zeros(len(code), dtype=bool)
        lost[loser] = True
        keep = ~lost[pair]
        place, pair = place[keep], pair[keep]
        # The same pair in several stretches is one symbol each.
        return place, np.unique(pair, return_inverse=True)[1]

    def _replace(self, sym, at, seg, size, chosen, name):
        first = np.unique(name, return_index=True)[1]
        one = chosen[first]
        self.parts.append((sym[one], sym[one + 1], size[one] + size[one + 1], at[one]))
        sym, size = sym.copy(), size.copy()
        sym[chosen] = self.made + name
        size[chosen] += size[chosen + 1]
        self.made += len(first)
        kept = np.ones(len(sym), dtype=bool)
        kept[chosen + 1] = False
        return sym[kept], at[kept], seg[kept], size[kept]

    def places(self, wanted: set[int]) -> dict[int, np.ndarray]:
        """All places where each of the ``wanted`` symbols is derived. Symbols below LEAST words are not followed."""
        found: dict[int, list[np.ndarray]] = {}
        for s, at in self.tops:
            if s >= self.base:
                found.setdefault(s, []).append(np.array([at]))
        out = {}
        for s in range(self.made - 1, self.base - 1, -1):
            if s not in found:
                continue
            at = np.concatenate(found.pop(s))
            if s in wanted:
                out[s] = at
            left, right = int(self.left[s - self.base]), int(self.right[s - self.base])
            for part, shift in ((left, 0), (right, None)):
                if part >= self.base and self.size[part - self.base] >= LEAST:
                    if shift is None:
                        shift = 1 if left < self.base else int(self.size[left - self.base])
                    found.setdefault(part, []).append(at + shift)
        return out


class Equal:
    """How far two places of ``words`` agree, for many pairs of places at once, by hashes of prefixes."""

    def __init__(self, words: np.ndarray, seed: int):
        odd = U(0x9E3779B97F4A7C15 + 2 * seed)
        self.power = np.multiply.accumulate(np.concatenate([[U(1)], np.full(len(words), odd)]))
        self.total = np.concatenate([[U(0)], np.cumsum(mix(words.astype(U) + U(seed + 1)) * self.power[:-1], dtype=U)])

    def _same(self, i, j, n):
        """Whether the n words from i and from j >= i on are the same."""
        return (self.total[i + n] - self.total[i]) * self.power[j - i] == self.total[j + n] - self.total[j]

    def forward(self, i, j, limit):
        """The most words, ``limit`` at most, that agree from i and j > i on."""
        low, high = np.zeros(len(i), dtype=np.int64), limit.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self._same(i, j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def backward(self, i, j, limit):
        """The same for the words before i and before j > i."""
        low, high = np.zeros(len(i), dtype=np.int64), limit.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self._same(i - mid, j - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def crossing(words: np.ndarray, grammar: Grammar, equal: Equal) -> tuple[np.ndarray, ...]:
    """(symbol, start, end, period) of the runs of each symbol's words that cross its boundary, places being
    those of the symbol's first derivation; of the periods of one stretch only the smallest."""
    long = np.flatnonzero(grammar.size >= LEAST)
    out = []
    step = max(1, CHUNK // max(1, int(grammar.size[long].max() if len(long) else 1)))
    for k in range(0, len(long), step):
        s = long[k:k + step]
        start, size = grammar.first[s], grammar.size[s]
        left = grammar.left[s]
        inner = left >= grammar.base
        cut = start + np.where(inner, grammar.size[np.where(inner, left - grammar.base, 0)], 1)
        most = size // PERIODS
        who = np.repeat(np.arange(len(s)), most)
        q = np.arange(len(who)) - np.repeat(np.cumsum(most) - most, most) + 1
        a, b, c = start[who], cut[who], (start + size)[who]
        for before in (True, False):
            # A run of three periods has a whole one before the boundary or a whole one after it.
            fits = np.flatnonzero(q <= (b - a if before else c - b))
            w, p = who[fits], q[fits]
            i = b[fits] - p if before else b[fits]
            j = i + p
            lo = i - equal.backward(i, j, i - a[fits])
            hi = j + equal.forward(i, j, c[fits] - j)
            ok = (hi - lo >= np.maximum(LEAST, PERIODS * p)) & (lo < b[fits]) & (hi > b[fits])
            out.append((s[w[ok]] + grammar.base, lo[ok], hi[ok], p[ok]))
    symbol, lo, hi, p = (np.concatenate([o[i] for o in out]) if out else np.empty(0, dtype=np.int64) for i in range(4))
    order = np.lexsort((p, hi, lo, symbol))
    symbol, lo, hi, p = symbol[order], lo[order], hi[order], p[order]
    first = np.ones(len(p), dtype=bool)
    first[1:] = (symbol[1:] != symbol[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return symbol[first], lo[first], hi[first], p[first]


def merged(lo: np.ndarray, hi: np.ndarray, p: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal stretches: parts of one run that lie in other symbols go."""
    order = np.lexsort((-hi, lo, p))
    out, last, reach = [], None, -1
    for a, b, q in zip(lo[order].tolist(), hi[order].tolist(), p[order].tolist()):
        if q != last or b > reach:
            out.append((a, b - a, q))
            reach = b
        last = q
    # One stretch with several periods: the smallest, of which the others are multiples.
    least: dict[tuple[int, int], int] = {}
    for a, n, q in out:
        least[a, n] = min(q, least.get((a, n), q))
    return sorted((a, n, q) for (a, n), q in least.items())


def _holds(words: np.ndarray, a: int, n: int, q: int, lo: int, hi: int) -> bool:
    """Whether the words of [a, a + n) have period q and neither neighbour in [lo, hi) extends them."""
    e = a + n
    return bool((words[a:e - q] == words[a + q:e]).all()) and not (a > lo and words[a - 1] == words[a - 1 + q]) \
        and not (e < hi and words[e] == words[e - q])


def find_runs(docs: list[np.ndarray], seed: int = 0) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document of word numbers, by start."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not docs or not sum(map(len, docs)):
        return found
    words = np.concatenate(docs).astype(np.int64)
    first = np.cumsum([0, *map(len, docs)])
    doc = np.repeat(np.arange(len(docs)), np.diff(first))
    open_ = stretches(words, doc)
    edge = np.concatenate([[True], (open_[1:] != open_[:-1]) | (doc[1:] != doc[:-1])])
    number = np.cumsum(edge) - 1
    kept = open_ & (np.bincount(number)[number] >= LEAST)
    place = np.flatnonzero(kept)
    if not len(place):
        return found
    part = words[place]
    seg = np.unique(number[place], return_inverse=True)[1].astype(np.int64)
    grammar = Grammar(np.unique(part, return_inverse=True)[1], seg)
    equal = Equal(part, seed)
    symbol, lo, hi, p = crossing(part, grammar, equal)
    places = grammar.places(set(symbol.tolist()))
    rows = []
    for s, a, b, q in zip(symbol.tolist(), lo.tolist(), hi.tolist(), p.tolist()):
        at = places[s] - grammar.first[s - grammar.base]
        rows.append((a + at, b + at, np.full(len(at), q)))
    if not rows:
        return found
    lo, hi, p = (np.concatenate([r[i] for r in rows]) for i in range(3))
    lo, hi = place[lo], place[hi - 1] + 1
    own = doc[lo]
    order = np.argsort(own, kind="stable")
    for d in np.unique(own).tolist():
        at = order[np.searchsorted(own[order], d):np.searchsorted(own[order], d, "right")]
        runs = merged(lo[at], hi[at], p[at])
        if not all(_holds(words, a, n, q, first[d], first[d + 1]) for a, n, q in runs):
            return find_runs(docs, seed + 1)  # two different stretches of the same 64-bit hash: another hash
        found[d] = [(a - int(first[d]), n, q) for a, n, q in runs]
    return found


def looped(n: int, key) -> tuple[int, int] | None:
    """(a, p) by which a document of n words with id ``key`` is made periodic: words from a on
    become those of the p words at a, over and over; None for nine of ten documents and null ids."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that some run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for a, n, q in runs:
        drop[a + q] += 1
        drop[a + n] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist()) if not d]


def _row(key, words: list[bytes], runs, texts: bool) -> tuple:
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    left = b" ".join(collapse(words, runs))
    return (key, len(words), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            [dict(zip(("start", "length", "period"), r)) for r in runs] if texts else None,
            hashlib.sha256(listed.encode()).hexdigest(), left.decode() if texts else None, hashlib.sha256(left).hexdigest())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loop: bool = False, texts: bool = True) -> DataFrame:
    """(id, n_words, n_runs, start, length, period, exponent_milli, runs, runs_sha256, collapsed, collapsed_sha256)
    for each row of ``docs``.

    Words are runs of anything but ASCII white space, numbered from 0. ``start``, ``length`` and ``period`` are
    those of the run with the most periods (ties: smallest start, then period; null without a run);
    ``collapsed`` is the text without the words that only repeat a run's first period. With ``texts`` false
    ``runs`` and ``collapsed`` are null, which spares their bytes. ``loop`` makes one document in ten
    periodic before (see ``looped``), as a test of the search on given tables.

    A null, empty or blank text has no words and no run. Repeated rows and null ids stay (a null id is not
    looped); an empty table gives an empty result; other columns of ``docs`` are not read.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    runs_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    types = [pa.int64()] * 7 + [runs_type, pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            keys, lists = batch.column(0).to_pylist(), [(t or b"").split() for t in batch.column(1).to_pylist()]
            if loop:
                for k, (key, words) in enumerate(zip(keys, lists)):
                    change = looped(len(words), key)
                    if change:
                        a, p = change
                        again = -(-(len(words) - a) // p)
                        lists[k] = words[:a] + (words[a:a + p] * again)[:len(words) - a]
            at = 0
            while at < len(lists):
                end, total = at, 0
                while end < len(lists) and (end == at or total + len(lists[end]) <= CHUNK):
                    total += len(lists[end])
                    end += 1
                known: dict[bytes, int] = {}
                numbers = [np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64) for words in lists[at:end]]
                rows = [_row(*r, texts) for r in zip(keys[at:end], lists[at:end], find_runs(numbers))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                at = end

    python_ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SCHEMA)
