"""Pre-tokens of byte-level BPE, and tables that keep what is known of each."""

from __future__ import annotations

import json
import os
import re
from itertools import islice, repeat

import numpy as np
import regex

#: Pre-token pattern of byte-level BPE.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts without characters on which the classes of ``re`` differ, twice as fast.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ODD = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ʯ]")


def tokenizer_path(name: str) -> str:
    """``name`` itself if it is a path, else the file of that public tokenizer on this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Splitter:
    """Cuts a text into added tokens (as given ids) and pre-tokens, as the tokenizer file says.

    Known file layouts only: byte-level BPE without normalizer or prefix space,
    added tokens that match anywhere; others raise ValueError.
    """

    def __init__(self, name: str):
        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") \
                or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError(f"{name}: not a plain byte-level BPE")
        self.spec = spec
        self.added = {a["content"]: a["id"] for a in added}
        names = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def __call__(self, text: str) -> list[str]:
        """The pieces in order; an added token is a piece of its own."""
        find = PATTERN.findall if ODD.search(text) else PLAIN.findall
        if self.cut is None or not self.cut.search(text):
            return find(text)
        out = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else find(part)
        return out


class Grown:
    """An array that grows by doubling."""

    def __init__(self, dtype):
        self.data, self.used = np.empty(1024, dtype=dtype), 0

    def extend(self, more: np.ndarray) -> None:
        need = self.used + len(more)
        if need > len(self.data):
            data = np.empty(max(need, 2 * len(self.data)), dtype=self.data.dtype)
            data[:self.used] = self.data[:self.used]
            self.data = data
        self.data[self.used:need] = more
        self.used = need


class PieceTable:
    """piece -> number; ``learn`` is given the new pieces and returns an array with the value of each.
    When it holds more than ``limit`` pieces, the half learnt first stays: the frequent ones are met early."""

    def __init__(self, learn, limit: int = 400_000):
        self.learn, self.limit = learn, limit
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.values = Grown(np.int64)

    def cut(self, kept: int) -> None:
        self.values.used = kept

    def store(self, new: list[str]) -> None:
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.values.extend(self.learn(new))

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of ``pieces``, all looked up once; only unknown ones are learnt, and looked up again."""
        if len(self.rows) > self.limit:
            kept = self.limit // 2
            self.rows = dict(islice(self.rows.items(), kept))
            self.cut(kept)
        get = self.rows.get
        found = np.fromiter(map(get, pieces, repeat(-1)), np.int64, len(pieces))
        at = np.flatnonzero(found < 0)
        if len(at):
            unknown = [pieces[i] for i in at.tolist()]
            self.store(list(dict.fromkeys(unknown)))
            found[at] = np.fromiter(map(get, unknown), np.int64, len(unknown))
        return found

    def of(self, pieces: list[str]) -> np.ndarray:
        at = self.numbers(pieces)  # may replace the array of values
        return self.values.data[at]


class IdTable(PieceTable):
    """piece -> its ids. ``learn`` returns the new pieces in an order of its own, their sizes and all their ids."""

    def clear(self):
        self.rows = {}
        self.size, self.first, self.flat = Grown(np.int64), Grown(np.int64), Grown("<u4")

    def cut(self, kept):
        self.flat.used = int(self.first.data[kept])
        self.size.used = self.first.used = kept

    def store(self, new):
        new, size, ids = self.learn(new)
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.size.extend(size)
        self.first.extend(self.flat.used + np.cumsum(size) - size)
        self.flat.extend(ids)

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids in order)."""
        at = self.numbers(pieces)
        size = self.size.data[at]
        first = self.first.data[at] - (np.cumsum(size) - size)
        return size, self.flat.data[np.repeat(first, size) + np.arange(int(size.sum()))]


def per_list(lists: list[list], values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one for each element of all ``lists``) by list."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum([0, *map(len, lists)])
    return total[end[1:]] - total[end[:-1]]
