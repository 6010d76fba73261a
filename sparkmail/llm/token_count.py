"""Token counts by rank-synchronous merging of arrays.

The distinct new pre-tokens of a batch are held as one ragged array of
symbols. In each step every pre-token merges its own lowest-ranked pair, all
at once; pre-tokens in which no pair can be merged leave the array with their
number of symbols. No tokenizer library takes part.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmail.llm.common import python_ready
from sparkmail.llm.pieces import PieceTable, Splitter, per_list

NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if
    printable Latin-1, else the next unused one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Merges:
    """The merge table: pair of symbols -> rank, and rank -> symbol made."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.byte = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols left of each piece when nothing more can be merged."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        left = sizes.copy()
        symbol = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(symbol), NONE, dtype=np.int32)  # of the pair (i, i + 1); none at a piece's end
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inside] = self.rank(symbol[inside], symbol[inside + 1])
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.concatenate([first, [len(symbol)]]))
            least = np.minimum.reduceat(rank, first)
            left[owner[first]] = size
            live = np.repeat(least < NONE, size)
            hit = live & (rank == np.repeat(least, size))
            # Overlapping pairs (a a a): the first, third, ... of a run of hits.
            place = np.arange(len(hit))
            begin = hit & ~np.concatenate([[False], hit[:-1]])
            hit &= (place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0
            at = np.flatnonzero(hit)
            symbol[at] = self.made[rank[at]]
            stale = np.zeros(len(symbol), dtype=bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            keep = live.copy()
            keep[at + 1] = False
            symbol, owner, rank, stale = symbol[keep], owner[keep], rank[keep], stale[keep]
            again = np.flatnonzero(stale)
            again = again[again + 1 < len(symbol)]
            same = owner[again] == owner[again + 1]
            rank[np.flatnonzero(stale)] = NONE
            rank[again[same]] = self.rank(symbol[again[same]], symbol[again[same] + 1])
        return left


@lru_cache(maxsize=1)
def count_table(tokenizer: str) -> tuple[Splitter, PieceTable]:
    """What a Python worker knows of a tokenizer; kept from task to task."""
    split = Splitter(tokenizer)
    merges = Merges(split.spec)
    return split, PieceTable(lambda new: np.array([1 if p in split.added else n for p, n in zip(
        new, merges.counts([p.encode() for p in new]).tolist())]))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(id, n_bytes, n_tokens) for each row: UTF-8 bytes and tokens of the whole text.

    Added tokens inside a text count one, as the tokenizers library has it by
    default; nothing is added, cut or padded. Null and empty texts have 0 and
    0. Repeated rows and null ids stay as they are; an empty table gives an
    empty result; other columns are not read. Per Python worker the counts of
    a million pre-tokens are kept.
    """
    def run(batches):
        split, table = count_table(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pieces = [split(t) for t in texts]
            counts = per_list(pieces, table.of([p for own in pieces for p in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                                              pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    python_ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "id long, n_bytes long, n_tokens long")
