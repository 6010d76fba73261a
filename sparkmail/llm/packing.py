"""Packing of documents into fixed-length token sequences.

A document's ids are cut at every full length. Documents are dealt at random
into groups; a full piece is a sequence by itself, and the documents' last pieces
(one each, so a group is bounded) are packed by first-fit decreasing. The open bins of a group are the
leaves of a tournament tree whose inner nodes hold the largest capacity
below them, so the first bin that a piece fits is found by one descent.
"""

from __future__ import annotations

import math
import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmail.llm.common import python_ready
from sparkmail.llm.pieces import IdTable, Splitter, per_list, tokenizer_path
from sparkmail.session import stage_table

#: Documents of a group, on average.
GROUP = 2048
#: How byte-level BPE writes a space.
SPACE = "\u0120"


@lru_cache(maxsize=1)
def id_table(tokenizer: str) -> tuple[Splitter, IdTable]:
    """What a Python worker knows of a tokenizer; kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(tokenizer))

    spaced = np.zeros(max(library.get_vocab().values()) + 1, dtype=bool)
    spaced[[i for token, i in library.get_vocab().items() if token.startswith(SPACE)]] = True

    def learn(new):
        # Words with the space before them can be encoded as one text, which the library cuts into just
        # these words again; that saves a call a word.
        words, others, sizes, ids = [], [], [], []
        for p in new:
            (words if len(p) > 1 and p[0] == " " and p[1:].isalpha() else others).append(p)
        done = []
        for at in range(0, len(words), 4096):
            own = words[at:at + 4096]
            found = np.array(library.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, dtype="<u4")
            first = np.flatnonzero(spaced[found])  # a word's first id is the only one with a space
            if len(first) == len(own):
                done += own
                sizes.append(np.diff(np.append(first, len(found))))
                ids.append(found)
            else:
                others += own
        found = [e.ids for e in library.encode_batch_fast(others, add_special_tokens=False)]
        sizes.append(np.array([len(x) for x in found], dtype=np.int64))
        ids.append(np.fromiter(chain.from_iterable(found), dtype="<u4"))
        return done + others, np.concatenate(sizes), np.concatenate(ids)

    return Splitter(tokenizer), IdTable(learn)


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, length: int, end_id: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of each document's ids, ``end_id`` included."""
    def run(batches):
        split, table = id_table(tokenizer)
        for batch in batches:
            lists = [split(t or "") for t in batch.column(1).to_pylist()]
            size, ids = table.ids([p for own in lists for p in own])
            total = per_list(lists, size)
            ids = np.insert(ids, np.cumsum(total), end_id)  # behind each document's own
            total += 1
            first = np.cumsum(total) - total
            count = -(-total // length)
            doc = np.repeat(np.arange(len(total)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * length
            size = np.minimum(length, total[doc] - start)
            view = memoryview(ids.view(np.uint8))
            sums = [zlib.crc32(view[a:b]) for a, b in zip((4 * (first[doc] + start)).tolist(), (4 * (first[doc] + start + size)).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (start, size, sums, total[doc]))],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    python_ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit(sizes: list[int], length: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each size, in the order given: each goes to the first bin it fits."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    best = [length] * (2 * leaves)  # node i has children 2i and 2i + 1; the leaves are the bins
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node = 2 * node if best[2 * node] >= size else 2 * node + 1
        bins.append(node - leaves)
        offsets.append(length - best[node])
        best[node] -= size
        while node > 1:
            node //= 2
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node] = top
    return bins, offsets


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json",
         length: int = 1024, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    Each document's ids (of the tokenizers library, then ``end_id``) lie in
    exactly one piece each; ``start`` counts the ids before the piece and
    ``offset`` its place in its sequence, where pieces lie without gaps from 0.
    No sequence is longer than ``length``. ``sequence_id`` is group * 2**32 +
    bin, or negative for a sequence that one full piece fills; sequences of a group are independent of all others.

    A null or empty text is its end id alone. Repeated rows and null ids are
    packed row by row. An empty table gives an empty result; other columns
    are not read.
    """
    pieces = cut_pieces(docs, id_col, text_col, tokenizer, length, end_id).withColumn("row", F.monotonically_increasing_id())
    pieces = stage_table(pieces, "pieces")  # tokenized once; row numbers fixed
    # A document is dealt by its last piece, which alone needs a place beside others.
    last = F.col("start") + F.col("length") == F.col("doc_tokens")
    groups = max(1, math.ceil(pieces.where(last).count() / group))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{c} long" for c in names)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True])
        bins, offsets = first_fit(rows["length"].tolist(), length)
        rows["sequence_id"] = rows["deal"].astype("int64") * 2**32 + np.array(bins, dtype=np.int64)
        rows["offset"] = np.array(offsets, dtype=np.int64)
        return rows[names]

    # Sequences of one full piece are numbered by the piece's row, below zero.
    full = pieces.where(~last).select(*names[:5], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = pieces.where(last).withColumn("deal", F.pmod(F.xxhash64("row", F.lit(17)), F.lit(groups)))
    return dealt.groupBy("deal").applyInPandas(fill, schema).unionByName(full)
