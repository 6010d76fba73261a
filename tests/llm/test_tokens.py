"""Token counts and packing against the tokenizers library."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmail.llm.packing import first_fit, pack
from sparkmail.llm.pieces import Splitter, tokenizer_path
from sparkmail.llm.token_count import Merges, count_tokens
from tests_support import documents

os.environ["TOKENIZERS_PARALLELISM"] = "false"
FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(FILE))


def odd_texts():
    rng = random.Random(1)
    return [None, "", " ", "a" * 3000, "  \n\n  x", "é²½ 12½ x_y__z 中文字符测试" * 20, "\x1c\x1d a\x85b c", "'sad 'll''s !'s",
            "<|endoftext|>hi<|endoftext|><|endoftext|> x <|endoftext", "".join(chr(rng.randrange(1, 0x3000)) for _ in range(5000)),
            "".join(chr(rng.choice([*range(0x1F300, 0x1F700), 0x200D, 0xFE0F, 0x300, 32])) for _ in range(500)),
            " " * 5000 + "x", "".join(rng.choice("abcdefghij") for _ in range(4000)), "word " * 300_000]


def rows_of(spark):
    texts = odd_texts() + [r.text for r in documents(spark).collect()]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "x y"), (0, "x y"), (0, "x y")]


def test_counts(spark, library):
    rows = rows_of(spark)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted([tuple(r) for r in count_tokens(df).collect()], key=repr)
    want = sorted([(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows], key=repr)
    assert got == want
    assert count_tokens(df.limit(0)).count() == 0


def test_merging_many_pieces_at_once_is_merging_each_alone():
    split = Splitter(FILE)
    merges = Merges(split.spec)
    pieces = [p.encode() for t in odd_texts() if t for p in split(t)]
    pieces = list(dict.fromkeys(pieces))[:3000]
    assert merges.counts(pieces).tolist() == [int(merges.counts([p])[0]) for p in pieces]
    assert merges.counts([]).tolist() == []


def test_unknown_layouts_are_refused():
    with pytest.raises(ValueError):
        Splitter("word_bpe_49k.json")


def check_packed(got, rows, library, length):
    want = {}
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.setdefault(i, []).append(ids)
    for r in got:  # every piece is what it says of one of the rows with its id
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for x in want[r.doc_id])
    for i, texts in want.items():  # and each id lies in one piece
        mine = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert mine == sorted((a, min(length, len(x) - a)) for x in texts for a in range(0, len(x), length))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= length
    return bins


def test_packing_round_trip(spark, library):
    rows = rows_of(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bins = check_packed(pack(df, group=100).collect(), rows, library, 1024)
    used = sum(size for own in bins.values() for _, size in own)
    assert used / (1024 * len(bins)) > 0.97
    assert pack(df.limit(0)).count() == 0
    assert pack(df.where(F.col("text").isNull())).count() == 1


def test_first_fit_is_first_fit():
    rng = random.Random(6)
    for n in (0, 1, 2, 3, 50, 300):
        sizes = [rng.randrange(1, 101) for _ in range(n)]
        bins, offsets = first_fit(sizes, 100)
        free = []
        for size, b, o in zip(sizes, bins, offsets):
            want = next((i for i, x in enumerate(free) if x >= size), len(free))
            free += [100] * (want == len(free))
            assert (b, o) == (want, 100 - free[want])
            free[want] -= size


def test_long_texts_are_hashed_part_by_part(monkeypatch):
    import numpy as np

    from sparkmail.llm import shingles as S

    texts = [b"", b" a  B c", b"x" * 500 + b" y", " ".join(f"Wort{i}é" for i in range(400)).encode(), b"\t\n"]
    want = S.word_hashes(texts)
    assert [len(w) for w in want] == [0, 3, 2, 400, 0]
    monkeypatch.setattr(S, "CHUNK", 64)
    monkeypatch.setattr(S, "_POWERS", {})
    assert all(np.array_equal(a, b) for a, b in zip(S.word_hashes(texts), want))


def test_a_full_table_forgets_the_pieces_learnt_last():
    import numpy as np

    from sparkmail.llm.pieces import IdTable, PieceTable

    table = IdTable(lambda new: (new[::-1], np.array([len(p) for p in new[::-1]]), np.array([ord(c) for p in new[::-1] for c in p], dtype="<u4")), limit=20)
    lengths = PieceTable(lambda new: np.array([len(p) for p in new]), limit=20)
    for k in range(30):
        pieces = [f"p{i}" for i in range(k, k + 9)] + ["a", "bb"]
        size, ids = table.ids(pieces)
        assert size.tolist() == lengths.of(pieces).tolist() == [len(p) for p in pieces]
        assert "".join(map(chr, ids)) == "".join(pieces)
        assert len(table.rows) <= 40


def test_known_pieces_are_looked_up_once():
    from sparkmail.llm.pieces import PieceTable

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return dict.get(self, *a)

    table = PieceTable(lambda new: np.array([len(p) for p in new]))
    table.rows = Counted()
    pieces = ["a", "bb", "a", "ccc", "bb"]
    assert table.of(pieces).tolist() == [1, 2, 1, 3, 2]
    Counted.asked = 0
    assert table.of([*pieces, "dddd"]).tolist() == [1, 2, 1, 3, 2, 4] and Counted.asked == 7
