"""Periodic runs: against a search over all periods, and the contract's rows on the given documents."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sparkmail.llm.runs import LEAST, PERIODS, Grammar, find_runs, periodic_runs, stretches
from tests_support import documents


def all_runs(words):
    """Every maximal stretch of every period, smallest period of each stretch."""
    least = {}
    for q in range(1, len(words) // PERIODS + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(LEAST, PERIODS * q):
                least.setdefault((i, n), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in least.items())


def brute(key, text):
    words = (text or "").encode().split()
    if key is not None and words:
        h = zlib.crc32(str(key).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    kept = [w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in runs)]
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def planted(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        kinds, n = rnd.choice([1, 2, 3, 5, 50]), rnd.choice([0, 1, 23, 24, 30, 100, 300])
        words = [rnd.randrange(kinds) for _ in range(n)]
        for _ in range(rnd.randrange(4)):
            if n:
                a, p = rnd.randrange(n), rnd.randrange(1, 30)
                words = words[:a] + (words[a:a + p] * 100)[:rnd.randrange(1, 120)] + words[a:]
        yield np.array(words, dtype=np.int64)


def test_same_runs_as_a_search_over_all_periods():
    docs = list(planted(1, 600))
    for at in range(0, len(docs), 50):
        assert find_runs(docs[at:at + 50]) == [all_runs(d.tolist()) for d in docs[at:at + 50]]


def test_words_of_a_run_are_never_cut_away():
    for words in planted(2, 300):
        open_ = stretches(words, np.zeros(len(words), dtype=np.int64))
        assert all(open_[a:a + n].all() for a, n, _ in all_runs(words.tolist()))


def test_grammar_derives_its_text_and_is_small_on_repetitions():
    words = np.array(list(range(50)) * 40)
    g = Grammar(words, np.zeros(len(words), dtype=np.int64))

    def text(s):
        return [s] if s < g.base else text(int(g.left[s - g.base])) + text(int(g.right[s - g.base]))
    assert len(g.tops) == 1 and text(g.tops[0][0]) == words.tolist()
    assert len(g.size) < 100
    for i in range(len(g.size)):
        assert text(g.base + i) == words[g.first[i]:g.first[i] + g.size[i]].tolist()


def test_long_texts_in_bounded_time():
    start = time.time()
    assert find_runs([np.zeros(200_000, dtype=np.int64)]) == [[(0, 200_000, 1)]]
    assert find_runs([np.array(list(range(1000)) * 100)]) == [[(0, 100_000, 1000)]]
    a, b = [0], [0, 1]
    while len(b) < 50_000:
        a, b = b, b + a
    assert len(find_runs([np.array(b)])[0]) > 1000  # a word with runs of all sizes
    assert time.time() - start < 30


def test_query_equals_brute_force(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    found = periodic_runs(documents(spark), loop=True, texts=False).collect()
    got = sorted((r.id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in found)
    assert got == sorted(brute(r.doc_id, r.text) for r in rows)
    assert sum(r[1] for r in got) > 10


def test_nulls_repeats_ties_and_other_columns(spark):
    text = " ".join(["a b"] * 12 + ["x"] + ["c d"] * 12)
    df = spark.createDataFrame([(None, text, 1), (1, text, 2), (1, text, 3), (2, None, 4), (3, "", 5), (4, " \t\n", 6)],
                               "doc_id long, text string, n_runs int")
    got = {(r.id, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.collapsed) for r in periodic_runs(df).collect()}
    one = (49, 2, 0, 24, 2, 12000, "a b x c d")  # two runs of twelve periods: the first counts
    assert got == {(None, *one), (1, *one)} | {(i, 0, 0, None, None, None, None, "") for i in (2, 3, 4)}
    assert periodic_runs(df).count() == 6 and periodic_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 30])
def test_a_null_id_is_not_looped(spark, n):
    df = spark.createDataFrame([(None, "w " * n)], "doc_id long, text string")
    assert periodic_runs(df, loop=True).first().collapsed == ("w" if n else "")
