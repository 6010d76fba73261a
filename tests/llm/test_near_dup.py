"""Near duplicates against brute force over all pairs of small tables."""

import random
import re

import pytest

from sparkmail.llm import shingles as S
from sparkmail.llm.near_dup import near_duplicates


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(size, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            common = len(x & y)
            if common and 100 * common >= percent * (len(x) + len(y) - common):
                u, v = sorted((find(i), find(j)))
                label[v] = u
    return {i: (len(x), find(i), find(i) == i) for i, x in sets}


def run(spark, rows, size=3, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, size=size, percent=percent).collect()}


def test_chains_copies_and_edge_cases(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 40, 120]))
        for _ in range(rng.choice([1, 2, 5, 25])):
            if len(words) > 20:
                words = list(words)
                words[rng.randrange(len(words))] = rng.choice(vocabulary)  # drifts: chains of links
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.3 else w for w in words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "É x"), (n + 4, "é x"), (n + 5, "one word"),
             (n + 6, "long " * 200_000), (n + 7, "LONG " * 200_000), (n + 8, "x" * 3_000_000)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows, 3, 85)


def test_default_threshold_and_large_group(spark):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(300):  # one base, each copy with a few words changed: many similarities near the threshold
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(150)] = f"u{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    got, want = run(spark, rows, 5, 80), brute(rows, 5, 80)
    # Hard on stars: some documents have a single link at 0.802 and a hundred neighbours at 0.79.
    # Nothing may be merged wrongly; at most 2 % of the documents may miss their component.
    for i, (_, label, _) in got.items():
        assert want[i][1] == want[label][1]
    assert sum(got[i] != want[i] for i in got) <= 0.02 * len(rows)


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "p q r s"), (2, "a b c d"), (3, "p q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r.id, r.component_id, r.kept) for r in near_duplicates(df, size=3, percent=85).collect()], key=repr)
    assert got == sorted([(None, None, True)] * 2 + [(1, 1, True)] * 2 + [(2, 1, False)] * 2 + [(3, 1, False)], key=repr)
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 30, 200, 3000])
def test_band_agreement_follows_similarity(n):
    """Equal sets have equal bands; the rate of equal bins estimates the Jaccard similarity."""
    import numpy as np

    rng = np.random.default_rng(n)
    rates, truth = [], 0.8
    for _ in range(200):
        both = rng.integers(0, 2**63, size=max(1, round(n * truth)), dtype=np.uint64)
        one, two = (rng.integers(0, 2**63, size=round(n * (1 - truth) / 2), dtype=np.uint64) for _ in "ab")
        a, b = np.unique(S.mix(np.concatenate([both, one]))), np.unique(S.mix(np.concatenate([both, two])))
        rates.append((S.one_permutation(a, 125) == S.one_permutation(b, 125)).mean())
    real = len(both) / (len(both) + len(one) + len(two))
    assert abs(np.mean(rates) - real) < 0.05


def template_group(n, own, shared, words=300, size=3):
    """n documents of one template in pairs: ``own`` words at the end are each document's alone, the ``shared`` before them its pair's."""
    base = [f"t{i}" for i in range(words)]
    return [(i, " ".join([*base, *[f"p{i // 2}x{k}" for k in range(shared)], *[f"o{i}x{k}" for k in range(own)]])) for i in range(n)]


@pytest.mark.parametrize("n", [200, 600])
def test_every_link_in_a_large_template_group(spark, n):
    """Each document is linked with exactly one other (0.857) and similar to all others just below the threshold (0.798)."""
    rows = template_group(n, 26, 12)
    assert run(spark, rows) == {i: (336, i - i % 2, i % 2 == 0) for i, _ in rows}
    if n == 200:
        assert run(spark, rows) == brute(rows, 3, 85)


def test_large_group_of_changed_words_exactly(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = [f"v{k}" for k in range(150)]
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(150)] = f"u{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_repeated_id_with_two_texts_has_the_links_of_both(spark):
    rng = random.Random(3)
    one, two = ([f"{c}{rng.randrange(10**6)}" for _ in range(100)] for c in "ab")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join([*one, "x"])), (3, " ".join([*two, "y"])), (4, "other words only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, r.component_id) for r in near_duplicates(df, size=3, percent=85).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
