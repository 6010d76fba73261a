"""Decontamination against a word-by-word search."""

import hashlib
import random
import re
import time

from sparkmail.llm.decontaminate import decontaminate


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, t in items:
            v = words_of(t)
            n = min(window, len(v))
            own = {tuple(v[j:j + n]) for j in range(len(v) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in own:
                    hit |= set(range(j, j + n))
                    found.add(str(item)) if item is not None else None
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted([tuple(r) for r in decontaminate(d, b).collect()], key=repr)


def some_text(rng, n):
    return "".join(rng.choice(["a", "B", "é", "É", "ß", "x1", "of", "The", "tion"]) + rng.choice([" ", ", ", ".\n", "-"])
                   for _ in range(n))


def test_random_overlaps(spark):
    rng = random.Random(3)
    items = [(i, some_text(rng, rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(12)]
    docs = []
    for i in range(60):
        text = some_text(rng, rng.randrange(0, 60))
        if i % 2:
            words = items[rng.randrange(len(items))][1].split(" ")
            at = rng.randrange(len(words))
            text += " " + " ".join(words[at:at + rng.randrange(5, 25)]) + " " + some_text(rng, 20)
        docs.append((i, text))
    assert run(spark, docs, items) == brute(docs, items)


def test_only_long_items_and_exact_length(spark):
    span = "one two three four five six seven eight nine ten"
    items = [(7, "start " + span + " end"), (10, span + " other words"), (None, "z " * 12)]
    docs = [(1, span), (2, span.rsplit(" ", 1)[0]), (3, f"x {span.upper()}! {span}"), (4, span.replace(" ", " ")),
            (5, "Z; " * 15), (6, (span + " ") * 2000)]
    assert run(spark, docs, items) == brute(docs, items)


def test_nulls_repeats_and_empty_tables(spark):
    span = "a b c d e f g h i j k"
    docs = [(1, None), (2, ""), (None, span), (3, span), (3, span), (3, "clean text"), (4, "İ ſ K " + span)]
    items = [(1, span), (1, span), (2, None), (3, "..."), (None, None)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items[2:]) == brute(docs, items[2:])
    assert run(spark, [], items) == []


def test_long_document_that_holds_a_long_item(spark):
    """Work grows with the words, not with words times fingerprints: some 20,000 shared places in one text."""
    rng = random.Random(9)
    item = " ".join(f"w{rng.randrange(3000)}" for _ in range(20_000))
    docs = [(1, "before " + item + " after"), (2, item.replace("w7 ", "x ")), (3, "w1 " * 30_000)]
    items = [(1, item), (2, "w1 w1 w1")]
    start = time.time()
    got = run(spark, docs, items)
    assert time.time() - start < 60
    assert got == brute(docs, items)
