"""Quality rules: base counts against a plain version, distances, and junk and clean documents of the given labels."""

import numpy as np
import pytest

from sparkmail.llm.quality_rules import Rules, distance, fit_references, judge_quality
from tests_support import SF, documents

SPACES = " \t\n\v\f\r"


def words_of(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    text = text or ""
    words = words_of(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    hit = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words_of(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit),
            len(words) < 10 or 100 * len(hit) > 20 * len(words))


@pytest.fixture(scope="module")
def references(spark):
    return fit_references(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_base_counts_equal_a_plain_version(spark, references):
    texts = {r.doc_id: r.text for r in documents(spark).select("doc_id", "text").collect()}
    found = judge_quality(documents(spark), references).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.id])
        assert not (r.base_failed and r.kept) and 0 <= r.char_distance <= 1 and 0 <= r.word_distance <= 1


def test_junk_is_caught_and_clean_documents_stay(spark, references):
    sf = "/root/testdata/sf0.01"
    judged = judge_quality(spark.read.parquet(f"{sf}/documents.parquet"), references)
    rows = judged.join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("doc_id", "id"), "id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(not r.kept for r in junk) >= 0.95 * len(junk)


def test_distance_by_its_definition():
    p, q = np.array([[1, 3, 0]]), np.array([[2, 1, 1]])
    a, b = np.array([.25, .75, 0]), np.array([.5, .25, .25])
    m = (a + b) / 2

    def kl(x):
        return sum(v * np.log2(v / w) for v, w in zip(x, m) if v)
    assert distance(p, q)[0, 0] == pytest.approx(((kl(a) + kl(b)) / 2) ** .5)
    assert distance(p, p)[0, 0] == 0 and distance(np.array([[1, 0]]), np.array([[0, 1]]))[0, 0] == 1
    assert distance(np.array([[0, 0]]), np.array([[0, 1]]))[0, 0] == 1


def test_short_texts_are_not_judged_by_distance(spark, references):
    odd = "|| ## $$ %% && ** << >> @@ ^^"
    rows = [(1, odd), (2, " ".join(f"w{i} | # $ %" for i in range(80)))]
    got = {r.id: r.kept for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string"), references).collect()}
    assert got == {1: True, 2: False}


def test_nulls_empty_long_repeats_and_other_columns(spark, references):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(None, None, "x"), (1, "", "x"), (2, "one two", "x"), (2, "one two", "y"), (3, long, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = judge_quality(df, references).collect()
    assert sorted((r.id or 0, r.n_words, r.base_failed, r.kept) for r in got) == [
        (0, 0, True, False), (1, 0, True, False), (2, 2, True, False), (2, 2, True, False), (3, 300_000, False, False)]
    assert judge_quality(df.limit(0), references).count() == 0


def test_without_references_only_the_base_rules_judge(spark):
    df = spark.createDataFrame([(1, "| " * 10 + " ".join(map(str, range(50))), None)], "doc_id long, text string, lang string")
    assert fit_references(df) == [] and fit_references(df.limit(0)) == []
    assert judge_quality(df, [], rules=Rules(repeat_percent=50)).first().kept
    assert not judge_quality(df, [], rules=Rules(repeat_percent=0)).first().kept


def test_every_document_counts_in_the_references(spark):
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(8)]
    text = " ".join(words[:60])
    rows = [(i, f"{text} common" if i % 3 else text, "xx") for i in range(4500)] + [(5000, f"{text} rare", "yy"), (5001, None, "yy"), (None, text, "yy")]
    xx, yy = fit_references(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    total = 4500 * 60 + 3000
    assert dict(zip(xx.words, xx.shares))["common"] == 3000 / total and xx.shares[0] == 4500 / total
    assert yy.language == "yy" and len(yy.words) == 61 and "rare" in yy.words
