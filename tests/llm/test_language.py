"""Language profiles: distances by brute force, held-out accuracy, edge cases."""

from collections import Counter

from pyspark.sql import functions as F

from sparkmail.llm.language import Classifier, fit_profiles, held_out, identify, keep_identified, ngrams
from tests_support import documents


def brute_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        p = f" {w} "
        out.update(w)
        out.update(p[i:i + 3] for i in range(len(p) - 2))
        out.update(p[i:i + 2] for i in range(len(p) - 1))
    return out


def code(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


def test_ngrams():
    for text in ("", "  1, 2", "a", "Ab c", "Éa!x-y", "straße Ünder 中文 x", "a\x00b"):
        codes, counts = ngrams(text)
        assert dict(zip(codes.tolist(), counts.tolist())) == {code(g): n for g, n in brute_ngrams(text).items()}


def test_distance():
    profiles = [("x", [code("a"), code("b"), code(" a")]), ("y", [code("b"), code("c"), code("a")])]
    classify = Classifier(profiles, 3)
    # counts: a 3, then 'a ' and ' a' and so on; the three highest by count, then code
    text = "a a a b"
    own = [g for g, _ in sorted(((code(g), n) for g, n in brute_ngrams(text).items()), key=lambda x: (-x[1], x[0]))[:3]]
    want = [sum(abs(i - p.index(g)) if g in p else 3 for i, g in enumerate(own)) for _, p in profiles]
    name, score = classify(text)
    assert name == "xy"[want.index(min(want))] and abs(score - (1 - min(want) / 9)) < 1e-12


def test_held_out_accuracy(spark):
    docs = documents(spark)
    profiles = fit_profiles(docs.where(~held_out(F.col("doc_id"))), "text", "lang", fit_docs=30)
    assert [p[0] for p in profiles] == ["de", "en", "es", "fr"]
    got = identify(docs, profiles).withColumnRenamed("id", "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_edge_cases(spark):
    rows = [(1, "the cat", "en", 1.0), (1, "the cat", "en", 1.0), (None, "le chat", "fr", 0.5), (2, None, "en", None), (3, "", None, None),
            (4, "12 !?", "fr", 0.0), (6, "x" * 2_000_000, None, 0.0), (7, "le chien", "fr", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    profiles = fit_profiles(df, "text", "lang")
    got = {(r.id, r.lang_pred) for r in identify(df, profiles).collect()}
    assert {(1, "en"), (None, "fr"), (2, "und"), (3, "und"), (4, "und"), (7, "fr")} <= got
    assert identify(df, profiles).count() == len(rows)
    assert [(r.lang_pred, r.score) for r in identify(df, []).collect()] == [("und", 0.0)] * len(rows)
    assert identify(df.limit(0), profiles).count() == 0 and fit_profiles(df.limit(0), "text", "lang") == []


def test_without_profiles_only_texts_without_a_letter_go(spark):
    df = spark.createDataFrame([(1, "the cat", None), (2, "12 !?", None), (3, None, None), (4, "", None), (5, "é", None)], "doc_id long, text string, lang string")
    assert fit_profiles(df, "text", "lang") == []
    assert sorted(r.doc_id for r in keep_identified(df, []).collect()) == [1, 5]
