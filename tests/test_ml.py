"""ML, metrics tables and registry."""

import datetime as dt
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkmail.operators import ml as ML
from sparkmail.operators import registry as G

DOCS = [(1, "The cat sat on the mat. The END"), (2, "Le chat était là, été 2024"), (3, "a b cd cd cd"),
        (4, ""), (5, "x_y x_y Über über"), (6, None)]


def _brute_tfidf(docs):
    """scikit-learn's default TfidfVectorizer, written out."""
    toks = {i: re.findall(r"(?u)\b\w\w+\b", (t or "").lower()) for i, t in docs}
    n = len(docs)
    dfc = Counter(t for ts in toks.values() for t in set(ts))
    out = {}
    for i, ts in toks.items():
        tf = Counter(ts)
        raw = {t: c * (math.log((1 + n) / (1 + dfc[t])) + 1) for t, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for t, v in raw.items():
            out[(i, t)] = v / norm
    return out


@pytest.mark.parametrize("max_hot", [100_000, 2])
def test_tfidf_matches_brute_force(spark, max_hot):
    df = spark.createDataFrame(DOCS, "id long, text string")
    got = {(r["id"], r["term"]): r["weight"] for r in ML.tfidf(df, "id", "text", salts=4, max_hot=max_hot).collect()}
    want = _brute_tfidf(DOCS)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_tfidf_on_table_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in
            spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in ML.tfidf(df, "doc_id", "text", max_hot=50).collect()}
    want = _brute_tfidf(rows)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_tfidf_deals_text_and_pairs_to_as_many_tasks_as_they_need(spark, monkeypatch):
    rows = [(i if i % 7 else None, f"word{i % 5} common und{i} w{i * 3} common") for i in range(60)] + [(1, "again common")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    monkeypatch.setattr(ML, "TASK_TEXT", 64, raising=False)
    monkeypatch.setattr(ML, "TASK_PAIRS", 16, raising=False)
    staged, stage = [], ML.stage_table
    monkeypatch.setattr(ML, "stage_table", lambda t, name: staged.append(stage(t, name)) or staged[-1])
    found = ML.tfidf(df, "id", "text")
    assert len(staged[0].inputFiles()) > 10  # 4 at most when Spark deals a small table
    got = sorted((r["id"] or -1, r["term"], r["tf"], r["df"], round(r["weight"], 12)) for r in found.collect())
    texts = {}
    for i, t in rows:
        texts[i] = f"{texts.get(i, '')} {t}"
    want = _brute_tfidf(list(texts.items()))
    assert len(got) == len(want) and {(i, t) for i, t, *_ in got} == {(i or -1, t) for i, t in want}
    assert {i: round(sum(g[4] ** 2 for g in got if g[0] == (i or -1)), 9) for i in texts} == dict.fromkeys(texts, 1.0)


def test_class_report_and_accuracy(spark):
    pred = spark.createDataFrame([("spam", "spam"), ("spam", "ham"), ("ham", "ham"), ("ham", "ham"), ("x", "spam")],
                                 "label string, predicted string")
    rep = {r["class"]: r for r in ML.class_report(pred).collect()}
    assert rep["spam"]["precision"] == pytest.approx(0.5) and rep["spam"]["recall"] == pytest.approx(0.5)
    assert rep["ham"]["precision"] == pytest.approx(2 / 3) and rep["ham"]["recall"] == 1.0
    assert rep["x"]["precision"] == 0.0 and rep["x"]["f1"] == 0.0 and rep["x"]["support"] == 1
    assert ML.accuracy(pred).first()["accuracy"] == pytest.approx(0.6)
    assert {r["label"]: r["n"] for r in ML.label_histogram(pred).collect()} == {"spam": 2, "ham": 2, "x": 1}


def test_retrain_needs_five_samples(spark):
    few = spark.createDataFrame([("a b", "spam")] * 4, "text string, feedback string")
    assert ML.retrain(few) == (None, None)


def test_retrain_and_predict(spark):
    rows = [("win money now winner", "spam"), ("claim your prize winner", "spam"), ("lottery winner claim", "spam"),
            ("meeting agenda tomorrow", "ham"), ("course syllabus update", "ham"), ("research grant paper", "ham")]
    fb = spark.createDataFrame(rows, "text string, feedback string")
    model, pred = ML.retrain(fb)
    assert model is not None
    acc = pred.agg(F.avg((F.col("predicted_label") == F.col("feedback")).cast("double"))).first()[0]
    assert acc == 1.0


def test_train_and_predict_pipeline(spark):
    rows = [(i, ("winner prize claim " if i % 2 else "meeting agenda notes ") + str(i), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "message_id long, text string, label double")
    model, metrics = ML.train(df, seed=1, folds=2, grid=(0.01,), parallelism=1)
    m = {r["split"]: r for r in metrics.collect()}
    assert m["train"]["accuracy"] == 1.0
    docs = spark.createDataFrame([("winner prize",), ("   ",)], "text string")
    pred, bad = ML.predict(docs, model)
    r = pred.first()
    assert r["predicted"] == "spam" and 0.5 < r["confidence"] <= 1.0
    assert bad.count() == 1


def test_feature_table_shape(spark):
    df = spark.createDataFrame([(1, "Hi there", "the body text", "a@b.org", "spam")],
                               "message_id long, subject string, body string, sender string, spam_label string")
    r = ML.feature_table(df, "2026-01-15", n=64).first()
    assert len(r["subject_tf_idf"]) == 64 and r["sender_domain"] == "b.org" and r["label"] == "spam"


def _reg(spark):
    return spark.createDataFrame(
        [("v1", "2026-01-01", 0.8, 0.7, "p1", dt.datetime(2026, 1, 1)),
         ("v2", "2026-01-02", 0.9, 0.8, "p2", dt.datetime(2026, 1, 2))],
        "version string, training_date string, accuracy double, f1 double, model_path string, created_at timestamp")


def test_registry_champion_and_register(spark):
    reg = G.champion_by_latest(_reg(spark))
    assert [r["version"] for r in G.champion(reg).collect()] == ["v2"]
    assert [r["version"] for r in G.history(reg).collect()] == ["v1", "v2"]
    new = spark.createDataFrame([("v3", 0.5)], "version string, f1 double")
    after = G.register(reg, new)
    assert [r["version"] for r in G.champion(after).collect()] == ["v3"] and after.count() == 3


def test_promote_if_better(spark):
    reg = G.champion_by_latest(_reg(spark))
    worse = spark.createDataFrame([("v3", 0.5)], "version string, f1 double")
    assert [r["version"] for r in G.champion(G.promote_if_better(reg, worse)).collect()] == ["v2"]
    better = spark.createDataFrame([("v4", 0.95)], "version string, f1 double")
    assert [r["version"] for r in G.champion(G.promote_if_better(reg, better)).collect()] == ["v4"]


def test_registry_generations(spark, tmp):
    reg = G.champion_by_latest(_reg(spark))
    G.write_registry(reg, tmp, 1)
    G.write_registry(G.register(G.read_registry(spark, tmp),
                                spark.createDataFrame([("v3",)], "version string")), tmp, 2)
    back = G.read_registry(spark, tmp)
    assert back.count() == 3 and [r["version"] for r in G.champion(back).collect()] == ["v3"]


def test_model_save_load(spark, tmp):
    rows = [(i, "winner" if i % 2 else "agenda", float(i % 2)) for i in range(20)]
    model, _ = ML.train(spark.createDataFrame(rows, "message_id long, text string, label double"), folds=2,
                        grid=(0.01,), parallelism=1)
    path = ML.save_model(model, tmp, "1")
    assert ML.load_model(path).transform(spark.createDataFrame([("winner",)], "text string")).count() == 1


def test_load_champion_and_model_labeler(spark, tmp):
    from sparkmail.streaming import stream as ST

    rows = [(i, ("winner prize " if i % 2 else "agenda notes ") + str(i), float(i % 2)) for i in range(30)]
    model, _ = ML.train(spark.createDataFrame(rows, "message_id long, text string, label double"), folds=2,
                        grid=(0.01,), parallelism=1)
    path = ML.save_model(model, tmp, "7")
    reg = spark.createDataFrame([("7", "2026-01-15", 1.0, 1.0, path, dt.datetime(2026, 1, 15))],
                                "version string, training_date string, accuracy double, f1 double, model_path string, "
                                "created_at timestamp")
    G.write_registry(G.champion_by_latest(reg), tmp, 1)
    assert G.load_champion(spark, tmp) is not None
    lab = ST.model_labeler(tmp)
    out = lab(spark.createDataFrame([("e1", "winner prize")], "email_id string, text string")).first()
    assert out["predicted_label"] == "spam" and out["confidence"] > 0.5


def test_train_and_register_flow(spark, tmp):
    from sparkmail.plans.flows import train_and_register

    rows = [(i, ("winner prize " if i % 2 else "agenda notes ") + str(i), float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "message_id long, text string, label double")
    reg = train_and_register(spark, df, tmp, "1", "2026-01-15", dt.datetime(2026, 1, 15), folds=2, grid=(0.01,),
                             parallelism=1)
    assert reg.count() == 1 and G.champion(reg).first()["version"] == "1"
    reg = train_and_register(spark, df, tmp, "2", "2026-01-16", dt.datetime(2026, 1, 16), promote="if_better",
                             folds=2, grid=(0.01,), parallelism=1)
    # same data, same metric: not better, so version 1 stays champion
    assert reg.count() == 2 and G.champion(reg).first()["version"] == "1"
    assert G.load_champion(spark, tmp) is not None


def test_retrain_weights_follow_the_smoothed_idf(spark):
    """Term weights are ln((1 + n) / (1 + df)) + 1; no vocabulary limit; hashing is opt-in."""
    import math

    rows = [("cat dog", "a"), ("cat cat", "b"), ("cat bird", "a"), ("cat fish", "b"), ("cat dog", "c")]
    fb = spark.createDataFrame(rows, "text string, feedback string")
    model, _ = ML.retrain(fb)
    terms = model.stages[1].vocabulary
    weights = dict(zip(terms, model.stages[2].getScalingVec().toArray()))
    df = {"cat": 5, "dog": 2, "bird": 1, "fish": 1}
    assert weights == pytest.approx({t: math.log(6 / (1 + n)) + 1 for t, n in df.items()})
    hashed, pred = ML.retrain(fb, num_features=32)
    assert {r.predicted_label for r in pred.collect()} <= {"a", "b", "c"}


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "message_id")
    a = {r[0] for r in ML.split(df.repartition(3), 0.2, 7)[1].collect()}
    b = {r[0] for r in ML.split(df.coalesce(1), 0.2, 7)[1].collect()}
    assert a == b and 60 < len(a) < 140


def test_training_input_is_computed_once(spark):
    """The five folds and two settings read a staged table, not the plan of the input."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = [(i, ("winner prize " if i % 2 else "agenda notes ") + str(i), float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "message_id long, text string, label double").mapInPandas(count, "message_id long, text string, label double")
    ML.train(df, seed=1, folds=2, grid=(0.01, 0.1), parallelism=1)
    assert seen.value == 40


def test_tokenized_table(spark, tmp):
    """Rows and columns stay, a null text is empty, weights are those of the formula."""
    df = spark.createDataFrame([(1, "The cat THE dog", "a"), (2, None, "b"), (3, "cat  bird", "c"), (3, "cat  bird", "c")], "message_id long, body string, _text string")
    t = ML.write_tokenized(df, f"{tmp}/t")
    got = sorted((r.message_id, r._text, r.tokens, r.kept) for r in t.collect())
    assert got == [(1, "a", ["the", "cat", "the", "dog"], ["cat", "dog"]), (2, "b", [""], [""]),
                   (3, "c", ["cat", "", "bird"], ["cat", "", "bird"])] + [(3, "c", ["cat", "", "bird"], ["cat", "", "bird"])]
    weights = {r.message_id: sorted(float(v) for v in r.features.values) for r in t.collect()}
    assert weights[1] == pytest.approx(sorted([math.log(5 / 4), math.log(5 / 2)]))
