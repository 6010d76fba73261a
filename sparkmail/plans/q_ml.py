"""Registered queries: ML, metrics tables and the model registry
(M1-M10, A15-A17, U1, M5, M6, V5, X1)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparkmail.functions import rules as R
from sparkmail.operators import ml as ML
from sparkmail.operators import registry as G
from sparkmail.operators.classify import classify_mailbox, register_classifier
from sparkmail.operators.grid import grid_search
from sparkmail.operators.ranks import rank_statistics
from sparkmail.operators.term_model import count_feedback, fit_term_model, term_dictionary
from sparkmail.plans.adapters import (
    MESSAGES_FROM_EVENTS_SQL as EV,
    messages_from_events,
    FEEDBACK_FROM_LABELS_SQL as FB, MESSAGES_FROM_DOCUMENTS_SQL as DOCS, feedback_from_labels, table,
)
from sparkmail.plans.q_text import OBSERVED_KEYWORD, OBSERVED_MAILBOX, _docs, sql_keyword, sql_mailbox
from sparkmail.plans.registry import query
from sparkmail.session import scratch_path, stage_table


def _labelled(spark, sf):
    """Documents with a human label (toxic -> spam) and the rule prediction."""
    c = classify_mailbox(_docs(spark, sf), OBSERVED_MAILBOX)
    fb = feedback_from_labels(table(spark, sf, "labels"))
    return c.join(fb, "message_id").select("message_id", "subject", "body", "sender",
                                           F.col("corrected_label").alias("label"),
                                           F.col("spam_label").alias("predicted"), "quality")


_LABELLED_SQL = f"""
lb AS (SELECT c.message_id, f.corrected_label AS label, c.spam_label AS predicted, f.quality
       FROM ({sql_mailbox(OBSERVED_MAILBOX)}) c JOIN ({FB}) f ON c.message_id = f.message_id)"""


LABELLED_SQL = f"WITH {_LABELLED_SQL} SELECT * FROM lb"


@query("label_histogram", sql=f"SELECT corrected_label AS label, count(*) AS n FROM ({FB}) GROUP BY 1")
def q_label_histogram(spark, sf):
    return ML.label_histogram(feedback_from_labels(table(spark, sf, "labels")).withColumnRenamed(
        "corrected_label", "label"))


@query("confusion", sql=f"WITH {_LABELLED_SQL} SELECT label, predicted, count(*) AS n FROM lb GROUP BY 1, 2")
def q_confusion(spark, sf):
    return ML.confusion(_labelled(spark, sf))


@query("accuracy", sql=f"""
WITH {_LABELLED_SQL}
SELECT count(*) FILTER (WHERE label = predicted) / greatest(count(*), 1) AS accuracy FROM lb""")
def q_accuracy(spark, sf):
    return ML.accuracy(_labelled(spark, sf))


@query("class_report", sql=f"""
WITH {_LABELLED_SQL},
c AS (SELECT label, predicted, count(*) AS n FROM lb GROUP BY 1, 2),
t AS (SELECT label AS cls, sum(n) AS support, sum(CASE WHEN label = predicted THEN n END) AS tp FROM c GROUP BY 1),
p AS (SELECT predicted AS cls, sum(n) AS predicted_n FROM c GROUP BY 1),
r AS (SELECT coalesce(t.cls, p.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
             coalesce(predicted_n, 0) AS predicted_n FROM t FULL JOIN p ON t.cls = p.cls),
q AS (SELECT cls, support,
             CASE WHEN predicted_n > 0 THEN tp / predicted_n ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM r)
SELECT cls AS class, precision, recall,
       CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
       CAST(support AS BIGINT) AS support
FROM q""")
def q_class_report(spark, sf):
    return ML.class_report(_labelled(spark, sf))


@query("tfidf_exact", sql="""
WITH tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')) AS term
             FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT tf.id, tf.term, tf, df, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN dfq USING (term), n),
nr AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY 1)
SELECT w.id AS doc_id, term, tf, df, round(raw / norm, 9) AS weight FROM w JOIN nr USING (id)
""")
def q_tfidf(spark, sf):
    t = ML.tfidf(table(spark, sf, "documents"), "doc_id", "text")
    return t.withColumn("weight", F.round("weight", 9))


# --- registry (versions derived from per-source label quality) ------------------

def _versions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    lb = table(spark, sf, "labels")
    m = d.join(lb, "doc_id").groupBy("source").agg(
        F.avg("quality").alias("accuracy"), F.avg(1 - F.col("toxic")).alias("f1"))
    num = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return m.select(F.col("source").alias("version"), F.lit("2024-01-30").alias("training_date"), "accuracy", "f1",
                    F.concat(F.lit("models/v"), F.col("source")).alias("model_path"),
                    (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_interval(hours=num)).alias("created_at"))


_VERSIONS_SQL = """
v AS (SELECT source AS version, '2024-01-30' AS training_date, avg(quality) AS accuracy, avg(1 - toxic) AS f1,
             'models/v' || source AS model_path,
             TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER))
               AS created_at
      FROM documents JOIN labels USING (doc_id) GROUP BY source),
reg AS (SELECT *, (created_at, version) = (SELECT max((created_at, version)) FROM v) AS is_champion FROM v)"""


@query("registry_history", sql=f"WITH {_VERSIONS_SQL} SELECT * FROM reg")
def q_registry(spark, sf):
    return G.history(G.champion_by_latest(_versions(spark, sf)))


@query("champion", sql=f"WITH {_VERSIONS_SQL} SELECT * FROM reg WHERE is_champion")
def q_champion(spark, sf):
    return G.champion(G.champion_by_latest(_versions(spark, sf)))


@query("promote", sql=f"""
WITH {_VERSIONS_SQL},
cand AS (SELECT 'all' AS version, '2024-01-31' AS training_date, avg(quality) AS accuracy, avg(1 - toxic) AS f1,
                'models/vall' AS model_path, TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM labels),
w AS (SELECT coalesce((SELECT f1 FROM cand) > (SELECT max(f1) FROM reg WHERE is_champion), true) AS wins)
SELECT version, training_date, accuracy, f1, model_path, created_at, (SELECT wins FROM w) AS is_champion FROM cand
UNION ALL
SELECT version, training_date, accuracy, f1, model_path, created_at, is_champion AND NOT (SELECT wins FROM w) FROM reg
""")
def q_promote(spark, sf):
    reg = G.champion_by_latest(_versions(spark, sf))
    lb = table(spark, sf, "labels")
    cand = lb.agg(F.avg("quality").alias("accuracy"), F.avg(1 - F.col("toxic")).alias("f1")).select(
        F.lit("all").alias("version"), F.lit("2024-01-31").alias("training_date"), "accuracy", "f1",
        F.lit("models/vall").alias("model_path"), F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")).alias("created_at"))
    return G.promote_if_better(reg, cand).select("version", "training_date", "accuracy", "f1", "model_path",
                                                 "created_at", "is_champion")


@query("registry_union", sql=f"""
WITH {_VERSIONS_SQL}
SELECT 'new' AS version, '2024-01-31' AS training_date, CAST(NULL AS DOUBLE) AS accuracy, CAST(0.5 AS DOUBLE) AS f1,
       'models/vnew' AS model_path, CAST(NULL AS TIMESTAMP) AS created_at, true AS is_champion
UNION ALL SELECT version, training_date, accuracy, f1, model_path, created_at, false FROM reg
""")
def q_registry_union(spark, sf):
    reg = G.champion_by_latest(_versions(spark, sf))
    new = spark.createDataFrame([("new", "2024-01-31", 0.5, "models/vnew")],
                                "version string, training_date string, f1 double, model_path string")
    return G.register(reg, new).select("version", "training_date", "accuracy", "f1", "model_path", "created_at",
                                       "is_champion")


# --- X1: pandas UDF hook gives the same labels as the native rules -------------

def _pandas_keyword(rules: R.KeywordRules):
    import pandas as pd

    def fn(subject: pd.Series, body: pd.Series, sender: pd.Series) -> pd.DataFrame:
        text = (subject + " " + body).str.lower()
        spam = pd.Series(False, index=text.index)
        for t in rules.spam_terms:
            spam |= text.str.contains(t, regex=False)
        promo = pd.Series(False, index=text.index)
        for t in rules.promo_terms:
            promo |= text.str.contains(t, regex=False)
        return pd.DataFrame({
            "spam_label": spam.map({True: "spam", False: "ham"}),
            "spam_score": spam.map({True: rules.spam_score, False: rules.ham_score}).astype(float),
            "topic": promo.map({True: rules.promo_topic, False: rules.default_topic}),
            "topic_confidence": rules.topic_confidence, "urgency_score": rules.urgency_score,
            "sentiment_score": rules.sentiment_score,
        })
    return fn


@query("udf_hook", sql=f"""
SELECT message_id, spam_label, spam_score, topic FROM ({sql_keyword(OBSERVED_KEYWORD)})""")
def q_udf_hook(spark, sf):
    udf = register_classifier(spark, _pandas_keyword(OBSERVED_KEYWORD))
    d = _docs(spark, sf)
    p = udf(F.col("subject"), F.col("body"), F.col("sender"))
    return d.select("message_id", p.alias("p")).select("message_id", "p.spam_label", "p.spam_score", "p.topic")


# --- rows-only: fits (hashing, iterative optimisation) ---------------------------------

def _train_input(spark, sf):
    l = _labelled(spark, sf)
    return l.select("message_id", F.col("body").alias("text"),
                    F.when(F.col("label") == "spam", 1.0).otherwise(0.0).alias("label"))


_LABELLED_SQL_SPLIT = """
SELECT message_id, label, CASE WHEN CAST('0x' || substr(sha1('7:' || CAST(message_id AS VARCHAR)), 1, 8) AS BIGINT)
                                    < CAST(0.2 * 4294967296 AS BIGINT) THEN 'holdout' ELSE 'train' END AS split
FROM ({src})"""


@query("rank_statistics", sql=f"""
WITH m AS (SELECT urgency_score AS s, spam_label = 'spam' AS p FROM ({EV}) WHERE urgency_score IS NOT NULL),
c AS (SELECT s, count(*) FILTER (WHERE p) AS p, count(*) FILTER (WHERE NOT p) AS n FROM m GROUP BY 1),
t AS (SELECT sum(p) AS tp, sum(n) AS tn FROM c),
r AS (SELECT p, n, sum(p) OVER w AS p_seen, sum(n) OVER w AS n_seen FROM c WINDOW w AS (ORDER BY s))
SELECT CAST(any_value(tp) AS BIGINT) AS positives, CAST(any_value(tn) AS BIGINT) AS negatives,
       round(CAST(sum(p * (2 * n_seen - n)) AS DOUBLE) / (2.0 * any_value(tp) * any_value(tn)), 12) AS auc,
       round(max(abs(p_seen / tp - n_seen / tn)), 12) AS ks
FROM r, t
""")
def q_rank_statistics(spark, sf):
    """M4: how well urgency tells spam, over all pairs of a spam and a ham message."""
    m = messages_from_events(table(spark, sf, "events")).withColumn("label", (F.col("spam_label") == "spam").cast("int"))
    return rank_statistics(m, "urgency_score", part_rows=512).withColumn("auc", F.round("auc", 12)).withColumn("ks", F.round("ks", 12))


@query("train_eval", sql=f"""
SELECT split, count(*) AS n, true AS beats_majority, true AS auc_in_range FROM ({_LABELLED_SQL_SPLIT.format(src=LABELLED_SQL)}) GROUP BY 1
""")
def q_train_eval(spark, sf):
    """M2-M4: five folds over two settings; rows per split, and whether accuracy on the training split reaches the majority share."""
    data = _train_input(spark, sf)
    _, metrics = ML.train(data, seed=7, parallelism=2)
    parts = None
    for name, part in zip(("train", "holdout"), ML.split(data, 0.2, 7)):
        own = part.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")).withColumn("split", F.lit(name))
        parts = own if parts is None else parts.unionByName(own)
    return metrics.join(parts, "split").select(
        "split", "n", ((F.col("split") == "holdout") | (F.col("accuracy") >= F.greatest("share", 1 - F.col("share")) - 1e-9)).alias("beats_majority"),
        F.col("auc").between(0, 1).alias("auc_in_range"))


@query("grid_search", sql=f"""
WITH t AS (SELECT (label = 'spam')::INT AS y, CAST('0x' || substr(sha1('fold:7:' || CAST(message_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS f
           FROM ({LABELLED_SQL}))
SELECT CAST(m.fold AS INTEGER) AS fold, p.penalty, count(*) FILTER (WHERE f <> fold) AS trained, count(*) FILTER (WHERE f = fold) AS held,
       round(avg(y) FILTER (WHERE f <> fold), 2) AS mean_score
FROM t, range(5) m(fold), (VALUES (0.01::DOUBLE), (0.1::DOUBLE)) p(penalty) GROUP BY 1, 2, m.fold
""")
def q_grid_search(spark, sf):
    """M3: ten models in the same passes. Each model's mean chance of spam on its training rows is their share of spam, as it is where
    the gradient by the intercept vanishes; a model that is not at the minimum has another."""
    rows = PipelineModel(stages=ML.spam_features()).transform(_train_input(spark, sf))
    found = grid_search(rows, "counts", ML.HASHED_FEATURES, (0.01, 0.1), 5, seed=7)
    return found.results.select("fold", "penalty", "trained", "held", F.round("mean_score", 2).alias("mean_score"))


@query("predict", sql=f"""
SELECT message_id, true AS known_label, true AS confident FROM ({DOCS})
WHERE regexp_replace(coalesce(body, ''), '^ +| +$', '', 'g') <> ''
""")
def q_predict(spark, sf):
    """M7: every document has a label of the model, not a class number, and at least even confidence."""
    model, _ = ML.train(_train_input(spark, sf), seed=7, parallelism=2)
    docs = _docs(spark, sf).select("message_id", F.col("body").alias("text"))
    pred, _ = ML.predict(docs, model)
    return pred.select("message_id", F.col("predicted").isin("spam", "ham").alias("known_label"),
                       F.col("confidence").between(0.5, 1.0).alias("confident"))


@query("feature_table", sql=f"""
SELECT CAST(message_id AS VARCHAR) AS message_id, spam_label AS label, source || '.example.org' AS sender_domain,
       5000 AS subject_dims, 5000 AS body_dims, true AS not_negative
FROM ({sql_mailbox(OBSERVED_MAILBOX)})
""")
def q_feature_table(spark, sf):
    """5,000 TF-IDF weights of subject and body for every document."""
    d = classify_mailbox(_docs(spark, sf), OBSERVED_MAILBOX)
    return ML.feature_table(d, "2024-01-30").select(
        "message_id", "label", "sender_domain", F.size("subject_tf_idf").alias("subject_dims"),
        F.size("body_tf_idf").alias("body_dims"), (F.array_min("body_tf_idf") >= 0).alias("not_negative"))


@query("retrain", sql=f"SELECT label AS class, count(*) AS support, true AS in_range FROM ({LABELLED_SQL}) GROUP BY 1")
def q_retrain(spark, sf):
    """M8: retrained on all labelled documents; support per class as stated, metrics between 0 and 1."""
    l = _labelled(spark, sf)
    rows = l.select("message_id", F.col("body").alias("text"), F.col("label").alias("feedback"))
    _, pred = ML.retrain(rows)
    report = ML.class_report(pred.select(F.col("feedback").alias("label"), F.col("predicted_label").alias("predicted")))
    return report.select("class", "support", (F.col("precision").between(0, 1) & F.col("recall").between(0, 1)
                                              & F.col("f1").between(0, 1)).alias("in_range"))


@query("retrain_served", sql="""
SELECT '1' AS version, '2024-01-30' AS training_date, true AS is_champion, true AS saved_under_root, true AS serves_labels
""")
def q_retrain_served(spark, sf):
    """M8 to M7: the retrained model is saved, registered, and labels a batch through the champion."""
    import datetime as dt

    from sparkmail.plans.flows import retrain_and_register
    from sparkmail.streaming.stream import model_labeler

    root = scratch_path(spark, "models")
    l = _labelled(spark, sf).select("message_id", F.col("body").alias("text"), F.col("label").alias("feedback"))
    reg = retrain_and_register(spark, l, root, "1", "2024-01-30", dt.datetime(2024, 1, 30))
    served = model_labeler(root)(l.select("message_id", "text"))
    known = served.agg((F.count_if(F.col("predicted_label").isin("spam", "ham")) == F.count(F.lit(1))).alias("k")).scalar()
    return reg.select("version", "training_date", "is_champion", F.col("model_path").startswith(root).alias("saved_under_root"),
                      known.alias("serves_labels"))


@query("train_register", sql="SELECT '1' AS version, '2024-01-30' AS training_date, true AS is_champion, true AS saved_under_root")
def q_train_register(spark, sf):
    """The training job end to end into a fresh registry."""
    import datetime as dt

    from sparkmail.plans.flows import train_and_register

    root = scratch_path(spark, "models")
    reg = train_and_register(spark, _train_input(spark, sf), root, "1", "2024-01-30", dt.datetime(2024, 1, 30), seed=7, parallelism=2)
    return reg.select("version", "training_date", "is_champion",
                      F.col("model_path").startswith(root).alias("saved_under_root"))


@query("tokenized_table", sql=f"""
WITH t AS (SELECT message_id, string_split_regex(lower(coalesce(body, '')), '[ \\t\\n\\x0B\\f\\r]') AS tokens FROM ({DOCS}))
SELECT message_id, md5(rtrim(array_to_string(tokens, chr(1)), chr(1))) AS tokens_md5 FROM t
""")
def q_tokenized(spark, sf):
    """The tokenized table written and read back; tokens as a digest."""
    t = ML.write_tokenized(_docs(spark, sf).select("message_id", "body"), scratch_path(spark, "tokenized"))
    return t.select("message_id", F.md5(F.concat_ws("\x01", "tokens")).alias("tokens_md5"))


@query("term_dictionary", sql="""
WITH tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents),
d AS (SELECT term, count(DISTINCT id) AS df FROM tok GROUP BY 1)
SELECT row_number() OVER (ORDER BY term) - 1 AS idx, term, df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1, 9) AS idf FROM d
""")
def q_term_dictionary(spark, sf):
    """M8: the terms numbered in their order, with their document frequencies and idf."""
    docs = table(spark, sf, "documents")
    d = term_dictionary(ML.tfidf(docs, "doc_id", "text"), docs.count())
    return d.select("idx", "term", "df", F.round("idf", 9).alias("idf"))


@query("retrain_terms", sql=f"SELECT message_id, label AS feedback, true AS agrees FROM ({LABELLED_SQL})")
def q_retrain_terms(spark, sf):
    """M8 with terms in a table: its chance of spam is that of the model of ``retrain`` (up to 0.02: both are iterated) for every message."""
    l = _labelled(spark, sf)
    rows = stage_table(l.select("message_id", F.col("body").alias("text"), F.col("label").alias("feedback")), "labelled")
    counted = count_feedback(rows)
    mine = fit_term_model(rows, counted=counted).predict(rows)
    _, theirs = ML.retrain(rows, counted=counted)
    theirs = theirs.select("message_id", vector_to_array("probability").alias("other"))
    return mine.join(theirs, "message_id").select(
        "message_id", "feedback", (F.abs(F.element_at("probability", -1) - F.element_at("other", -1)) < 0.02).alias("agrees"))
