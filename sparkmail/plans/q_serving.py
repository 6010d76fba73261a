"""Registered queries: the stored roll-up and the substring index."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmail.operators.rollup import RollUp
from sparkmail.operators.text_index import indexed_search, write_text_index
from sparkmail.plans.adapters import MESSAGES_FROM_DOCUMENTS_SQL as DOCS, messages_from_documents, table
from sparkmail.plans.q_analytics import _DASH_SQL, _TREND_SQL, _events, all_days
from sparkmail.plans.registry import ORACLE, query
from sparkmail.session import scratch_path


def rolled_up(spark, messages) -> RollUp:
    """The roll-up of three deltas, each with messages of all days; the first has other labels, which are corrected, and
    the second comes twice."""
    r = RollUp(spark, scratch_path(spark, "roll-up"), buckets=16, shards=4)
    part = [messages.where(F.pmod("message_id", F.lit(3)) == k) for k in range(3)]
    wrong = part[0].withColumn("spam_label", F.lit("spam")).withColumn("urgency_score", F.lit(0.9))
    r.add(wrong, "0")
    r.add(part[1], "1")
    r.add(part[1], "1")
    r.add(part[2], "2")
    r.correct(wrong, part[0], "fix")
    return r


@query("rollup_dashboard", sql=_DASH_SQL)
def q_rollup_dashboard(spark, sf):
    m = _events(spark, sf)
    return rolled_up(spark, m).dashboard(today=all_days(m)[0])


@query("rollup_trend", sql=_TREND_SQL + "SELECT * FROM t")
def q_rollup_trend(spark, sf):
    m = _events(spark, sf)
    end, days = all_days(m)
    return rolled_up(spark, m).trends(end, days=days + 1)


@query("rollup_heatmap", sql=ORACLE["heatmap_grid"])
def q_rollup_heatmap(spark, sf):
    return rolled_up(spark, _events(spark, sf)).heatmap()


@query("search_indexed", sql=f"""
WITH m AS ({DOCS}),
w AS (SELECT lower(arg_min(subject, message_id)) AS w FROM m)
SELECT 'first subject' AS needle, message_id FROM m, w WHERE contains(lower(subject), w) OR contains(lower(body), w)
UNION ALL
SELECT 'wildcards' AS needle, message_id FROM m WHERE subject ILIKE '%worth%ine_ea%' OR body ILIKE '%worth%ine_ea%'
UNION ALL
SELECT 'sender' AS needle, message_id FROM m WHERE sender ILIKE '%U17@%' AND (subject ILIKE '%e%' OR body ILIKE '%e%')
""")
def q_search_indexed(spark, sf):
    """P9, P10 by the index: a text of the table, one with wildcards, and a sender with a text too short for the index."""
    m = messages_from_documents(table(spark, sf, "documents")).withColumn("body_preview", F.col("body"))
    root = scratch_path(spark, "text-index")
    write_text_index(m, root, ts_col="message_id", block_rows=64)
    first = m.agg(F.min_by("subject", "message_id")).first()[0]
    out = [("first subject", indexed_search(spark, root, text=first, escape=True)),
           ("wildcards", indexed_search(spark, root, text="worth%ine_ea")),
           ("sender", indexed_search(spark, root, sender="U17@", text="e"))]
    found = [rows.select(F.lit(name).alias("needle"), "message_id") for name, rows in out]
    return found[0].unionByName(found[1]).unionByName(found[2])
