"""Registered queries: daily, dashboard, trend and topic metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmail.functions import rules as R
from sparkmail.operators import analytics as A
from sparkmail.plans.adapters import MESSAGES_FROM_EVENTS_SQL as EV, messages_from_events, table
from sparkmail.plans.registry import query

# First and last day of the stored messages, and the day before the last, in SQL.
FIRST = "(SELECT strftime(min(ts), '%Y-%m-%d') FROM events)"
LAST = "(SELECT strftime(max(ts), '%Y-%m-%d') FROM events)"
BEFORE = "(SELECT strftime(max(ts) - INTERVAL 1 DAY, '%Y-%m-%d') FROM events)"


def _events(spark, sf):
    return messages_from_events(table(spark, sf, "events"))


def all_days(messages) -> tuple[str, int]:
    """The last day of the messages and how many days before it the first one is; 1970-01-01 and 0 if there are none."""
    r = messages.agg(F.date_format(F.max("received_at"), "yyyy-MM-dd").alias("last"),
                     F.date_diff(F.max("received_at").cast("date"), F.min("received_at").cast("date")).alias("days")).first()
    return (r["last"], r["days"]) if r["last"] else ("1970-01-01", 0)


# Shared SQL pieces for the oracle. ``dom`` is F10 (sender domain).
DOM = "CASE WHEN strpos(sender, '@') > 0 THEN lower(reverse(split_part(reverse(sender), '@', 1))) ELSE '' END"


@query("daily_metrics", sql=f"""
WITH m AS ({EV}),
w AS (SELECT * FROM m WHERE classification_date BETWEEN {FIRST} AND {LAST}),
d AS (SELECT classification_date AS metric_date, count(*) AS daily_volume,
             count(*) FILTER (WHERE spam_label = 'spam') AS spam_count,
             count(*) FILTER (WHERE spam_label = 'ham') AS ham_count,
             CAST(sum(CAST(urgency_score AS DECIMAL(38,12))) AS DOUBLE) / count(urgency_score) AS avg_urgency_score
      FROM w GROUP BY 1),
t AS (SELECT metric_date, string_agg(topic || '=' || CAST(n AS VARCHAR), ',' ORDER BY topic) AS topic_distribution
      FROM (SELECT classification_date AS metric_date, topic, count(*) AS n FROM w WHERE topic IS NOT NULL GROUP BY 1, 2)
      GROUP BY 1),
s AS (SELECT metric_date, string_agg(domain || '=' || CAST(n AS VARCHAR), ',' ORDER BY rk) AS top_senders_by_domain
      FROM (SELECT metric_date, domain, n,
                   row_number() OVER (PARTITION BY metric_date ORDER BY n DESC, domain) AS rk
            FROM (SELECT classification_date AS metric_date, {DOM} AS domain, count(*) AS n FROM w GROUP BY 1, 2))
      WHERE rk <= 10 GROUP BY 1)
SELECT d.metric_date, daily_volume, spam_count, ham_count,
       CASE WHEN daily_volume > 0 THEN spam_count / daily_volume ELSE 0.0 END AS spam_rate,
       avg_urgency_score, topic_distribution, top_senders_by_domain
FROM d LEFT JOIN t USING (metric_date) LEFT JOIN s USING (metric_date)
""")
def q_daily_metrics(spark, sf):
    m = _events(spark, sf)
    end, days = all_days(m)
    d = A.daily_metrics(m, end, days=days, top_k=10)
    return d.select("metric_date", "daily_volume", "spam_count", "ham_count", "spam_rate",
                    "avg_urgency_score",
                    A.topic_map_text("topic_distribution").alias("topic_distribution"),
                    A.senders_text("top_senders_by_domain").alias("top_senders_by_domain"))


@query("daily_top_senders", sql=f"""
WITH m AS ({EV}),
c AS (SELECT classification_date AS metric_date, {DOM} AS domain, count(*) AS n FROM m
      WHERE classification_date BETWEEN {FIRST} AND {LAST} GROUP BY 1, 2)
SELECT metric_date, string_agg(domain || '=' || CAST(n AS VARCHAR), ',' ORDER BY rk) AS top_senders_by_domain
FROM (SELECT *, row_number() OVER (PARTITION BY metric_date ORDER BY n DESC, domain) AS rk FROM c)
WHERE rk <= 3 GROUP BY 1
""")
def q_daily_top_senders(spark, sf):
    m = _events(spark, sf)
    end, days = all_days(m)
    t = A.daily_top_senders(m, end, days=days, k=3)
    return t.select("metric_date", A.senders_text("top_senders_by_domain").alias("top_senders_by_domain"))


@query("run_summary", sql=f"""
WITH m AS ({EV})
SELECT classification_date AS date, count(*) AS total,
       count(*) FILTER (WHERE spam_label = 'spam') AS spam_count,
       count(*) FILTER (WHERE spam_label = 'ham') AS ham_count
FROM m GROUP BY 1
""")
def q_run_summary(spark, sf):
    return A.run_summary(_events(spark, sf)).drop("generated_at")


_DASH_SQL = f"""
WITH m AS ({EV}),
a AS (SELECT user_id, count(*) AS total_emails,
             count(*) FILTER (WHERE spam_label = 'spam') AS spam_count,
             CAST(sum(CAST(urgency_score AS DECIMAL(38,12))) AS DOUBLE) / count(urgency_score) AS u,
             CAST(sum(CAST(sentiment_score AS DECIMAL(38,12))) AS DOUBLE) / count(sentiment_score) AS s,
             avg(length(body)) AS len,
             count(*) FILTER (WHERE strftime(received_at, '%Y-%m-%d') = {LAST}) AS td,
             count(*) FILTER (WHERE strftime(received_at, '%Y-%m-%d') = {BEFORE}) AS yd,
             min(received_at) AS mn, max(received_at) AS mx, count(received_at) AS n_ts
      FROM m GROUP BY user_id)
SELECT user_id, total_emails, spam_count,
       CASE WHEN total_emails > 0 THEN round_even(spam_count / total_emails * 100, 2) ELSE 0.0 END AS spam_percentage,
       round_even(coalesce(s, 0.0), 2) AS avg_sentiment,
       round_even(coalesce(u, 0.0), 2) AS avg_urgency,
       round_even(spam_count * 0.5 / 60, 2) AS time_saved_hours,
       CASE WHEN n_ts < 2 THEN 0.0
            ELSE round_even((epoch_us(mx) - epoch_us(mn)) / 1e6 / (n_ts - 1) / 3600, 1) END AS avg_response_time,
       CASE WHEN yd > 0 THEN round_even((td - yd) / yd * 100, 1) WHEN td > 0 THEN 100.0 ELSE 0.0 END
         AS change_from_yesterday,
       CAST(trunc(coalesce(len, 0.0)) AS BIGINT) AS avg_email_length
FROM a
"""


@query("dashboard_scalars", sql=_DASH_SQL)
def q_dashboard(spark, sf):
    m = _events(spark, sf)
    return A.dashboard(m, today=all_days(m)[0])


@query("mean_gap", sql=f"""
WITH m AS ({EV})
SELECT user_id, CASE WHEN count(received_at) < 2 THEN 0.0
  ELSE round_even((epoch_us(max(received_at)) - epoch_us(min(received_at))) / 1e6 / (count(received_at) - 1) / 3600, 1)
  END AS avg_gap_hours
FROM m GROUP BY user_id
""")
def q_mean_gap(spark, sf):
    return A.mean_gap_hours(_events(spark, sf))


_TREND_SQL = f"""
WITH m AS ({EV}),
c AS (SELECT user_id, strftime(received_at, '%Y-%m-%d') AS date, count(*) AS total,
             count(*) FILTER (WHERE spam_label = 'spam') AS spam,
             count(*) FILTER (WHERE spam_label <> 'spam') AS ham,
             count(*) FILTER (WHERE urgency_score > 0.6) AS urgent
      FROM m WHERE strftime(received_at, '%Y-%m-%d') BETWEEN {FIRST} AND {LAST} GROUP BY 1, 2),
sp AS (SELECT u.user_id, strftime(g.d, '%Y-%m-%d') AS date
       FROM (SELECT DISTINCT user_id FROM m) u,
            (SELECT unnest(generate_series(CAST({FIRST} AS DATE), CAST({LAST} AS DATE), INTERVAL 1 DAY)) AS d) g),
t AS (SELECT sp.user_id, sp.date, coalesce(total, 0) AS total, coalesce(spam, 0) AS spam,
             coalesce(ham, 0) AS ham, coalesce(urgent, 0) AS urgent
      FROM sp LEFT JOIN c ON sp.user_id = c.user_id AND sp.date = c.date)
"""


def _trend(spark, sf):
    """The trend of all days."""
    m = _events(spark, sf)
    end, days = all_days(m)
    return A.trends(m, end, days=days + 1)


@query("trend_filled", sql=_TREND_SQL + "SELECT * FROM t")
def q_trend(spark, sf):
    return _trend(spark, sf)


@query("range_totals", sql=_TREND_SQL + """
SELECT user_id, CAST(sum(total) AS BIGINT) AS total_in_range, CAST(sum(spam) AS BIGINT) AS spam_in_range,
       CAST(sum(ham) AS BIGINT) AS ham_in_range, CAST(sum(urgent) AS BIGINT) AS urgent_in_range
FROM t GROUP BY user_id
""")
def q_range_totals(spark, sf):
    return A.range_totals(_trend(spark, sf))


@query("day_change", sql=_TREND_SQL + """
SELECT user_id, date, total, coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY date), 0) AS previous,
       CASE WHEN coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY date), 0) > 0
            THEN round_even((total - lag(total) OVER (PARTITION BY user_id ORDER BY date))
                            / lag(total) OVER (PARTITION BY user_id ORDER BY date) * 100, 1)
            WHEN total > 0 THEN 100.0 ELSE 0.0 END AS change_pct
FROM t
""")
def q_day_change(spark, sf):
    return A.day_change_series(_trend(spark, sf))


@query("heatmap_grid", sql=f"""
WITH m AS ({EV}),
c AS (SELECT user_id, dayofweek(received_at) + 1 AS day, hour(received_at) AS hour, count(*) AS volume
      FROM m GROUP BY 1, 2, 3),
g AS (SELECT u.user_id, CAST(i // 24 + 1 AS INTEGER) AS day, CAST(i % 24 AS INTEGER) AS hour
      FROM (SELECT DISTINCT user_id FROM m) u, range(168) r(i))
SELECT g.user_id, g.day, g.hour, coalesce(c.volume, 0) AS volume
FROM g LEFT JOIN c ON g.user_id = c.user_id AND g.day = c.day AND g.hour = c.hour
""")
def q_heatmap(spark, sf):
    return A.heatmap(_events(spark, sf))


_TOPIC_CAT_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(t), '{w}')" for w in words) + f" THEN '{name}'"
    for words, name in R.TOPIC_CATEGORIES) + f" ELSE '{R.TOPIC_DEFAULT_CATEGORY}' END"


@query("top_topics", sql=f"""
WITH m AS ({EV}),
c AS (SELECT topic AS t, count(*) AS count FROM m WHERE topic IS NOT NULL GROUP BY 1
      ORDER BY count DESC, t LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY count DESC, t) AS INTEGER) AS rank, t AS name, {_TOPIC_CAT_SQL} AS category, count FROM c
""")
def q_top_topics(spark, sf):
    return A.top_topics(_events(spark, sf), k=10)


@query("top_topics_per_user", sql=f"""
WITH m AS ({EV}),
c AS (SELECT user_id, topic AS t, count(*) AS count FROM m WHERE topic IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY count DESC, t) AS INTEGER) AS rank FROM c)
SELECT user_id, rank, t AS name, {_TOPIC_CAT_SQL} AS category, count FROM r WHERE rank <= 3
""")
def q_top_topics_user(spark, sf):
    return A.top_topics(_events(spark, sf), k=3, by=("user_id",))


@query("topic_share", sql=f"""
WITH m AS ({EV}),
c AS (SELECT user_id, topic AS t, count(*) AS count FROM m WHERE topic IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY count DESC, t) AS INTEGER) AS rank FROM c),
k AS (SELECT * FROM r WHERE rank <= 4)
SELECT user_id, rank, t AS name, count,
       round(count / sum(count) OVER (PARTITION BY user_id) * 100, 1) AS share_pct,
       CAST(round(count / max(count) OVER (PARTITION BY user_id) * 100, 0) AS INTEGER) AS of_max_pct
FROM k
""")
def q_topic_share(spark, sf):
    top = A.top_topics(_events(spark, sf), k=10, by=("user_id",))
    return A.with_shares(top, shown=4, by=("user_id",))


@query("unknown_user", sql=f"""
WITH e AS (SELECT min(user_id) - 1 AS user_id FROM ({EV}))
SELECT user_id, CAST(0 AS BIGINT) AS total_emails, CAST(0 AS DOUBLE) AS spam_percentage, CAST(0 AS DOUBLE) AS avg_urgency,
       CAST(0 AS DOUBLE) AS avg_gap_hours, (SELECT date_diff('day', CAST({FIRST} AS DATE), CAST({LAST} AS DATE)) + 1) AS trend_days, CAST(168 AS BIGINT) AS cells, CAST(0 AS BIGINT) AS volume
FROM e
""")
def q_unknown_user(spark, sf):
    """A user without mail has zeros, a zero-filled trend and an empty grid."""
    m = _events(spark, sf)
    user = m.agg(F.min("user_id")).first()[0] - 1
    end, days = all_days(m)
    d = A.dashboard(m, end, user_id=user).select("user_id", "total_emails", "spam_percentage", "avg_urgency")
    g = A.mean_gap_hours(m, user_id=user)
    t = A.trends(m, end, days + 1, user_id=user).groupBy("user_id").agg(F.count(F.lit(1)).alias("trend_days"))
    h = A.heatmap(m, user_id=user).groupBy("user_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("volume").alias("volume"))
    return d.join(g, "user_id").join(t, "user_id").join(h, "user_id")
