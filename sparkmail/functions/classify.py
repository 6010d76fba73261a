"""Rule classifiers as native Column expressions.

A rule list is folded into nested ``CASE WHEN`` at plan time, so the rules
run inside whole-stage codegen instead of a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmail.functions import rules as R
from sparkmail.functions.text import any_contains, nz, sender_domain


def first_match(text: Column, chain, default: str) -> Column:
    """Ordered rules ``((terms, value), ...)``: value of the first rule whose
    terms occur in ``text``; ``default`` when none does."""
    out = None
    for terms, value in chain:
        cond = any_contains(text, terms)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def classify_keyword(subject, body, sender=None, rules: R.KeywordRules = R.JOB_RULES) -> Column:
    """the batch job's classifier -> struct like ``schemas.PREDICTION``."""
    text = F.lower(F.concat(nz(subject), F.lit(" "), nz(body)))
    is_spam = any_contains(text, rules.spam_terms)
    is_promo = any_contains(text, rules.promo_terms)
    return F.struct(
        F.when(is_spam, F.lit("spam")).otherwise(F.lit("ham")).alias("spam_label"),
        F.when(is_spam, F.lit(rules.spam_score)).otherwise(F.lit(rules.ham_score)).alias("spam_score"),
        F.when(is_promo, F.lit(rules.promo_topic)).otherwise(F.lit(rules.default_topic)).alias("topic"),
        F.lit(rules.topic_confidence).alias("topic_confidence"),
        F.lit(rules.urgency_score).alias("urgency_score"),
        F.lit(rules.sentiment_score).alias("sentiment_score"),
    )


def mailbox_type(sender, rules: R.MailboxRules = R.MAILBOX_RULES) -> Column:
    """'personal' when the sender domain holds a provider name."""
    return F.when(any_contains(sender_domain(sender), rules.personal_domains), F.lit("personal")) \
        .otherwise(F.lit("faculty"))


def classify_rules(subject, body, sender, rules: R.MailboxRules = R.MAILBOX_RULES) -> Column:
    """F2 + F3: struct(spam_label, spam_score, topic, mailbox_type)."""
    text = F.lower(F.concat(nz(subject), F.lit(" "), nz(body), F.lit(" "), nz(sender)))
    score = F.when(any_contains(text, rules.spam_terms), F.lit(rules.spam_score)).otherwise(F.lit(rules.ham_score))
    return F.struct(
        F.when(score > rules.spam_threshold, F.lit("spam")).otherwise(F.lit("ham")).alias("spam_label"),
        score.alias("spam_score"),
        first_match(text, rules.topics, rules.default_topic).alias("topic"),
        mailbox_type(sender, rules).alias("mailbox_type"),
    )


def urgency(subject, body, rules: R.MailboxRules = R.MAILBOX_RULES) -> Column:
    """base + step per phrase found in the whole text (or its first ``urgency_chars``
    characters), capped at 1, two decimals (half even on the decimal text of the sum)."""
    text = F.concat(nz(subject), F.lit(" "), nz(body))
    if rules.urgency_chars is not None:
        text = F.substring(text, 1, rules.urgency_chars)
    text = F.lower(text)
    n_high = sum((text.contains(p).cast("int") for p in rules.urgency_high), F.lit(0))
    n_med = sum((text.contains(p).cast("int") for p in rules.urgency_medium), F.lit(0))
    raw = F.lit(rules.urgency_base) + n_high * F.lit(rules.urgency_high_step) + n_med * F.lit(rules.urgency_medium_step)
    return F.bround(F.least(F.lit(1.0), raw), 2)


def topic_category(topic) -> Column:
    """topic name -> dashboard category (substring rules, first wins)."""
    return first_match(F.lower(nz(topic)), R.TOPIC_CATEGORIES, R.TOPIC_DEFAULT_CATEGORY)
