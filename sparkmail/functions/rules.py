"""Rule lists used by the keyword classifiers.

Rules are plain data. The classifier functions in ``classify.py`` fold a
rule list into one native ``CASE WHEN`` expression, so a rule set can be
swapped at call time (tests and the driver data use lists of terms that
actually occur in the text).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class KeywordRules:
    """Rules of the batch job's classifier (F1)."""
    spam_terms: tuple[str, ...]
    promo_terms: tuple[str, ...]
    spam_score: float = 0.9
    ham_score: float = 0.1
    promo_topic: str = "promotions"
    default_topic: str = "general"
    topic_confidence: float = 0.85
    urgency_score: float = 0.5
    sentiment_score: float = 0.3


@dataclass(frozen=True)
class MailboxRules:
    """Rules of the mailbox classifier (F2, F3) and urgency scorer."""
    spam_terms: tuple[str, ...]
    topics: tuple[tuple[tuple[str, ...], str], ...]
    default_topic: str
    personal_domains: tuple[str, ...]
    urgency_high: tuple[str, ...]
    urgency_medium: tuple[str, ...]
    spam_score: float = 0.9
    ham_score: float = 0.1
    spam_threshold: float = 0.6
    urgency_base: float = 0.3
    urgency_high_step: float = 0.35
    urgency_medium_step: float = 0.2
    urgency_chars: int | None = None


# ---------------------------------------------------------------------------
# FIXED VALUES. These must equal the reference application's rules for the
# labels to agree; they are stated here as data, in their original order.
# ---------------------------------------------------------------------------

# Batch job classifier (F1).
JOB_SPAM_TERMS = ("spam", "winner")
JOB_PROMO_TERMS = ("offer", "deal")

# Mailbox classifier (F2): spam terms, then the ordered topic rules.
MAILBOX_SPAM_TERMS = (
    "winner", "congratulations", "claim now", "click here", "unsubscribe", "viagra", "lottery",
)
MAILBOX_TOPICS = (
    (("meeting", "agenda", "syllabus", "course"), "Academic - Course Materials"),
    (("grant", "research", "paper"), "Research - Grant Opportunities"),
    (("event", "invitation", "seminar"), "Events - Seminars & Conferences"),
    (("order", "shipping", "amazon"), "Shopping"),
    (("newsletter", "subscribe"), "Newsletter"),
)
MAILBOX_DEFAULT_TOPIC = "General Announcements"

# Mailbox type (F3): personal provider domains.
PERSONAL_DOMAINS = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "live.com", "icloud.com")

# Urgency (F4): high and medium phrases.
URGENCY_HIGH = (
    "urgent", "asap", "as soon as possible", "deadline", "due today", "due tomorrow",
    "reply requested", "time sensitive", "action required", "immediately", "critical", "emergency",
)
URGENCY_MEDIUM = (
    "important", "reminder", "meeting in", "follow up", "response needed", "please respond",
    "confirm by", "reminder:",
)

# Topic -> dashboard category (F5), ordered; first match wins.
TOPIC_CATEGORIES = (
    (("academic", "course", "student", "syllabus"), "Academic"),
    (("research", "grant", "paper"), "Research"),
    (("event", "seminar", "conference"), "Events"),
    (("admin", "hr", "policy", "announcement"), "Admin"),
    (("it", "technical"), "IT"),
    (("finance", "budget"), "Finance"),
    (("shop", "order"), "Shopping"),
    (("newsletter", "subscribe"), "Newsletter"),
)
TOPIC_DEFAULT_CATEGORY = "General"

# Other fixed numbers of the reference application.
URGENCY_MAX_CHARS = 10000
HTML_MAX_CHARS = 50000
PREVIEW_CHARS = 300
SUBJECT_MAX_CHARS = 1024
PREVIEW_MAX_CHARS = 500
SENDER_MAX_CHARS = 255
COMPOSED_TEXT_MAX_CHARS = 120000
SOURCE_TAG_MAX_CHARS = 32
URGENT_THRESHOLD = 0.6
SPAM_SECONDS_SAVED = 30
RECENT_LIMIT_MAX = 500
TRAINING_ROW_CAP = 5000
MIN_FEEDBACK_SAMPLES = 5
UUID_NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
STREAM_ID_PREFIX = "mailbox:"
VALID_LABEL_PATTERN = "^(spam|ham)$"
# What a mail row of the reference application holds at most. Not applied unless passed.
STORED_LIMITS = {"body": HTML_MAX_CHARS, "subject": SUBJECT_MAX_CHARS, "sender": SENDER_MAX_CHARS,
                 "body_preview": PREVIEW_MAX_CHARS}
# Markup patterns of the HTML stripper (F6) and the address inside a From header (F7), in order of use.
HTML_DROP_PATTERNS = (r"<script[^>]*>[\s\S]*?</script>", r"<style[^>]*>[\s\S]*?</style>")
HTML_TAG_PATTERN = r"<[^>]+>"
ANGLE_ADDRESS_PATTERN = r"<([^>]+)>"
# ---------------------------------------------------------------------------

JOB_RULES = KeywordRules(spam_terms=JOB_SPAM_TERMS, promo_terms=JOB_PROMO_TERMS)

MAILBOX_RULES = MailboxRules(
    spam_terms=MAILBOX_SPAM_TERMS,
    topics=MAILBOX_TOPICS,
    default_topic=MAILBOX_DEFAULT_TOPIC,
    personal_domains=PERSONAL_DOMAINS,
    urgency_high=URGENCY_HIGH,
    urgency_medium=URGENCY_MEDIUM,
)
