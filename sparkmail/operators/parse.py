"""Message parsing: nested mail JSON (F7-F13, F16) and RFC 822 bytes.

Nested JSON is parsed with higher-order functions (``filter``,
``transform``, ``map_from_entries``) inside the JVM. Raw RFC 822 bytes need
a MIME parser, which only exists in Python: ``parse_eml`` runs the standard
library's ``email`` package per Arrow batch (``mapInPandas``) and does only
the MIME walk there; everything after (HTML stripping, address parts,
labels) is native.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmail.functions import rules as R
from sparkmail.functions import text as T
from sparkmail.functions.classify import classify_rules, urgency
from sparkmail.session import ensure_shipped


def _has(c):
    return F.coalesce(c, F.lit("")) != ""


def nested_body(payload) -> "F.Column":
    """body of a nested message.

    The first text/plain part with data wins; else the top-level body;
    else the first text/html part whose stripped text is not empty. Bodies
    are url-safe base64.
    """
    p = F.col(payload) if isinstance(payload, str) else payload
    parts = F.coalesce(p["parts"], F.array())
    plain = F.filter(parts, lambda x: (x["mimeType"] == "text/plain") & _has(x["body"]["data"]))
    html = F.transform(F.filter(parts, lambda x: (x["mimeType"] == "text/html") & _has(x["body"]["data"])),
                       lambda x: T.strip_html(T.decode_b64url(x["body"]["data"])))
    html_ok = F.filter(html, lambda s: s != "")
    top = F.when(_has(p["body"]["data"]), T.decode_b64url(p["body"]["data"])).otherwise(F.lit(""))
    body = (F.when(F.size(plain) > 0, T.decode_b64url(F.element_at(plain, 1)["body"]["data"]))
            .when(top != "", top)
            .when(F.size(html_ok) > 0, F.element_at(html_ok, 1))
            .otherwise(F.lit("")))
    return body


def parse_nested(df: DataFrame, rules: R.MailboxRules = R.MAILBOX_RULES, now=None, limits: dict | None = None) -> DataFrame:
    """F7-F13, F16 + F2-F4: nested message JSON (``schemas.NESTED_MESSAGE``)
    -> the synced-mail row. Rows without an id are dropped. Texts are whole; ``limits`` (such as
    ``rules.STORED_LIMITS``) cuts body, subject, sender and body_preview to so many characters."""
    limits = limits or {}
    h = T.header_map(F.col("payload.headers"))
    subject = F.coalesce(h["subject"], F.lit(""))
    from_ = F.coalesce(h["from"], F.lit(""))
    x = df.where(_has(F.col("id"))).select(
        F.col("id"), subject.alias("subject"), from_.alias("from_header"),
        T.parse_rfc2822(h["date"], now).alias("received_at"),
        T.cut(nested_body(F.col("payload")), limits.get("body")).alias("body"),
        T.attachment_count(F.col("payload.parts")).alias("attachment_count"),
        T.cc_count(h["cc"]).alias("cc_count"),
    )
    addr = T.sender_address("from_header")
    x = x.select("*", addr.alias("sender_email"), T.sender_name("from_header").alias("sender_name"),
                 T.preview("body").alias("body_preview"))
    labels = classify_rules(F.col("subject"), F.col("body"), F.col("sender_email"), rules)
    return x.select(
        F.concat(F.lit("gmail-"), F.col("id")).alias("message_id"),
        T.cut("sender_email", limits.get("sender")).alias("sender"),
        "sender_name",
        T.cut("subject", limits.get("subject")).alias("subject"),
        F.nullif(F.col("body"), F.lit("")).alias("body"),
        F.nullif(T.cut("body_preview", limits.get("body_preview")), F.lit("")).alias("body_preview"),
        "received_at",
        labels["spam_label"].alias("spam_label"), labels["spam_score"].alias("spam_score"),
        labels["topic"].alias("topic"), labels["mailbox_type"].alias("mailbox_type"),
        urgency(F.col("subject"), F.col("body"), rules).alias("urgency_score"),
        "attachment_count", "cc_count",
    )


# --- F19: RFC 822 bytes ----------------------------------------------------------

EML_SCHEMA = ("path string, message_id string, subject string, from_header string, date_header string, "
              "cc_header string, body string, body_is_html boolean, attachment_count int, ok boolean")


def _decoded(value: str) -> str:
    """A header value with its encoded words (RFC 2047) decoded, folded lines joined; words in an unknown
    encoding stay as they are."""
    from email.errors import HeaderParseError
    from email.header import decode_header

    if "=?" not in value:
        return " ".join(value.split())
    out = []
    try:
        for part, charset in decode_header(value):
            if isinstance(part, str):
                out.append(part)
                continue
            try:
                out.append(part.decode(charset or "ascii", errors="replace"))
            except LookupError:
                out.append(part.decode("utf-8", errors="replace"))
    except HeaderParseError:
        return " ".join(value.split())
    return " ".join("".join(out).split())


def _header(message, name: str) -> str:
    """A header's decoded text; '' if it is missing."""
    return _decoded(str(message.get(name, "")))


def _leaf_text(leaf) -> str | None:
    """A text part as text; None if its transfer encoding or charset cannot be read. Bytes that
    the charset does not know become the replacement character."""
    data = leaf.get_payload(decode=True)
    if data is None:
        return None
    try:
        return data.decode(leaf.get_content_charset() or "utf-8", errors="replace")
    except LookupError:
        return data.decode("utf-8", errors="replace")


def _read_message(content: bytes) -> tuple:
    """(id, subject, from, date, cc, body, whether the body is HTML, attachments): the body is the
    first readable text part in order, or all of a message that has no parts."""
    from email import message_from_bytes, policy

    # The light policy leaves headers as text; the default one builds a full grammar of each, which takes most of the time.
    message = message_from_bytes(content, policy=policy.compat32)
    leaves = [p for p in message.walk() if not p.is_multipart()]
    single = len(leaves) == 1 and leaves[0] is message
    wanted = leaves if single else [p for p in leaves if p.get_content_type() in ("text/plain", "text/html")]
    body, kind = next(((t, p.get_content_type()) for p in wanted if (t := _leaf_text(p)) is not None), ("", "text/plain"))
    html = kind == "text/html" or single and "<" in body and ">" in body
    cc = message.get("Cc")
    date = message.get("Date")
    return (_header(message, "Message-ID"), _header(message, "Subject"), _header(message, "From"), None if date is None else _decoded(str(date)),
            None if cc is None else _decoded(str(cc)), body, html, sum(p.get_content_disposition() == "attachment" for p in leaves))


def _mime_walk(frames):
    """Per Arrow batch: MIME-parse ``content`` bytes with the standard library. A message that it
    cannot read keeps its row, with ``ok`` false."""
    import pandas as pd

    names = [f.split(" ")[0] for f in EML_SCHEMA.split(", ")]
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"]):
            try:
                found = _read_message(bytes(content))
                rows.append((path, *[str(x) if isinstance(x, str) else x for x in found], True))
            except Exception:  # noqa: BLE001 - any fault of one message concerns that message only
                rows.append((path, "", "", "", None, None, "", False, 0, False))
        yield pd.DataFrame(rows, columns=names)


def parse_eml(binary_df: DataFrame, rules: R.MailboxRules = R.MAILBOX_RULES, limits: dict | None = None) -> DataFrame:
    """``(path, content)`` rows (as from ``spark.read.format('binaryFile')``)
    -> synced-mail rows. HTML bodies are stripped natively (F6). Texts are whole; ``limits`` as in
    ``parse_nested``.

    The Python side sees Arrow batches capped by both row count and bytes
    (``spark.sql.execution.arrow.maxRecordsPerBatch`` /
    ``maxBytesPerBatch``, 64 MB), so large messages do not pile up in one
    worker's memory."""
    ensure_shipped(binary_df.sparkSession)
    limits = limits or {}
    walked = binary_df.select("path", "content").mapInPandas(_mime_walk, EML_SCHEMA)
    body = T.cut(F.when(F.col("body_is_html"), T.strip_html("body")).otherwise(F.col("body")), limits.get("body"))
    x = walked.withColumn("body", body)
    addr = T.sender_address("from_header")
    labels = classify_rules(F.col("subject"), F.col("body"), addr, rules)
    # Without a Message-ID header the file path stands in for the mailbox's
    # message number; empty bodies and previews are stored as null.
    mid = F.coalesce(F.nullif(F.col("message_id"), F.lit("")), F.concat(F.lit("<"), F.col("path"), F.lit(">")))
    return x.select(
        "path", mid.alias("message_id"), addr.alias("sender"), T.sender_name("from_header").alias("sender_name"),
        T.cut("subject", limits.get("subject")).alias("subject"), F.nullif(F.col("body"), F.lit("")).alias("body"),
        F.nullif(T.cut(T.preview("body"), limits.get("body_preview")), F.lit("")).alias("body_preview"),
        T.parse_rfc2822(F.col("date_header")).alias("received_at"),
        labels["spam_label"].alias("spam_label"), labels["spam_score"].alias("spam_score"),
        labels["topic"].alias("topic"), labels["mailbox_type"].alias("mailbox_type"),
        urgency(F.col("subject"), F.col("body"), rules).alias("urgency_score"),
        "attachment_count", T.cc_count("cc_header").alias("cc_count"), "ok")
