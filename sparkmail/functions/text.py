"""Native Column functions for message text.

All of these build Catalyst expressions; none runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmail.functions import rules as R

# Python's ``str.isspace`` set, written out so that Java regex (Spark) and
# RE2 (the SQL oracle) match exactly what Python's ``\s`` and ``strip()``
# match. Java's plain ``\s`` is ASCII-only and RE2's lacks \x0B.
WS_CLASS = (
    r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c) -> Column:
    """Null -> empty string."""
    return F.coalesce(_c(c), F.lit(""))


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def any_contains(text: Column, terms) -> Column:
    """True when ``text`` holds any of ``terms`` (plain substrings)."""
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def cut(c, max_len: int | None) -> Column:
    """The first ``max_len`` characters; the whole text for None."""
    return _c(c) if max_len is None else F.substring(_c(c), 1, max_len)


def strip_html(c, max_len: int | None = None) -> Column:
    """drop script/style blocks, tags -> space, collapse whitespace, trim; cut only if asked."""
    s = nz(c)
    for pattern in R.HTML_DROP_PATTERNS:
        s = F.regexp_replace(s, f"(?i){pattern}", " ")
    s = F.regexp_replace(s, R.HTML_TAG_PATTERN, " ")
    s = F.regexp_replace(s, f"{WS_CLASS}+", " ")
    return cut(F.trim(s), max_len)


def sender_address(c) -> Column:
    """address inside ``<...>`` when present, else the trimmed text."""
    s = nz(c)
    inside = F.regexp_extract(s, R.ANGLE_ADDRESS_PATTERN, 1)
    has_angle = s.contains("<") & s.contains(">") & (inside != "")
    return F.when(has_angle, py_strip(inside)).otherwise(py_strip(s))


def sender_name(c) -> Column:
    """F8: header minus the address, stripped of `` <>"'``; empty -> null."""
    s = nz(c)
    rest = F.replace(s, sender_address(s), F.lit(""))
    return F.nullif(F.btrim(rest, F.lit(" <>\"'")), F.lit(""))


def preview(c, n: int = R.PREVIEW_CHARS) -> Column:
    """first n characters, newlines -> spaces."""
    return F.replace(F.substring(nz(c), 1, n), F.lit("\n"), F.lit(" "))


def sender_domain(c) -> Column:
    """lower-case part after the last '@'; '' when there is none."""
    s = nz(c)
    return F.when(s.contains("@"), F.lower(F.substring_index(s, "@", -1))).otherwise(F.lit(""))


def cc_count(c) -> Column:
    """comma separated parts of the Cc header; 0 when empty."""
    s = _c(c)
    return F.when(s.isNull() | (s == ""), F.lit(0)).otherwise(F.size(F.split(s, ",", -1)))


def attachment_count(parts) -> Column:
    """parts that carry a file name."""
    p = _c(parts)
    return F.coalesce(F.size(F.filter(p, lambda x: F.coalesce(x["filename"], F.lit("")) != "")), F.lit(0))


def header_map(headers) -> Column:
    """``array<struct<name,value>>`` -> map with lower-case names, last wins.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` (set by ``session.SQL_CONF``).
    """
    h = _c(headers)
    entries = F.transform(h, lambda x: F.struct(F.lower(x["name"]).alias("k"), x["value"].alias("v")))
    return F.when(h.isNull(), F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(entries))


def decode_b64url(c) -> Column:
    """url-safe base64 -> UTF-8 text, bad bytes replaced, bad input -> ''.

    Follows Python's lenient decoder: characters outside the alphabet are
    ignored, and the data must be padded (``=``) to whole 4-character groups,
    otherwise the result is ''."""
    s = F.regexp_replace(F.translate(nz(c), "-_", "+/"), r"[^A-Za-z0-9+/=]", "")
    data = F.regexp_replace(s, "=", "")
    rest = F.length(data) % 4
    pads = F.length(s) - F.length(data)
    ok = (rest == 0) | ((rest == 2) & (pads >= 2)) | ((rest == 3) & (pads >= 1))
    padded = F.concat(data, F.when(rest == 2, F.lit("==")).when(rest == 3, F.lit("=")).otherwise(F.lit("")))
    b = F.when(ok, F.try_to_binary(padded, F.lit("base64")))
    return F.coalesce(F.make_valid_utf8(b.cast("string")), F.lit(""))


def uuid5(c, namespace: str = R.UUID_NAMESPACE_URL, prefix: str = R.STREAM_ID_PREFIX) -> Column:
    """RFC 4122 version-5 UUID of ``prefix + c`` in ``namespace``."""
    ns = F.unhex(F.lit(namespace.replace("-", "")))
    name = F.encode(F.concat(F.lit(prefix), nz(c)), "UTF-8")
    h = F.sha1(F.concat(ns, name))
    variant = F.lower(F.hex(
        F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def compose_text(subject, sender, body, body_preview, max_len: int | None = None) -> Column:
    """``Subject: ..\\nFrom: ..\\n\\n<body or preview, stripped>``; cut only if asked."""
    main = py_strip(F.coalesce(F.nullif(_c(body), F.lit("")), F.nullif(_c(body_preview), F.lit("")), F.lit("")))
    s = F.concat(F.lit("Subject: "), nz(subject), F.lit("\nFrom: "), nz(sender), F.lit("\n\n"), main)
    return cut(s, max_len)


# Date, optionally a time, optionally fraction and zone; all parts either with or without separators.
ISO_EXTENDED = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
ISO_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:[T ](\d{2})(\d{2})(\d{2})?((?:[.,]\d{1,6})?)(Z|[+-]\d{2}:?(?:\d{2})?)?)?$"


def parse_iso_ts(c) -> Column:
    """ISO-8601 text, extended or compact (``Z`` or offset allowed) -> timestamp. Anything
    else, a bare year or a bare time too, is null: the shape is checked before the cast, which
    would complete them."""
    s = _c(c)
    # 20240105T100000Z -> 2024-01-05T10:00:00Z; a time without seconds gets them
    spread = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    spread = F.regexp_replace(spread, r"^(.{10}[T ]\d{2})(\d{2})(\d{2})?", "$1:$2:$3")
    spread = F.regexp_replace(spread, r":(?=$|Z|[+-])", ":00")
    full = F.when(s.rlike(ISO_EXTENDED), s).when(s.rlike(ISO_COMPACT), spread)
    full = F.replace(full, F.lit(","), F.lit("."))
    # an hour alone, and offsets without colon, in the form that the cast reads
    full = F.regexp_replace(full, r"^(.{10}[T ]\d{2})(?=$|Z|[+-])", "$1:00")
    full = F.regexp_replace(full, r"([+-]\d{2})(\d{2})$", "$1:$2")
    full = F.regexp_replace(full, r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00")
    return F.try_to_timestamp(full)


# RFC 2822 date forms after the weekday is removed: numeric zone, zone name
# (GMT, EST, ...), and either without seconds.
RFC2822_PATTERNS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z")
# A date without a zone is UTC.
NO_ZONE = r"\d:\d{2}$"


def parse_rfc2822(c, fallback: Column | None = None) -> Column:
    """F16: ``[Day, ]d Mon yyyy HH:mm[:ss] zone`` -> timestamp, else ``fallback``
    (now, as the reference falls back to the current time)."""
    s = F.regexp_replace(F.trim(nz(c)), r"^[A-Za-z]{3},\s*", "")
    s = F.regexp_replace(s, r"\s+\([^)]*\)$", "")
    # two-digit years: 69-99 are 19xx, 00-68 are 20xx
    s = F.regexp_replace(s, r"^(?<day>\d{1,2}\s+[A-Za-z]{3}\s+)(?=(?:69|[7-9]\d)\s)", "${day}19")
    s = F.regexp_replace(s, r"^(?<day>\d{1,2}\s+[A-Za-z]{3}\s+)(?=\d{2}\s)", "${day}20")
    s = F.when(s.rlike(NO_ZONE), F.concat(s, F.lit(" +0000"))).otherwise(s)
    ts = F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in RFC2822_PATTERNS])
    return F.coalesce(ts, fallback if fallback is not None else F.current_timestamp())


def day(c) -> Column:
    """``yyyy-MM-dd`` text of a timestamp."""
    return F.date_format(_c(c), "yyyy-MM-dd")


def between_days(df, ts_col: str, start: str | None, end: str | None):
    """Rows whose time lies on the days ``start..end`` (either may be None), as plain
    comparisons of the column, so that they reach the Parquet scan and prune row groups."""
    if not start and not end:
        return df
    kind = df.schema[ts_col].dataType
    if kind.simpleString() not in ("timestamp", "timestamp_ntz", "date"):
        ts = F.col(ts_col).cast("timestamp")
        kind = "timestamp"
    else:
        ts = F.col(ts_col)
    if start:
        df = df.where(ts >= F.lit(start).cast("date").cast(kind))
    if end:
        df = df.where(ts < F.date_add(F.lit(end).cast("date"), 1).cast(kind))
    return df


def source_tag(c, default: str = "unknown", n: int = R.SOURCE_TAG_MAX_CHARS) -> Column:
    """pipeline source, empty -> default, capped at n characters."""
    return F.substring(F.coalesce(F.nullif(_c(c).cast("string"), F.lit("")), F.lit(default)), 1, n)
