"""Personal data by weak supervision, with built-in functions only.

Candidates are matches of the base patterns and of looser ones. Labelers
(format checks, word lists, the text around) vote +1, -1 or abstain on each;
expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is, per kind, and so how likely each pattern is
personal data. These likelihoods are the labels on which the final span
classifier (naive Bayes over votes and shape of a span) is fitted. Matches
that meet a base definition always stay; the classifier decides on the rest.

The text is read once, spans and votes are written to the shared folder. What
comes to the driver is one count per vote pattern or feature value, a number
fixed by the labelers and not by the corpus.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmail.llm import spans as P
from sparkmail.session import stage_table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "social")
#: Patterns as the base kinds define them. Possessive repeats and the look-behinds only save
#: time: a run of such characters is entered at its start (or where the last match ended).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must contain for the pattern to match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]",
         "local_phone": r"[0-9]{3}[.-][0-9]{4}", "social": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Gazetteers: words that announce each kind, and words that announce other numbers.
CUES = {
    "email": r"e-?mail|mailto|contact|write to|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|adresse|direcci",
    "card": r"card|visa|master|amex|carte|tarjeta|karte|kredit|cr[eé]dit",
    "phone": r"phone|tel\b|tel[eé.]|call|mobile|fax|appel|llam|anruf|handy",
    "local_phone": r"phone|tel\b|tel[eé.]|call|mobile|fax|appel|llam|anruf|handy",
    "social": r"ssn|social security|\bsoc\b",
}
OTHER_NUMBERS = r"isbn|order|invoice|version|page|build|serial|article no|item no|ticket|ref\b|id\b|chapter|section"
CONTEXT = 40


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 1 to 19 digits has a valid check digit."""
    at = F.sequence(F.lit(1), F.length(number))
    value = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.pmod(d.cast("int") * 2, F.lit(10)) + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(F.slice(value, 1, F.size(at)), F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The check that a base kind asks of a match; for the looser kinds a plausible number."""
    n = F.length(digits(match))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    if kind == "local_phone":
        return digits(match).rlike("^[2-9][0-9]{2}[2-9]")
    return ~match.rlike("^(?:000|666|9)|-00-|-0000$")


@dataclass(frozen=True)
class Labeler:
    """``vote(kind, match, before, after, valid)`` gives 1, -1 or 0 (abstains)."""

    name: str
    vote: object


def _format(kind, m, before, after, ok):
    return F.when(ok, 1).otherwise(-1)


def _gazetteer(kind, m, before, after, ok):
    return F.when(F.lower(before).rlike(CUES[kind]), 1).when(F.lower(before).rlike(OTHER_NUMBERS), -1).otherwise(0)


def _alone(kind, m, before, after, ok):
    joined = before.rlike(r"[\p{L}\p{N}_/=-]$") | after.rlike(r"^[\p{L}\p{N}_/=-]")
    return F.when(joined, -1).otherwise(1)


def _variety(kind, m, before, after, ok):
    different = F.size(F.array_distinct(F.split(m, "")))
    return F.when(different <= 4, -1).when(different >= 7, 1).otherwise(0)


def _unit(kind, m, before, after, ok):
    return F.when(before.rlike(r"[$€£#]\s?$") | after.rlike(r"^\s?(?:%|€|\$|kg|km|cm|mm|px|kb|mb|gb)"), -1).otherwise(0)


LABELERS = (Labeler("format", _format), Labeler("gazetteer", _gazetteer), Labeler("alone", _alone),
            Labeler("variety", _variety), Labeler("unit", _unit))
#: Assumed at the start: how often a labeler that votes is right, and the share of personal data.
FIRST_RELIABILITY, FIRST_SHARE, ROUNDS = 0.8, 0.5, 25


CANDIDATE = "array<struct<start:int,ord:int,kind:string,end:int,base:boolean,size:int,votes:array<int>>>"


def _checked(kind):
    return lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), m.match.alias("match"),
                              m.before.alias("before"), m.after.alias("after"), valid(kind, m.match).alias("ok"),
                              F.length(digits(m.match)).alias("digits"))


def _judged(kind, order):
    def judged(m):
        votes = [x.vote(kind, m.match, m.before, m.after, m.ok).cast("int") for x in LABELERS]
        base = (m.ok if kind in BASE else F.lit(False)).alias("base")
        return F.struct(m.start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), m.end.alias("end"),
                        base, F.least(m.digits, F.lit(20)).alias("size"), F.array(*votes).alias("votes"))
    return judged


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, found): per document an array of candidates (start, ord, kind, end, base, size, votes)."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = []
    for order, kind in enumerate(KINDS):
        df = P.add_matches(df, "text", f"raw_{kind}", PATTERNS[kind], F.col("text").rlike(NEEDS[kind]), context=CONTEXT)

        # A column of its own: read more than once below.
        df = df.withColumn(f"ok_{kind}", F.transform(f"raw_{kind}", _checked(kind)))
        # Short numbers with separators are no cards of any kind.
        near = F.filter(f"ok_{kind}", lambda m: m.ok | (m.digits >= 12)) if kind == "card" else F.col(f"ok_{kind}")
        parts.append(F.coalesce(F.transform(near, _judged(kind, order)), F.array().cast(CANDIDATE)))
    return df.select("id", F.concat(*parts).alias("found"))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]]) -> dict[tuple[str, tuple[int, ...]], float]:
    """(kind, votes) -> probability of personal data, from (kind, votes, count), by
    expectation-maximisation: per kind a share and, per labeler, the rate at which
    it votes +1, 0, -1 on personal data and on the rest."""
    out = {}
    by_kind = defaultdict(list)
    for kind, votes, n in patterns:
        by_kind[kind].append((votes, n))
    for kind, rows in by_kind.items():
        right = FIRST_RELIABILITY
        yes = [{1: right, 0: 0.5, -1: 1 - right} for _ in LABELERS]
        no = [{1: 1 - right, 0: 0.5, -1: right} for _ in LABELERS]
        share = FIRST_SHARE
        for _ in range(ROUNDS):
            post = {}
            for votes, _ in rows:
                odds = math.log(share / (1 - share)) + sum(math.log(y[v] / x[v]) for y, x, v in zip(yes, no, votes))
                post[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            total = sum(n for _, n in rows)
            inside = sum(post[v] * n for v, n in rows)
            share = (inside + 1) / (total + 2)
            for i in range(len(LABELERS)):
                for table, weight in ((yes, lambda v: post[v]), (no, lambda v: 1 - post[v])):
                    got = {s: sum(weight(v) * n for v, n in rows if v[i] == s) + 1 for s in (1, 0, -1)}
                    table[i] = {s: x / sum(got.values()) for s, x in got.items()}
        out |= {(kind, v): p for v, p in post.items()}
    return out


def features(kind: Column, size: Column, votes: Column) -> list[Column]:
    """The classifier's features of a span, as strings."""
    return [F.concat(kind, F.lit(f"|{l.name}|"), F.get(votes, F.lit(i)).cast("string")) for i, l in enumerate(LABELERS)] + \
        [F.concat(kind, F.lit("|size|"), size.cast("string"))]


def fit(found: DataFrame) -> Column | None:
    """A function of a candidate that gives its log-odds, as fitted; None without candidates."""
    # One row per (kind, size, votes): their number is bounded by the labelers, not by the corpus.
    counted = found.select(F.explode_outer("found").alias("c")).where("c is not null") \
        .groupBy("c.kind", "c.size", "c.votes").agg(F.count("*").alias("n")).collect()
    if not counted:
        return None
    votes = defaultdict(int)
    for r in counted:
        votes[r.kind, tuple(r.votes)] += r.n
    post = reliabilities([(k, v, n) for (k, v), n in sorted(votes.items())])
    weight, total = defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: [1.0, 1.0])
    for r in counted:
        p = post[r.kind, tuple(r.votes)]
        names = [f"{r.kind}|{l.name}|{v}" for l, v in zip(LABELERS, r.votes)] + [f"{r.kind}|size|{r['size']}"]
        for x in names:
            weight[x][0] += p * r.n
            weight[x][1] += (1 - p) * r.n
        total[r.kind][0] += p * r.n
        total[r.kind][1] += (1 - p) * r.n
    log = {x: math.log(a / total[x.split("|")[0]][0]) - math.log(b / total[x.split("|")[0]][1]) for x, (a, b) in weight.items()}
    log |= {k: math.log(a / b) for k, (a, b) in total.items()}
    table = F.create_map(*[F.lit(v) for kv in sorted(log.items()) for v in kv])

    def odds(c):
        own = [c.kind, *features(c.kind, c["size"], c.votes)]
        return reduce(lambda a, b: a + b, [F.coalesce(table[x], F.lit(0.0)) for x in own])

    return odds


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """(id, spans): the personal data in the whole text of each row, as (start, ord, kind, end) in order
    of start and kind; code points, end exclusive.

    Every match that meets a base definition is there (leftmost, disjoint within its kind); looser
    candidates are added where the classifier's log-odds exceed ``least``, unless a base span covers
    part of them. A null or empty text has no spans; rows are neither dropped nor joined, also if
    ids repeat or are null; other columns are not read. Empty tables are fine.
    """
    found = stage_table(candidates(docs, id_col, text_col), "pii-candidates")
    odds = fit(found)

    def plain(xs):
        return F.transform(xs, lambda c: F.struct(c.start.alias("start"), c.ord.alias("ord"), c.kind.alias("kind"), c.end.alias("end")))

    base = F.filter("found", lambda c: c.base)
    if odds is None:
        return found.select("id", F.array_sort(plain(base)).alias("spans"))
    more = F.filter("found", lambda c: ~c.base & (odds(c) > least))
    rows = found.select("id", plain(base).alias("base"), plain(more).alias("more"))
    free = F.filter("more", lambda c: ~F.exists("base", lambda b: (b.start < c.end) & (c.start < b.end)))
    return rows.select("id", F.array_sort(F.concat("base", free)).alias("spans"))
