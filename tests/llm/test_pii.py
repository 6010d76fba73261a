"""Personal data: base spans against Python's regular expressions, the rest by properties."""

import random
import re

from sparkmail.llm.pii import BASE, KINDS, find_pii, reliabilities

#: The definitions of the base kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def ok(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), i, k, m.end()) for i, k in enumerate(BASE) for m in re.finditer(PATTERNS[k], text or "") if ok(k, m[0]))


PIECES = ["a@b.c", "x.y+z@mail-1.example.com", "@", ".", "-", " ", "_d@e.f", "é", "😀", "10.0.0.1", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.02.3.255",
          "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+1 (234) 555-1234", "+49.30.1234567", "+1", "123", "call ",
          "555-123-4567", "card: ", "(212) 555-0199", "123-45-6789", "000-00-0000", "\n", "99999999999999999999.1.1.1"]


def texts():
    rng = random.Random(4)
    return ["".join(rng.choices(PIECES, k=rng.randrange(0, 40))) for _ in range(200)] + \
        [None, "", "a" * 5_000, "1" * 5_000, "1 " * 100_000, "a.b-c." * 1_000 + "@x.y", "+1 234 567 8901, me@x.org; " * 3000,
         "m@" + "a." * 50_000 + "b"]


def test_base_spans(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, found int")
    for r in find_pii(df).collect():
        spans = [tuple(s) for s in r.spans]
        want = brute(dict(rows)[r.id])
        assert [s for s in spans if s in set(want)] == want
        extra = [s for s in spans if s not in set(want)]
        assert all(s[2] in KINDS and not any(a < s[3] and s[0] < e for a, _, _, e in want) for s in extra)
        assert spans == sorted(spans)


def test_empty_null_and_repeated(spark):
    df = spark.createDataFrame([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c"), (2, None)], "doc_id long, text string")
    assert sorted(len(r.spans) for r in find_pii(df).collect()) == [0, 1, 1, 1]
    assert find_pii(df.limit(0)).count() == 0
    assert [r.spans for r in find_pii(df.where("text is null")).collect()] == [[]]


def test_weak_candidates_need_evidence(spark):
    rows = [(i, f"please call my phone 555-23{i % 10}-4{i:03d} today") for i in range(100)]
    rows += [(100 + i, f"order 111-111-111{i % 2} and invoice 000-00-000{i % 10}/x") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.spans for r in find_pii(df).collect()}
    found = [bool(got[i]) for i in range(200)]
    assert sum(found[:100]) >= 90 and sum(found[100:]) <= 5


def test_em_separates_reliable_from_random_labelers():
    """Labelers right with 95 % or at random: the likelihoods follow the reliable ones."""
    rng = random.Random(8)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        def vote(right):
            return 1 if (rng.random() < right) == truth else -1
        v = (vote(0.95), vote(0.95), vote(0.9), vote(0.5), 0)
        counts["ip", v] = counts.get(("ip", v), 0) + 1
    post = reliabilities([(k, v, n) for (k, v), n in counts.items()])
    assert all(post["ip", (1, 1, 1, x, 0)] > 0.9 and post["ip", (-1, -1, -1, x, 0)] < 0.1 for x in (1, -1))
