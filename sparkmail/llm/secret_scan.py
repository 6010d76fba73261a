"""Secret scans over a trigram index, with built-in functions only.

From each rule's regular expression a Boolean query over trigrams is derived
that every match satisfies. The index holds, for the trigrams that occur in
these queries, posting lists: the texts with the trigram, by their hashes, in
blocks of a bounded number of texts, so that the list of a trigram that a third of
all texts have is spread like the others. A query is answered block by block: the
lists of an alternative's trigrams are intersected, those of its alternatives
united. The texts found are verified with the regular expression as a whole;
rules without a mandatory trigram scan every text. Two texts with the same hash
would only be verified in vain.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmail.llm import spans as P
from sparkmail.llm.common import if_small
from sparkmail.operators.ranks import col, unused
from sparkmail.session import stage_table


@dataclass(frozen=True)
class Rule:
    """``least`` characters are needed in the match, or in ``group`` if that is given; others are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int | None = None


#: The base kinds. The lengths that ``access`` and ``hex`` need are part of the patterns:
#: both match whole runs, so that changes no match.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further public key formats.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Alternatives that a run of literals may have before it is closed.
MOST = 64
#: Texts of a block of posting lists, about.
BLOCK_TEXTS = 4096

# A query is a frozenset of alternatives, each a frozenset of trigrams that must all occur.
ALL = frozenset([frozenset()])


def _simplest(query):
    return frozenset(x for x in query if not any(y < x for y in query))


def _both(a, b):
    return _simplest(frozenset(x | y for x, y in product(a, b)))


def _of_strings(strings):
    """What a text must contain that holds one of ``strings``."""
    return _simplest(frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings))


def _piece(op, arg):
    """(the strings that this piece of a pattern can be, or None for too many; its query)."""
    if op is C.LITERAL:
        return {chr(arg).lower()}, ALL
    if op is C.IN:
        chars = {chr(v).lower() for o, v in arg if o is C.LITERAL}
        return (chars, ALL) if all(o is C.LITERAL for o, _ in arg) and len(chars) <= 8 else (None, ALL)
    if op is C.AT:
        return {""}, ALL
    if op is C.SUBPATTERN:
        return _walk(arg[-1])
    if op is C.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), ALL
        return None, _simplest(frozenset().union(*(_of_strings(s) if s is not None else q for s, q in parts)))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, sub = arg
        strings, query = _walk(sub)
        if high == 1 and strings is not None:
            return strings | ({""} if low == 0 else set()), ALL
        if low == 0:
            return None, ALL
        return None, _of_strings(strings) if strings is not None else query
    return None, ALL


def _walk(pieces):
    run, query, whole = {""}, ALL, True
    for op, arg in pieces:
        strings, own = _piece(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        query = _both(_both(query, _of_strings(run)), own if strings is None else _of_strings(strings))
        run, whole = {""}, False
    return (run, ALL) if whole else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> frozenset:
    """Alternatives of trigrams (in lower case) of which one set must occur in any text that
    ``pattern`` matches; a single empty alternative if nothing is mandatory."""
    strings, query = _walk(parser.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def posting_lists(df: DataFrame, text: str, hash_col: str, trigrams: list[str], block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """(block, trigram, texts): the index of ``trigrams``, letter case aside, over column ``text``. ``trigram`` is the place in the
    list, ``texts`` the hashes in ``hash_col`` of the block's texts that hold it. Repeated texts are one."""
    low = F.col("_low")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    # explode_outer, and no filter on the list: either would have Spark compute the list once more.
    pairs = df.select(col(hash_col).alias("hash"), F.lower(col(text)).alias("_low")).select("hash", F.explode_outer(held).alias("trigram"))
    pairs = stage_table(pairs.where("trigram is not null").distinct(), "text-trigrams")
    blocks = -(-max(1, pairs.select("hash").distinct().count()) // block_texts)
    pairs = pairs.withColumn("block", F.pmod("hash", F.lit(blocks)))
    return stage_table(pairs.groupBy("block", "trigram").agg(F.collect_list("hash").alias("texts")), "posting-lists")


def answer(index: DataFrame, queries: dict[str, frozenset], trigrams: list[str]) -> DataFrame:
    """(hash, kinds): the texts that satisfy queries, by name. Queries that any text satisfies are left out."""
    none = F.array().cast("array<bigint>")

    def found(query):
        lists = [reduce(F.array_intersect, [F.coalesce(F.try_element_at("lists", F.lit(trigrams.index(t))), none) for t in sorted(x)])
                 for x in sorted(query, key=sorted)]
        return reduce(F.array_union, lists)

    def named(kind):
        return lambda h: F.struct(h.alias("hash"), F.lit(kind).alias("kind"))

    mandatory = {k: q for k, q in queries.items() if frozenset() not in q}
    # All lists of a block: at most ``block_texts`` hashes, about, for each trigram of the rules.
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "texts"))).alias("lists"))
    hits = [F.transform(found(q), named(k)) for k, q in mandatory.items()]
    if not hits:
        return index.sparkSession.createDataFrame([], "hash long, kinds array<string>")
    one = blocks.select(F.explode_outer(F.concat(*hits)).alias("h")).where("h is not null")
    return stage_table(one.groupBy("h.hash").agg(F.collect_set("h.kind").alias("kinds")), "secret-candidates")


def find_secrets(docs: DataFrame, text_col: str = "text", rules=BASE + MORE, name: str = "spans",
                 block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """``docs`` with ``spans``: all matches of ``rules`` in the whole text, as an array of (start,
    ord, kind, end) in order of start and rule; code points, end exclusive. Spans of
    different rules may overlap, those of one rule are leftmost and disjoint.

    A null or empty text has no spans. No row is dropped or repeated; a column
    of ``docs`` called ``name`` is replaced. An empty table gives an empty result. ``docs`` is read
    once when called, for the index, and once with the result.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() for x in q for t in x})
    given = [c for c in docs.columns if c.lower() != name.lower()]
    # Own names, so that no column of docs can clash.
    df = docs.select(F.struct(*[col(c) for c in given]).alias("_row"), F.coalesce(col(text_col), F.lit("")).alias("_text"))
    df = df.withColumn("_hash", F.xxhash64("_text"))
    candidates = answer(posting_lists(df, "_text", "_hash", trigrams, block_texts), queries, trigrams)
    df = df.join(if_small(candidates.select(F.col("hash").alias("_hash"), F.col("kinds").alias("_kinds"))), "_hash", "left")
    for r in rules:
        wanted = F.lit(True) if frozenset() in queries[r.kind] else F.array_contains("_kinds", r.kind)
        df = P.add_matches(df, "_text", f"_{r.kind}", r.pattern, wanted, r.group)

    def kept(r):
        def keep(m):
            return F.char_length(m.part if r.group is not None else m.match) >= r.least
        return P.as_spans(F.col(f"_{r.kind}"), r.kind, rules.index(r), keep if r.least else None)

    spans = P.in_order(*[kept(r) for r in rules])
    return df.select(*[F.col("_row").getField(c).alias(c) for c in given], spans.alias(name))


def redact(docs: DataFrame, text_col: str = "text", rules=BASE + MORE, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each stretch of the text that secrets cover replaced by ``mask``.

    All rows and columns stay, whatever their names; a null text stays null, an empty one empty; repeated
    rows are masked alike; an empty table gives an empty result.
    """
    spans, union = unused(docs.columns, "_spans", "_merged")
    found = find_secrets(docs, text_col, rules, spans).withColumn(union, P.merged(F.col(spans)))
    text = F.when(F.size(union) > 0, P.masked(col(text_col), F.col(union), mask)).otherwise(col(text_col))
    return found.select(*[text.alias(c) if c == text_col else col(c) for c in docs.columns])
