"""Places of regular-expression matches in a text, with built-in functions only.

Spark has no function for all match positions. But ``split`` gives the gaps
between the matches that ``regexp_extract_all`` gives, and running sums of
their lengths give the positions (in code points).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums run within blocks of so many matches and then over blocks, so that
#: the work does not grow with the square of the matches of one text.
BLOCK = 64
SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def _sums(sizes: Column, first: Column) -> Column:
    """``first`` and then the running sums from it on."""
    return F.aggregate(sizes, F.array(first), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))


def add_matches(df, text: str, name: str, pattern: str, when: Column, group: int | None = None, context: int = 0):
    """Adds ``name``: an array of (start, end, match[, part][, before, after]) of the leftmost
    non-overlapping matches in column ``text``, in order; null where ``when`` is not true or
    nothing matches. ``part`` is the text of ``group``; ``before`` and ``after`` are up to
    ``context`` characters between the match and its neighbours of the same pattern.

    Each step is a column of its own, read at least twice or outside lambdas only: Spark puts an
    expression that is read once into the place that reads it, which in a lambda means once per match.
    """
    def c(x):
        return F.col(f"_{name}_{x}")

    def add(x, value):
        nonlocal df
        df = df.withColumn(f"_{name}_{x}", value)

    some = F.size(c("match")) > 0
    add("match", F.when(when, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))))
    add("gaps", F.when(some, F.split(F.col(text), pattern, -1)))
    add("sizes", F.when(some, F.zip_with(c("match"), F.slice(c("gaps"), 1, F.size(c("match"))),
                                         lambda m, g: F.char_length(m) + F.char_length(g))))
    add("blocks", F.when(some, F.transform(F.sequence(F.lit(0), F.floor((F.size(c("sizes")) - 1) / BLOCK).cast("int")),
                                           lambda b: F.slice(c("sizes"), b * BLOCK + 1, BLOCK))))
    totals = F.transform(c("blocks"), lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
    add("end", F.flatten(F.zip_with(c("blocks"), F.slice(_sums(totals, F.lit(0)), 1, F.size(c("blocks"))),
                                    lambda x, s: F.slice(_sums(x, s), 2, F.size(x)))))
    zipped = {"match": c("match"), "end": c("end")}
    if group is not None:
        add("part", F.when(some, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))))
        zipped["part"] = c("part")
    if context:
        zipped["before"] = F.transform(F.slice(c("gaps"), 1, F.size(c("match"))), lambda g: F.right(g, F.lit(context)))
        zipped["after"] = F.transform(F.slice(c("gaps"), 2, F.size(c("match"))), lambda g: F.left(g, F.lit(context)))
    for x, value in zipped.items():
        if x in ("before", "after"):
            add(x, F.when(some, value))
    rows = F.arrays_zip(*[c(x) for x in zipped])
    found = F.transform(rows, lambda z: F.struct(
        (z[f"_{name}_end"] - F.char_length(z[f"_{name}_match"])).alias("start"), z[f"_{name}_end"].alias("end"),
        *[z[f"_{name}_{x}"].alias(x) for x in zipped if x != "end"]))
    df = df.withColumn(name, F.when(some, found))
    return df.drop(*[x for x in df.columns if x.startswith(f"_{name}_")])


def as_spans(matches: Column, kind: str, order: int, keep=None) -> Column:
    """The matches that ``keep`` accepts as spans of ``kind``; an empty array for null."""
    kept = F.filter(matches, keep) if keep else matches
    return F.coalesce(F.transform(kept, lambda m: F.struct(
        m.start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), m.end.alias("end"))), no_spans())


def in_order(*spans: Column) -> Column:
    return F.array_sort(F.concat(*spans))


def shown(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def merged(spans: Column) -> Column:
    """The union of spans in order as disjoint (start, end) in order."""
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    out = F.aggregate(spans, start, lambda a, s: F.when(
        s.start <= a.end, F.struct(a.done.alias("done"), a.start.alias("start"), F.greatest(a.end, s.end).alias("end"))
    ).otherwise(F.struct(
        F.when(a.end >= 0, F.concat(a.done, F.array(F.struct(a.start.alias("start"), a.end.alias("end"))))).otherwise(a.done).alias("done"),
        s.start.alias("start"), s.end.alias("end"))))
    return F.aggregate(F.array(out), F.array().cast("array<struct<start:int,end:int>>"), lambda _, a: F.when(
        a.end >= 0, F.concat(a.done, F.array(F.struct(a.start.alias("start"), a.end.alias("end"))))).otherwise(a.done))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with each of the disjoint ``spans`` (in order) replaced by ``mask``."""
    def piece(i):
        before = F.when(i > 1, F.element_at(spans, (i - 1).cast("int")).end).otherwise(F.lit(0))
        own = F.element_at(spans, i.cast("int"))
        return F.concat(F.substring(text, before + 1, own.start - before), F.lit(mask))

    cut = F.transform(F.sequence(F.lit(1), F.size(spans)), piece)
    rest = F.substring(text, F.element_at(spans, -1).end + 1, F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(cut, ""), rest)).otherwise(text)
