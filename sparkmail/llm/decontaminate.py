"""Benchmark decontamination by winnowing.

Texts become words, words become hashed k-grams, and of every ``window - k +
1`` consecutive k-grams the smallest hash is kept as a fingerprint. Two texts
that share ``window`` consecutive words share all k-grams of that span and so
the fingerprint chosen from it: no shared span of that length is missed.
Fingerprints of documents and benchmark are joined, and in the documents that
share one, the hits are extended: each window around the place of a shared k-gram
is compared word by word with the benchmark's windows.

Built-in functions only; the text is read once for the fingerprints and twice
more for the words of the documents that share one, and is never shuffled
unless the list of these is too large to broadcast. Work on a text grows with its
words and shared places alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmail.llm.common import ascii_lower, if_small
from sparkmail.operators.ranks import col, unused
from sparkmail.session import stage_table

#: A word: neither ASCII punctuation nor white space nor control characters (after A-Z became a-z).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _count(first: Column, last: Column, make) -> Column:
    """``make(i)`` for i = first..last; an empty array if last < first."""
    return F.when(last >= first, F.transform(F.sequence(first, last), make))


def gram_hashes(hashes: Column, k: int) -> Column:
    """The hash of each ``k`` consecutive words, in order; null if there are fewer words."""
    return _count(F.lit(0), F.size(hashes) - k,
                  lambda i: F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in range(k)]))


def least_of(grams: Column, span: int) -> Column:
    """Of each ``span`` consecutive k-gram hashes the smallest; null if there are fewer."""
    # Not array_min(slice(..)): slice copies the whole array each time.
    return _count(F.lit(0), F.size(grams) - span, lambda i: F.least(*[F.get(grams, i + j) for j in range(span)]))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def windows_at(words: Column, starts: Column, n: int) -> Column:
    """(start, stop, words) of ``n`` words from each of ``starts``."""
    return F.transform(starts, lambda s: F.struct(
        s.alias("start"), (s + n).alias("stop"), F.concat_ws(" ", *[F.get(words, s + j) for j in range(n)]).alias("words")))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, n, words): the windows of each item; an item of fewer words is one window."""
    w = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0) \
        .withColumn("n", F.least(F.size("w"), F.lit(window)))
    whole = F.array(F.array_join("w", " "))
    parts = windows_at(F.col("w"), F.sequence(F.lit(0), F.size("w") - window), window).getField("words")
    return w.select("item_id", "n", F.explode_outer(F.when(F.size("w") >= window, parts).otherwise(whole)).alias("words")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    A document word is hit if it lies in an occurrence of a benchmark window
    (``window`` consecutive words of an item, or all words of a shorter item).
    ``items_sha256`` digests the ids of the items with an occurring window,
    sorted as strings and joined by commas (the digest of '' if none).

    Null and empty texts have no words. Rows that repeat an id are judged on
    their own texts. A null id is kept; items with a null id count as no item
    but their words are hit. Empty tables are fine; other columns are not read.
    """
    return judge(docs, items, id_col, text_col, item_id, item_text, window, gram).drop("th")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they are, whatever their names. Options as in ``decontaminate``.

    Null and empty texts stay, rows with a null id or a repeated one are judged by their own texts, and an
    empty table gives an empty result."""
    key, text = unused(docs.columns, "_id", "_th")
    found = judge(docs, items, id_col, text_col, **options).where("contaminated").select(F.col("id").alias(key), F.col("th").alias(text))
    found = stage_table(found.distinct(), "contaminated-rows")
    same = col(id_col).eqNullSafe(F.col(key)) & F.xxhash64(col(text_col)).eqNullSafe(F.col(text))
    return docs.join(if_small(found), same, "left_anti")


def judge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``decontaminate`` with the hash of the text, ``th``, which tells apart rows that repeat an id."""
    # Benchmark side: staged, since its size decides how it is joined. Fingerprints carry the length of their window.
    own = stage_table(item_windows(items, item_id, item_text, window), "bench-windows")
    lengths = sorted(r.n for r in own.select("n").distinct().collect() if r.n < window)  # fewer than ``window`` values
    span = window - gram + 1
    split = own.withColumn("h", word_hashes(F.split("words", " ")))
    prints = split.where(F.col("n") == window).withColumn("g", gram_hashes(F.col("h"), gram)).select(
        "n", F.explode_outer(least_of(F.col("g"), span)).alias("print"))
    for n in lengths:
        prints = prints.unionByName(split.where(F.col("n") == n).select("n", F.explode_outer(gram_hashes(F.col("h"), n)).alias("print")))
    prints = stage_table(prints.distinct(), "bench-prints")

    # Fingerprints of the documents; for short items every k-gram of their length. Each document also has a first entry of
    # its own, which comes through the left join whatever the benchmark holds and brings the number of words along.
    # The hash of the text tells apart rows that repeat an id. (posexplode_outer: Spark would push the
    # filter it infers for explode below these projections and compute them all again in it.)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    hashed = keyed.select("id", "th", word_hashes(words_of(F.col("text"))).alias("h"))
    none = F.array().cast("array<bigint>")
    wanted = [F.array(F.xxhash64("id", "th")), F.coalesce(F.array_distinct(least_of(F.col("g"), span)), none)]
    for n in lengths:
        wanted.append(F.coalesce(gram_hashes(F.col("h"), n), none))
    known = stage_table(prints.select("print", F.lit(True).alias("there")).distinct(), "bench-print-set")
    found = hashed.withColumn("g", gram_hashes(F.col("h"), gram)) \
        .select("id", "th", F.size("h").alias("n_words"), F.concat(*wanted).alias("p")) \
        .select("id", "th", "n_words", F.posexplode_outer("p").alias("pos", "print")).join(if_small(known), "print", "left") \
        .where("there or pos = 0").groupBy("id", "th", "n_words").agg(F.count_if(F.col("pos") == 0).alias("copies"), F.max(F.col("pos") > 0).alias("shares"))
    found = stage_table(found, "contaminated")
    hit = stage_table(found.where("shares").select(F.col("id").alias("hit_id"), F.col("th").alias("hit_th")), "contaminated-hit")

    # The places of shared k-grams in the documents that have any.
    same = F.col("id").eqNullSafe(F.col("hit_id")) & F.col("th").eqNullSafe(F.col("hit_th"))
    read = keyed.join(if_small(hit), same).withColumn("w", words_of(F.col("text")))
    grams = read.select("hit_id", "hit_th", word_hashes(F.col("w")).alias("h"))
    placed = []
    for n in [window, *lengths]:
        grams = grams.withColumn(f"g{n}", gram_hashes(F.col("h"), gram if n == window else n))
        placed.append(grams.select("hit_id", "hit_th", F.lit(n).alias("n"), F.posexplode_outer(f"g{n}").alias("at", "print")))
    shared = reduce(DataFrame.unionByName, placed).join(if_small(prints), ["n", "print"])
    shared = stage_table(shared.groupBy("hit_id", "hit_th").agg(F.collect_set(F.struct("n", "at")).alias("shared")), "contaminated-places")

    # Extension: the windows around each.
    seen = keyed.join(if_small(shared), same).withColumn("w", words_of(F.col("text"))).withColumn("n_words", F.size("w"))

    def places(n):
        return F.transform(F.filter("shared", lambda x: x.n == n), lambda x: x["at"])

    starts = F.array_distinct(F.flatten(F.transform(places(window), lambda p: F.sequence(
        F.greatest(p - (window - gram), F.lit(0)), F.least(p, F.col("n_words") - window)))))
    tried = [windows_at(F.col("w"), starts, window)]
    for n in lengths:
        tried.append(windows_at(F.col("w"), places(n), n))
    spans = seen.select("id", "th", F.explode_outer(F.concat(*tried)).alias("t")).select("id", "th", "t.*").distinct().join(if_small(own), "words") \
        .groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"),
                                 F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("reach"), F.lit(0).alias("words")), lambda a, s: F.struct(
        F.greatest(a.reach, s.stop).alias("reach"),
        (a.words + F.greatest(F.lit(0), s.stop - F.greatest(a.reach, s.start))).alias("words"))).getField("words")
    spans = spans.select(F.col("id").alias("hit_id"), F.col("th").alias("hit_th"), covered.alias("n_hit"), "items")
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.join(spans, same, "left").select(
        "id", "th", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
