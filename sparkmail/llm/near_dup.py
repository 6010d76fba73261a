"""Near-duplicate documents by one-permutation sketches, and exactly.

A document is the set of its hashed word shingles. Documents with equal sets
are one class, and only the classes' smallest ids go on. One pass over the text
makes a sketch of each set (one-permutation hashing with optimal
densification) and cuts it into bands; classes with an equal band share a
bucket, and each member of a bucket is paired with one centre (a star), so the
pairs grow with the members and not with their square. Pairs are confirmed on the
full sets, and their components found.

Bands can miss a link, and a star tests only the pairs with its centre. So what the
stars leave in different components goes through prefix filtering: the shingles of
all sets are put into one order, rare ones first, and two sets that are similar enough
must have a shingle in common among the first few of each (the prefix). Every pair of
such a bucket that is still in different components is tried: no link is left out, and
shingles of a template or passage that many documents share come last and make no bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmail.llm import shingles as S
from sparkmail.llm.common import if_small, python_ready
from sparkmail.llm.components import components
from sparkmail.operators.ranks import col, unused
from sparkmail.session import stage_table

#: Counters of shingles by hash, from which their order is made, in slices. Shingles that share a counter
#: count together; this shifts the order, which costs time at most, never a link.
COUNTERS, SLICES = 1 << 20, 64
#: Bits of a set's signature, by which most pairs are ruled out without their texts.
BITS = 1024
#: Bins and bands of a sketch: sets with similarity s share a band with probability 1 - (1 - s**5)**25,
#: which is 0.99995 at 0.8.
BINS, BANDS = 125, 25
#: Rounds of stars in the bands' buckets before all remaining pairs are tried by prefixes.
STARS = 2


def _longs(values) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def _counter(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(COUNTERS - 1)).astype(np.int64)


def _slices(total: np.ndarray, kind: type):
    """(slice, counts) of the slices of ``total`` that are not zero."""
    return [(i, part.astype(kind)) for i, part in enumerate(total.reshape(SLICES, -1)) if part.any()]


def _signature(found: np.ndarray) -> bytes:
    """Per bit, whether an odd number of the set's shingles fall on it: two sets' signatures differ in as
    many bits at most as there are shingles in only one of them."""
    odd = np.bincount(((found >> np.uint64(24)) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, key1, key2, bands, slice, counts): size of the shingle set, two hashes of the whole set and the bands of
    its sketch; after these rows (``slice`` null) each task adds its counts of shingles, a row for each slice of counters."""
    names = ["id", "n", "key1", "key2", "bands", "slice", "counts"]
    listed = pa.list_(pa.int64())

    def run(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            found = [S.shingle_set(w, size) for w in S.word_hashes([t or b"" for t in batch.column(1).to_pylist()])]
            total += np.bincount(_counter(np.concatenate([*found, np.empty(0, dtype=np.uint64)])), minlength=COUNTERS)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in found], pa.int64()),
                pa.array(_longs([S.mix(s).sum(dtype=np.uint64) for s in found])),
                pa.array(_longs([np.bitwise_xor.reduce(S.mix(s ^ np.uint64(0x5851F42D4C957F2D))) for s in found])),
                pa.array([_longs(S.band_keys(S.one_permutation(s, BINS), BANDS)) if len(s) else None for s in found], listed),
                pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary())], names=names)
        parts = _slices(total, np.uint32)
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(parts), listed), pa.array([i for i, _ in parts], pa.int32()),
                                          pa.array([p.tobytes() for _, p in parts], pa.binary())], names=names)

    python_ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")) \
        .mapInArrow(run, "id long, n long, key1 long, key2 long, bands array<long>, slice int, counts binary")


def counters(counts: DataFrame) -> np.ndarray:
    """The sums of all tasks' (slice, counts): COUNTERS numbers, whatever the size of the table."""
    def run(batches):
        total = np.zeros((SLICES, COUNTERS // SLICES), dtype=np.int64)
        for batch in batches:
            for i, part in zip(*(c.to_pylist() for c in batch.columns)):
                total[i] += np.frombuffer(part, dtype=np.uint32)
        parts = _slices(total, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()),
                                          pa.array([p.tobytes() for _, p in parts], pa.binary())], names=["slice", "counts"])

    total = np.zeros((SLICES, COUNTERS // SLICES), dtype=np.int64)
    for r in counts.repartition("slice").mapInArrow(run, "slice int, counts binary").collect():
        total[r["slice"]] += np.frombuffer(r["counts"], dtype=np.int64)
    return total.reshape(-1)


def prefixes(texts: DataFrame, total: np.ndarray, size: int, percent: int) -> DataFrame:
    """(rep, n, sig, keys): size, signature and prefix of the shingle set of each (id, text), shingles in order.

    A partner's set has ``percent`` of the n shingles at least, so all but the
    last ceil(n * percent / 100) - 1 shingles hold the first common one."""
    # Counts by their logarithm, as one byte each.
    rank = np.minimum(np.ceil(6 * np.log2(total + 1)), 255).astype(np.uint8).tobytes()

    def run(batches):
        ranks = np.frombuffer(rank, dtype=np.uint8)
        for batch in batches:
            found = [S.shingle_set(w, size) for w in S.word_hashes(batch.column(1).to_pylist())]
            keys = [s[np.lexsort((s, ranks[_counter(s)]))][:len(s) - max(1, -(-percent * len(s) // 100)) + 1] for s in found]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate([*keys, np.empty(0, dtype=np.uint64)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([_signature(s) for s in found], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(_longs(flat)))], names=["rep", "n", "sig", "keys"])

    return texts.select("id", "text").mapInArrow(run, "rep long, n long, sig binary, keys array<long>")


def possible(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose (rep, n, sig) do not rule a link out: linked sets have at most
    (100 - percent) / (100 + percent) of their sizes' sum in only one of them."""
    def run(batches):
        for batch in batches:
            a, b, both, one, two = batch.columns
            x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8) for c in (one, two))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            kept = pa.array((100 + percent) * apart <= (100 - percent) * both.to_numpy())
            yield pa.RecordBatch.from_arrays([a.filter(kept), b.filter(kept)], names=["a", "b"])

    one, two = (sigs.select(F.col("rep").alias(i), F.col("n").alias(f"n_{i}"), F.col("sig").alias(f"sig_{i}")) for i in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", F.expr("n_a + n_b").alias("both"), "sig_a", "sig_b") \
        .mapInArrow(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` with 100 * intersection >= percent * union of their shingle sets."""
    def run(batches):
        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            known = list(dict.fromkeys([*ta, *tb]))
            sets = dict(zip(known, (S.shingle_set(w, size) for w in S.word_hashes(known))))
            kept = []
            for i, (x, y) in enumerate(zip(ta, tb)):
                x, y = sets[x], sets[y]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and 100 * common >= percent * (len(x) + len(y) - common):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()),
                                              pa.array([b[i] for i in kept], pa.int64())], names=["a", "b"])

    one, two = (texts.join(if_small(pairs.select(F.col(i).alias("id")).distinct()), "id", "left_semi")
                .select(F.col("id").alias(i), F.col("text").alias(f"text_{i}")) for i in "ab")
    return one.join(if_small(pairs), "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _enough(common, n, m, percent: int):
    """Whether sets of n and m shingles with ``common`` in common are linked."""
    return (100 + percent) * common >= percent * (n + m)


def stars(members: DataFrame, percent: int, step: int) -> DataFrame:
    """(a, b), a < b: each member of a bucket (key, rep, n, label) of several components with the bucket's centre, unless
    both are in one component or their sizes rule a link out. The centre is picked by a hash: at first the same
    for all buckets that a set is in, which keeps the pairs few; then another one in each bucket."""
    order = F.xxhash64("rep") if step == 0 else F.xxhash64("rep", "key", F.lit(step))
    hubs = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                      F.min_by(F.struct("rep", "n", "label"), order).alias("c")).where("low < high").select("key", "c")
    hubs = stage_table(hubs, "near-dup-stars")
    return members.join(if_small(hubs), "key").where(F.col("label") != F.col("c.label")) \
        .where(_enough(F.least(F.col("n"), F.col("c.n")), F.col("n"), F.col("c.n"), percent)) \
        .select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).where("a < b").distinct()


def open_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: all pairs of members of a bucket (key, rep, n, pos, label) in different components,
    but for those that cannot be linked with this shingle as their first common one: what comes from
    there on in each set (n - pos shingles) bounds the intersection. A linked pair is in the bucket of
    its first common shingle."""
    mixed = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    members = members.join(mixed, "key", "left_semi").select("key", "rep", "n", "label", (F.col("n") - F.col("pos")).alias("rest"))
    one, two = (members.select("key", *[F.col(c).alias(f"{c}_{i}") for c in ("rep", "n", "label", "rest")]) for i in "ab")
    return one.join(two, "key").where("rep_a < rep_b and label_a <> label_b") \
        .where(_enough(F.least("rest_a", "rest_b"), F.col("n_a"), F.col("n_b"), percent)) \
        .select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    A document's set holds the distinct ``size``-word shingles of its words
    (runs of anything but ASCII white space, A-Z lower-cased); with fewer
    words the whole sequence is one shingle; null or blank text has an empty
    set and is linked with nothing. Documents are linked where 100 *
    intersection >= percent * union; ``component_id`` is the smallest id
    reachable over links, and ``kept`` marks that document.

    Rows with a null id are linked with nothing: ``component_id`` is null and
    ``kept`` true. Rows that repeat an id count as one document whose links
    are those of all of them. An empty table gives an empty result; other
    columns of ``docs`` are not read.
    """
    sk = stage_table(sketch(docs, id_col, text_col, size), "near-dup-sketch")
    total = counters(sk.where("slice is not null").select("slice", "counts"))
    sk = sk.where("slice is null")
    same = ["n", "key1", "key2"]
    # A row's class; an id that has rows in several classes links them.
    classes = sk.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"))
    own = stage_table(sk.join(classes, same, "left").select("id", "n", "rep"), "near-dup-own")
    hubs = own.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("id", "a")
    hubs = stage_table(hubs, "near-dup-ids")
    links = own.join(hubs, "id").where("a < rep").select("a", F.col("rep").alias("b")) if hubs.limit(1).count() else None

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")) \
        .where("id is not null and text is not null")
    reps = stage_table(own.where("id = rep").select("id").distinct(), "near-dup-reps")
    found = stage_table(prefixes(texts.join(if_small(reps), "id", "left_semi"), total, size, percent), "near-dup-prefixes")
    sigs = found.select("rep", "n", "sig")
    # One bucket per band, and one per shingle of a prefix (only those with several members go on).
    bands = sk.join(if_small(reps), "id", "left_semi").where("n > 0").select(F.col("id").alias("rep"), "n", F.explode("bands").alias("key"))

    def by_prefix(labels):
        members = found.select("rep", "n", F.posexplode("keys").alias("pos", "key"))
        shared = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
        return open_pairs(stage_table(members.join(shared, "key"), "near-dup-members").join(if_small(labels), "rep"), percent)

    def labelled(links):
        """The components of ``links``, which stand for the links from then on, and all labels."""
        linked = stage_table(components(links), "near-dup-linked")
        labels = reps.select(F.col("id").alias("rep")).join(linked.withColumnRenamed("id", "rep"), "rep", "left") \
            .select("rep", F.coalesce("label", "rep").alias("label"))
        return linked, linked.select(F.col("label").alias("a"), F.col("id").alias("b")), stage_table(labels, "near-dup-labels")

    linked, tested = None, None
    labels = reps.select(F.col("id").alias("rep"), F.col("id").alias("label"))
    if links is not None:
        linked, links, labels = labelled(links)
    for step in range(STARS + 1):
        pairs = stars(bands.join(if_small(labels), "rep"), percent, step) if step < STARS else by_prefix(labels)
        pairs = possible(pairs, sigs, percent)
        pairs = stage_table(pairs.join(if_small(tested), ["a", "b"], "left_anti") if step else pairs, "near-dup-pairs")
        confirmed = stage_table(confirm(pairs, texts, size, percent), "near-dup-links")
        tested = tested.unionByName(pairs) if step else pairs
        if confirmed.limit(1).count():
            linked, links, labels = labelled(confirmed if links is None else links.unionByName(confirmed))
    if linked is None:
        linked = own.select(F.col("rep").alias("id"), F.col("rep").alias("label")).limit(0)
    return own.join(linked.withColumnRenamed("id", "rep"), "rep", "left") \
        .select("id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "id").alias("component_id")) \
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id"))) \
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, that with the smallest id, all columns as they are, whatever their names.

    Rows with a null id stay, and so do null and empty texts and all rows that repeat a kept id; an empty table
    gives an empty result. Options as in ``near_duplicates``."""
    key = unused(docs.columns, "_id")[0]
    found = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col("id").alias(key)).distinct()
    found = stage_table(found, "near-dup-dropped")
    return docs.join(if_small(found), col(id_col) == F.col(key), "left_anti")
