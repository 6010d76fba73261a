"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (one to three characters,
within words) by falling frequency. A document is given the language whose
profile has the least out-of-place distance to its own: for each n-gram of
the document the difference of its ranks, or the profile length if the
language's profile does not have it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmail.llm.common import python_ready

#: Length of a profile.
RANKS = 400
#: Labelled documents per language on which profiles are fitted, about (chosen by a hash of the id).
FIT_DOCS = 2000
#: Languages that a label column may have.
MOST_LANGUAGES = 1000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of a text's words, lower-cased, with a blank on either side
    of a word; codes ascend and hold 21 bits per character. Empty without letters."""
    point = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = letters()[point]
    if not is_letter.any():
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    point = np.concatenate([[32], np.where(is_letter, point, 32), [32]]).astype(np.uint64)
    point = point[np.concatenate([[True], (point[1:] != 32) | (point[:-1] != 32)])]
    inner = point != 32
    two = (point[:-1] << np.uint64(21)) | point[1:]
    three = (two[:-1] << np.uint64(21)) | point[2:]
    codes = np.concatenate([point[inner], two, three[inner[1:-1]]])
    return np.unique(codes, return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The codes of the highest counts in falling order; smaller codes first among equals."""
    return codes[np.argsort(-counts, kind="stable")[:ranks]]


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_profiles(docs: DataFrame, text_col: str, lang_col: str, ranks: int = RANKS, fit_docs: int = FIT_DOCS,
                 id_col: str = "doc_id") -> list[tuple[str, list[int]]]:
    """(language, codes by rank) of each value of ``lang_col``, languages in order.

    About ``fit_docs`` documents of each language are read, picked by a hash of
    the id. ``ranks`` codes per language come to the driver.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = labelled.groupBy(F.col(lang_col).alias("lang")).count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang_col}")
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, fit_docs / r["count"]))])
    picked = labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(2**30)) < share[F.col(lang_col)] * 2**30)

    def count(batches):
        for batch in batches:
            lang, code, n = [], [], []
            for one, text in zip(*(c.to_pylist() for c in batch.columns)):
                codes, counts = ngrams(text)
                lang += [one] * len(codes)
                code.append(codes)
                n.append(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(lang, pa.string()), pa.array(np.concatenate([*code, np.empty(0, np.uint64)]).view(np.int64)),
                pa.array(np.concatenate([*n, np.empty(0, np.int64)]))], names=["lang", "code", "n"])

    python_ready(docs.sparkSession)
    counted = picked.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")) \
        .mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))) \
        .where(F.col("rank") <= ranks).collect()
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in best:
        profiles.setdefault(r.lang, []).append((r["rank"], r.code))
    return [(lang, [code for _, code in sorted(rows)]) for lang, rows in sorted(profiles.items())]


class Classifier:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: list[tuple[str, list[int]]], ranks: int):
        self.names, self.ranks = [p[0] for p in profiles], ranks
        self.codes = np.unique(np.array([c for _, codes in profiles for c in codes], dtype=np.int64).view(np.uint64))
        self.place = np.full((len(self.codes) + 1, len(profiles)), -1, dtype=np.int64)
        for i, (_, codes) in enumerate(profiles):
            self.place[np.searchsorted(self.codes, np.array(codes, dtype=np.int64).view(np.uint64)), i] = np.arange(len(codes))

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngrams(text or "")
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.ranks)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        place = self.place[np.where(self.codes[at] == own, at, len(self.codes))]
        distance = np.where(place < 0, self.ranks, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        return self.names[best], max(0.0, 1.0 - float(distance[best]) / (self.ranks * len(own)))


def identify(docs: DataFrame, profiles: list[tuple[str, list[int]]], id_col: str = "doc_id", text_col: str = "text",
             ranks: int = RANKS) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of ``docs``, from the text alone.

    ``score`` is 1 minus the distance to the chosen profile as a share of the
    greatest possible one. A text that is null or has no letter gets ``und``
    and 0, and so does every text if there are no profiles. Ties go to the
    language first in order. Repeated rows and null ids stay; an empty table
    gives an empty result; other columns are not read.
    """
    def run(batches):
        classify = Classifier(profiles, ranks)
        for batch in batches:
            found = [classify(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())],
                                             names=["id", "held_out", "lang_pred", "score"])

    python_ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")) \
        .mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: list[tuple[str, list[int]]], text_col: str = "text", ranks: int = RANKS) -> DataFrame:
    """The rows of ``docs`` whose text has a language, i.e. is not ``und``; all columns as they are.
    Without profiles no language can be told, and only texts without a letter are left out."""
    at = docs.columns.index(text_col)

    def run(batches):
        classify = Classifier(profiles, ranks)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            known = [classify(t)[0] != UNKNOWN if profiles else len(ngrams(t or "")[0]) > 0 for t in texts]
            yield batch.filter(pa.array(known, pa.bool_()))

    python_ready(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
