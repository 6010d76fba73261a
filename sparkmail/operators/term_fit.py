"""Logistic regression over the terms of texts, with one number a row in the driver (M8).

The objective is that of ``regression.fit_logistic``, mean log-loss plus half the penalty times the squared weights, in the
TF-IDF rows of M9. At every step the weights are X'a, the rows' vectors summed with one number ``a`` a row and class: they start
at 0 and every gradient is such a sum. So the search moves ``a`` and the margins Xw, a few numbers a row, and no vector of
one number a term is ever sent or gathered. A pass gives XX'v for a ``v``: the (row, term, count) pairs lie in blocks of whole
terms, and a task adds up its terms' share of all margins. Newton's steps, each by conjugate gradients, need one pass a gradient and
one a direction; the line search needs none. The weights themselves are made once, at the end, as rows of a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmail.operators.ml import SEPARATOR_PATTERN
from sparkmail.operators.ranks import col
from sparkmail.session import ensure_shipped, stage_table

#: Bytes of text whose terms one task counts, and packs, about; pairs of a block, unless one term has more; rows of a slice of the margins.
TASK_TEXT, BLOCK_PAIRS, SLICE = 16 << 20, 1 << 21, 1 << 16
#: Rows of a table of weights that a task hands on at once.
BATCH = 1 << 16
#: What a Newton step may leave of the gradient. A halved step is given up below ``SHORTEST``; steps are taken that lower the
#: objective by ``SUFFICIENT`` of what the slope promises.
NEAR, SHORTEST, SUFFICIENT = 0.1, 1e-10, 1e-4
BLOCK = "terms array<string>, kind string, starts binary, rows binary, counts binary"


def number_rows(df: DataFrame, row: str = "row") -> DataFrame:
    """``df``, written once, with ``row``: numbers from 0 without gaps, in no particular order."""
    at, part, before, n = "_at", "_part", "_before", "_n"
    kept = stage_table(df.withColumn(at, F.monotonically_increasing_id()), "numbered")
    # The number of a row is (partition << 33) + place. One row per partition.
    counts = kept.groupBy(F.shiftright(at, 33).alias(part)).agg(F.count(F.lit(1)).alias(n))
    own = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage_table(counts.select(part, F.coalesce(F.sum(n).over(own), F.lit(0)).alias(before)), "row-offsets")
    placed = kept.join(F.broadcast(offsets), F.shiftright(at, 33) == F.col(part))
    return placed.withColumn(row, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, before)


def tasks_for(rows: DataFrame, text: str) -> int:
    size = rows.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_TEXT))


def term_counts(rows: DataFrame, row: str, text: str, tasks: int) -> DataFrame:
    """(row, term, n): the terms of each text and how often it has them (null: none). The text is moved, and counted where it is."""
    given = rows.select(col(row).alias("row"), col(text).alias("text")).repartition(tasks, "row")
    # As in ``ml.tfidf``: the runs between separators are those of TOKEN_PATTERN.
    words = given.select("row", F.explode(F.split(F.lower("text"), SEPARATOR_PATTERN)).alias("term")).where(F.length("term") >= 2)
    return words.groupBy("row", "term").agg(F.count(F.lit(1)).cast("int").alias("n"))


def term_blocks(rows: DataFrame, row: str = "row", text: str = "text", pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The terms of the texts in blocks, written once: whole terms with the rows that have them and how often.

    The counts are moved by term, and a task packs what it has. A term's pairs, as many as there are rows at most, lie in one
    block."""
    tasks = tasks_for(rows, text)
    counted = term_counts(rows.withColumn(row, col(row).cast("int")), row, text, tasks)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        own = pa.Table.from_batches(own)
        coded = own.column("term").combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code))
        at, n = (own.column(c).to_numpy()[order] for c in ("row", "n"))
        del own, code, order
        # Terms before each cut; a block has ``pairs`` pairs, or one term.
        first, begin = 0, 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, begin + pairs, "right")))
            end = int(ends[last - 1])
            starts = np.concatenate([[begin], ends[first:last - 1]]) - begin
            counts = n[begin:end]
            arrays = [starts.astype(np.int64), at[begin:end], counts.astype(np.min_scalar_type(int(counts.max())))]
            names = pa.concat_arrays([coded.dictionary.slice(first, last - first)])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), names), pa.array([arrays[2].dtype.str]),
                                              *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names=["terms", "kind", "starts", "rows", "counts"])
            first, begin = last, end

    return stage_table(counted.repartition(tasks, "term").mapInArrow(packed, BLOCK), "term-blocks")


@dataclass
class Terms:
    """A block: its terms' pairs one after another, ``starts`` the first of each term."""

    starts: np.ndarray
    rows: np.ndarray
    counts: np.ndarray

    @classmethod
    def read(cls, r) -> Terms:
        return cls(np.frombuffer(r["starts"], np.int64), np.frombuffer(r["rows"], np.int32), np.frombuffer(r["counts"], np.dtype(r["kind"])))

    def idf(self, n: int) -> np.ndarray:
        df = np.diff(np.append(self.starts, len(self.rows)))
        return np.log((1.0 + n) / (1.0 + df)) + 1.0

    def weights(self, v: np.ndarray, n: int) -> np.ndarray:
        """Terms by columns of ``v``: each term's values in all rows, summed with the rows' numbers."""
        idf = self.idf(n)
        return np.stack([np.add.reduceat(self.counts * np.ascontiguousarray(x).take(self.rows), self.starts) * idf for x in v.T], 1)

    def squares(self, n: int) -> np.ndarray:
        x = self.counts * np.repeat(self.idf(n), np.diff(np.append(self.starts, len(self.rows))))
        return np.bincount(self.rows, x * x, n)[:, None]

    def margins(self, v: np.ndarray, n: int) -> np.ndarray:
        """The terms' share of XX'v, for rows that are not yet divided by their norms."""
        idf, many, out = self.idf(n), np.diff(np.append(self.starts, len(self.rows))), np.empty((n, v.shape[1]))
        for c, w in enumerate(self.weights(v, n).T):
            out[:, c] = np.bincount(self.rows, self.counts * np.repeat(w * idf, many), n)
        return out


class Rows:
    """XX' of ``n`` TF-IDF rows, by passes over their blocks. To be closed."""

    def __init__(self, table: DataFrame, n: int):
        self.spark, self.table, self.n, self.passes = table.sparkSession, table, n, 0
        ensure_shipped(self.spark)
        given = table.select("kind", "starts", "rows", "counts").rdd
        # Each task adds up its blocks: as many vectors of a pass are added up as tasks run at once.
        tasks = max(1, min(given.getNumPartitions(), self.spark.sparkContext.defaultParallelism))
        self.blocks = given.coalesce(tasks).map(Terms.read).persist(StorageLevel.MEMORY_AND_DISK)
        squares = self._added(lambda b, _: b.squares(n), np.zeros((n, 1)))
        # A row without terms has the vector 0.
        self.scale = np.where(squares > 0, 1.0 / np.sqrt(np.where(squares > 0, squares, 1.0)), 0.0)

    def _added(self, share: Callable[[Terms, np.ndarray], np.ndarray], v: np.ndarray) -> np.ndarray:
        sc, n, sent = self.spark.sparkContext, self.n, self.spark.sparkContext.broadcast(v)

        def parts(own):
            total = None
            for b in own:
                x = share(b, sent.value)
                total = x if total is None else np.add(total, x, out=total)
            return [] if total is None else [(at, total[at:at + SLICE]) for at in range(0, n, SLICE)]

        out = np.zeros((n, v.shape[1]))
        slices = self.blocks.mapPartitions(parts).reduceByKey(np.add, max(1, min(sc.defaultParallelism, -(-n // SLICE))))
        for at, x in slices.collect():
            out[at:at + SLICE] = x
        sent.destroy()
        # Else the shuffled sums of every pass stay on disk until the driver happens to collect its garbage.
        slices._jrdd.rdd().cleanShuffleDependencies(False)
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        """XX'v, one pass."""
        n = self.n
        self.passes += 1
        return self.scale * self._added(lambda b, w: b.margins(w, n), self.scale * v)

    def weights(self, v: np.ndarray) -> DataFrame:
        """(term, df, idf, coefs): X'v as a table, a weight a column of ``v``."""
        n, sent = self.n, self.spark.sparkContext.broadcast(self.scale * v)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    b = Terms.read({k: batch.column(k)[r].as_py() for k in ("kind", "starts", "rows", "counts")})
                    names, df, idf, w = batch.column("terms")[r].values, np.diff(np.append(b.starts, len(b.rows))), b.idf(n), b.weights(sent.value, n)
                    for at in range(0, len(df), BATCH):
                        own = w[at:at + BATCH]
                        ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1])
                        yield pa.RecordBatch.from_arrays(
                            [names.slice(at, len(own)), pa.array(df[at:at + BATCH]), pa.array(idf[at:at + BATCH]), pa.ListArray.from_arrays(ends, pa.array(own.ravel()))],
                            names=["term", "df", "idf", "coefs"])

        return self.table.mapInArrow(rows, "term string, df long, idf double, coefs array<double>")

    def close(self) -> None:
        self.blocks.unpersist()


def _chances(z: np.ndarray) -> np.ndarray:
    if z.shape[1] == 1:
        e = np.exp(-np.abs(z))
        return np.where(z >= 0, 1.0, e) / (1.0 + e)
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _loss(z: np.ndarray, labels: np.ndarray) -> float:
    if z.shape[1] == 1:
        return float(np.mean(np.logaddexp(0.0, z[:, 0]) - labels * z[:, 0]))
    most = z.max(1, keepdims=True)
    return float(np.mean(np.log(np.exp(z - most).sum(1)) + most[:, 0] - z[np.arange(len(z)), labels]))


@dataclass
class Sum:
    """A point or direction: weights X'``a``, their margins ``z``, intercepts ``b``."""

    a: np.ndarray
    z: np.ndarray
    b: np.ndarray

    def dot(self, other: Sum) -> float:
        return float(np.vdot(self.a, other.z) + self.b @ other.b)

    def add(self, t: float, other: Sum) -> None:
        self.a += t * other.a
        self.z += t * other.z
        self.b += t * other.b


def fit_rows(times: Callable[[np.ndarray], np.ndarray], labels: np.ndarray, classes: int, penalty: float, steps: int = 1000,
             tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, intercepts, margins without them) at the minimum over rows whose XX'v ``times`` gives; ``labels`` below ``classes``, two or more.

    A column for two classes (of the second) and one a class for more, where intercepts add up to 0. Each Newton step is searched
    until ``NEAR`` of the gradient is left, so that the next one improves the objective by less than ``NEAR`` of what this one did; it
    ends when that is less than ``tolerance`` of the objective, or after ``steps`` passes."""
    n, columns = len(labels), 1 if classes == 2 else classes
    counts = np.bincount(labels, minlength=classes)
    shares = np.log(np.maximum(counts, 0.5) / n)
    at = Sum(np.zeros((n, columns)), np.zeros((n, columns)), np.array([shares[1] - shares[0]]) if classes == 2 else shares - shares.mean())
    value, left = _loss(at.z + at.b, labels), steps
    while left > 0:
        p = _chances(at.z + at.b)
        rest = p.copy()
        if columns == 1:
            rest[:, 0] -= labels
        else:
            rest[np.arange(n), labels] -= 1.0
        rest /= n
        down = Sum(-rest - penalty * at.a, -times(rest) - penalty * at.z, -rest.sum(0))
        left -= 1
        size = down.dot(down)
        if not size > 0:
            break
        slope, step, left = _newton(times, p, down, size, penalty, left)
        ww, wd, dd = (float(np.vdot(x.a, y.z)) for x, y in ((at, at), (at, step), (step, step)))
        t = 1.0
        while True:
            trial = _loss(at.z + t * step.z + at.b + t * step.b, labels) + penalty / 2 * (ww + 2 * t * wd + t * t * dd)
            if trial <= value + SUFFICIENT * t * slope or t < SHORTEST:
                break
            t /= 2
        if not trial < value:
            break
        at.add(t, step)
        small, value = NEAR * (value - trial) <= tolerance * max(abs(trial), 1e-12), trial
        if small:
            break
    return at.a, at.b if classes == 2 else at.b - at.b.mean(), at.z


def _newton(times, p: np.ndarray, down: Sum, size: float, penalty: float, left: int) -> tuple[float, Sum, int]:
    """Conjugate gradients from 0 to where ``NEAR`` of the gradient is left: slope, direction, passes left."""
    n = len(p)
    found = Sum(np.zeros_like(down.a), np.zeros_like(down.z), np.zeros_like(down.b))
    rest, along, now = Sum(down.a.copy(), down.z.copy(), down.b.copy()), Sum(down.a.copy(), down.z.copy(), down.b.copy()), size
    while left > 0:
        v = along.z + along.b
        bent = p * (1.0 - p) * v if p.shape[1] == 1 else p * (v - (p * v).sum(1, keepdims=True))
        bent /= n
        turned = Sum(bent + penalty * along.a, times(bent) + penalty * along.z, bent.sum(0))
        left -= 1
        curve = along.dot(turned)
        if not curve > 0:
            break
        t = now / curve
        found.add(t, along)
        rest.add(-t, turned)
        was, now = now, rest.dot(rest)
        if not now > NEAR * NEAR * size:
            break
        along = Sum(rest.a + now / was * along.a, rest.z + now / was * along.z, rest.b + now / was * along.b)
    return -down.dot(found), found, left
