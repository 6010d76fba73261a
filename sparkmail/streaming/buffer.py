"""Batches by size or by age on a stream.

Records gather in keyed state, one buffer per key (mailbox, partition, shard ...). A buffer is emitted whole when it holds
``size`` records or when its oldest one has waited ``seconds``, whichever comes first; what is emitted
leaves the state. A trigger interval alone can do neither: it cuts by arrival, so that quiet keys give tiny batches and
busy ones batches of any size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkmail.session import ensure_shipped

#: The consumer's limits: records of a batch, seconds that a record waits at most.
SIZE, SECONDS = 500, 300
FULL, DUE = "size", "age"


class Flush(StatefulProcessor):
    """The buffer of one key: ``rows`` (list state), how many there are, the batches emitted so far and the timer that runs."""

    def __init__(self, record: StructType, out: list[str], size: int, seconds: float):
        self.record, self.names, self.size, self.wait = record, out, size, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.record)
        self.facts = handle.getValueState("facts", StructType([
            StructField("held", LongType()), StructField("batches", LongType()), StructField("timer", LongType())]))

    def _facts(self) -> list[int]:
        return list(self.facts.get()) if self.facts.exists() else [0, 0, 0]

    def _out(self, key, batch: int, cause: str, rows: list) -> Iterator[Row]:
        made = Row(*self.names)
        for r in rows:
            yield made(*key, batch, cause, len(rows), *r)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802 - the API's name
        held, batches, timer = self._facts()
        kept = list(self.rows.get()) if held else []
        held_before = len(kept)
        for r in rows:
            kept.append(tuple(r))
            if len(kept) == self.size:
                yield from self._out(key, batches, FULL, kept)
                batches += 1
                kept = []
                held_before = -1  # the state holds rows that are out
        if held_before >= 0:
            self.rows.appendList(kept[held_before:])
        elif kept:
            self.rows.put(kept)
        else:
            self.rows.clear()
        # The timer belongs to the oldest record held: it stays unless that record is out.
        if timer and (held_before < 0 or not kept):
            self.handle.deleteTimer(timer)
            timer = 0
        if kept and not timer:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(timer)
        self.facts.update((len(kept), batches, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        held, batches, timer = self._facts()
        if not held or expiredTimerInfo.getExpiryTimeInMs() != timer:
            return  # the timer of a buffer that went out by size
        yield from self._out(key, batches, DUE, list(self.rows.get()))
        self.rows.clear()
        self.facts.update((0, batches + 1, 0))

    def close(self) -> None:
        pass


def flush_batches(sdf: DataFrame, keys: list[str], size: int = SIZE, seconds: float = SECONDS) -> DataFrame:
    """``sdf`` in batches of ``size`` records per key, or of what has waited ``seconds``.

    Adds ``batch_no`` (from 0 for each key), ``flush_cause`` (``size`` or ``age``) and ``batch_rows``; rows of a batch come out in one
    micro-batch. Each record is emitted exactly once with the query's checkpoint. The state of a key is below ``size``
    records; a hot key should be split by a shard among the ``keys``, since a key's records go through one task. Null
    keys are a key; columns named like the new ones raise ValueError. Needs the RocksDB state store (session settings).
    """
    added = ["batch_no", "flush_cause", "batch_rows"]
    clash = {c.lower() for c in sdf.columns} & set(added)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    if size < 1 or not keys:
        raise ValueError("a batch needs at least one record and one key column")
    ensure_shipped(sdf.sparkSession)
    # The driver's own Python worker, which sets the state up, does not see shipped packages.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    fields = {f.name: StructField(f.name, f.dataType) for f in sdf.schema.fields}
    rest = [c for c in sdf.columns if c not in keys]
    record = StructType([fields[c] for c in rest])
    out = StructType([*(fields[k] for k in keys), StructField("batch_no", LongType()), StructField("flush_cause", StringType()),
                      StructField("batch_rows", LongType()), *record.fields])

    class Narrow(Flush):
        """Keys come again with every row; only the other columns are kept."""

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802
            return super().handleInputRows(key, ([r[c] for c in rest] for r in rows), timerValues)

    found = sdf.groupBy(*keys).transformWithState(Narrow(record, out.names, size, seconds), out, "Append", "ProcessingTime")
    return found.select(*sdf.columns, *added)


def batch_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per emitted batch: key, number, cause, declared and counted records."""
    return df.groupBy(*keys, "batch_no", "flush_cause").agg(F.max("batch_rows").alias("declared"), F.count("*").alias("counted"))
