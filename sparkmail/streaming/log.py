"""A segmented log: a source with replay and bounded batches that needs no broker.

The log is a folder of segments, each written once by a Spark job and then made visible by one
rename: ``segment=N/partition=P/part-*.parquet`` with columns key, value, timestamp. A
record's place is its file and the row in it; files of a partition follow each other by name.

``SegmentLog`` is a Python data source for ``readStream``. An offset holds, for each partition, the file and
row up to which it is read. A batch takes all there is while the lag is small; beyond ``max_lag`` records
it takes that many, dealt over the partitions by their lags, so a backlog of any size is worked off
in batches of bounded size. A stream starts at the earliest record, at the latest, or at a given offset.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sparkmail.session import ensure_shipped, scratch_path

#: Lag from which on batches are bounded, and their records then.
MAX_LAG = 10_000
#: Records that one task reads at most.
SLICE = 100_000
SCHEMA = "partition int, segment string, row long, key string, value string, timestamp timestamp"
FILE = re.compile(r"(segment=\d+)/partition=(\d+)/(part-[^/]+\.parquet)$")


# --- writing ----------------------------------------------------------------------------------

def append_segment(df: DataFrame, root: str, key: str = "key", value: str = "value", timestamp: str = "timestamp",
                   partitions: int = 4, rows_per_file: int = 1_000_000) -> str:
    """Adds the rows of ``df`` as the log's next segment and returns its name.

    Rows go to a partition by their key (null keys to one partition) and lie there in the order of
    ``timestamp`` and key; files have ``rows_per_file`` records at most. The segment is written aside and renamed at
    last, so a reader sees all of it or nothing. One writer at a time: a second one that takes the same number fails.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"),
                     F.col(timestamp).cast("timestamp").alias("timestamp")) \
        .withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    aside = scratch_path(spark, "segment")
    rows.repartition(partitions, "partition").sortWithinPartitions("partition", "timestamp", "key") \
        .write.option("maxRecordsPerFile", rows_per_file).partitionBy("partition").parquet(aside)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(root)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    numbers = [int(n.split("=")[1]) for n in names if n.startswith("segment=")]
    name = f"segment={max(numbers, default=0) + 1:012d}"
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")):
        raise RuntimeError(f"{root}/{name}: not written, or there already")
    return name


# --- the files of a log -------------------------------------------------------------------------

class Segments:
    """The files of a log and their sizes; looks at each file's footer once."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        self.root = self.root.rstrip("/")
        self.sizes: dict[str, int] = {}

    def files(self, since: str = "") -> dict[int, list[str]]:
        """partition -> its files (paths below the root) in order, of segments from ``since`` on."""
        from pyarrow import fs

        out: dict[int, list[str]] = {}
        tops = self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        for top in sorted(i.path for i in tops if i.base_name.startswith("segment=") and i.base_name >= since):
            for info in self.fs.get_file_info(fs.FileSelector(top, recursive=True)):
                found = FILE.search(info.path)
                if found:
                    out.setdefault(int(found[2]), []).append(found[0])
        return {p: sorted(names) for p, names in sorted(out.items())}

    def open(self, name: str):
        import pyarrow.parquet as pq

        return pq.ParquetFile(self.fs.open_input_file(f"{self.root}/{name}"))

    def rows(self, name: str) -> int:
        if name not in self.sizes:
            with self.open(name) as f:
                self.sizes[name] = f.metadata.num_rows
        return self.sizes[name]

    def ahead(self, offset: dict) -> dict[int, list[tuple[str, int, int]]]:
        """partition -> (file, from row, to row) of what lies after ``offset``."""
        # The oldest segment that any known partition still reads; a partition that is not known yet is in newer ones or all unread.
        known = [place["file"].split("/")[0] for place in offset.values() if place["file"]]
        since = min(known) if known and len(known) == len(offset) else ""
        out: dict[int, list[tuple[str, int, int]]] = {}
        for p, names in self.files(since).items():
            place = offset.get(str(p), {"file": "", "row": 0})
            for name in names:
                if name < place["file"]:
                    continue
                first = place["row"] if name == place["file"] else 0
                if first < self.rows(name):
                    out.setdefault(p, []).append((name, first, self.rows(name)))
        return out

    def end(self) -> dict:
        """The offset behind the last record."""
        return {str(p): {"file": names[-1], "row": self.rows(names[-1])} for p, names in self.files().items()}


def lag(ahead: dict[int, list[tuple[str, int, int]]]) -> int:
    return sum(b - a for slices in ahead.values() for _, a, b in slices)


def advance(offset: dict, ahead: dict[int, list[tuple[str, int, int]]], most: int) -> dict:
    """``offset`` moved by all that lies ahead, or by ``most`` records if that is more, shared by the partitions' lags."""
    total = lag(ahead)
    out = dict(offset)
    given = seen = 0
    for p, slices in sorted(ahead.items()):
        own = sum(b - a for _, a, b in slices)
        seen += own
        # Shares are rounded so that they add up to ``most``.
        take = own if total <= most else most * seen // total - given
        given += take
        for name, a, b in slices:
            if take <= 0:
                break
            step = min(take, b - a)
            out[str(p)] = {"file": name, "row": a + step}
            take -= step
    return out


def between(segments: Segments, start: dict, end: dict) -> list[tuple[int, str, int, int]]:
    """(partition, file, from row, to row) of the records after ``start`` up to ``end``, in pieces of SLICE at most."""
    out = []
    for p, slices in segments.ahead(start).items():
        last = end.get(str(p))
        for name, a, b in slices:
            if last is None or name > last["file"]:
                break
            b = min(b, last["row"]) if name == last["file"] else b
            out += [(p, name, at, min(at + SLICE, b)) for at in range(a, b, SLICE)]
    return out


# --- the data source ------------------------------------------------------------------------------

class LogSlice(InputPartition):
    def __init__(self, partition: int, name: str, first: int, end: int):
        self.partition, self.name, self.first, self.end = partition, name, first, end


class SegmentReader(DataSourceStreamReader):
    """Offsets of a log for one streaming query.

    Spark asks for the latest offset without telling the query's own one. So the end of each planned batch is
    kept, also in the file ``position`` of the query, from which a restarted query goes on.
    """

    def __init__(self, options: dict):
        self.segments = Segments(options["path"])
        self.starting = options.get("startingoffsets", "earliest")
        self.max_lag = int(options.get("maxlag", MAX_LAG))
        self.position = options.get("position")
        self.now: dict | None = self._stored()

    def _stored(self) -> dict | None:
        from pyarrow import fs

        if not self.position:
            return None
        store, path = fs.FileSystem.from_uri(self.position) if "://" in self.position or self.position.startswith("file:") \
            else (fs.LocalFileSystem(), self.position)
        self.store = store, path
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with store.open_input_file(path) as f:
            return json.loads(f.readall())

    def _keep(self, offset: dict) -> None:
        self.now = offset
        if self.position:
            store, path = self.store
            if "/" in path:
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(offset).encode())
            store.move(f"{path}.new", path)

    def initialOffset(self) -> dict:  # noqa: N802 - the API's name
        if self.starting == "earliest":
            return {}
        return self.segments.end() if self.starting == "latest" else json.loads(self.starting)

    def latestOffset(self) -> dict:  # noqa: N802
        if self.now is None:
            self._keep(self.initialOffset())
        ahead = self.segments.ahead(self.now)
        return advance(self.now, ahead, self.max_lag)

    def partitions(self, start: dict, end: dict):
        self._keep(end)
        return [LogSlice(*x) for x in between(self.segments, start, end)]

    def read(self, partition: LogSlice):
        import pyarrow as pa

        names = ["partition", "segment", "row", "key", "value", "timestamp"]
        with self.segments.open(partition.name) as f:
            at = 0
            for group in range(f.num_row_groups):
                rows = f.metadata.row_group(group).num_rows
                if at + rows > partition.first and at < partition.end:
                    here = at
                    for batch in f.iter_batches(row_groups=[group], columns=["key", "value", "timestamp"], batch_size=8192):
                        a, b = max(partition.first - here, 0), min(partition.end - here, len(batch))
                        if a < b:
                            part, n = batch.slice(a, b - a), b - a
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([partition.partition] * n, pa.int32()), pa.array([partition.name] * n),
                                 pa.array(range(here + a, here + b), pa.int64()), part.column("key"), part.column("value"),
                                 part.column("timestamp").cast(pa.timestamp("us", "UTC"))], names=names)
                        here += len(batch)
                at += rows

    def commit(self, end: dict) -> None:
        """Nothing to release: segments stay, so that others can replay them."""


class SegmentLog(DataSource):
    """``readStream.format("segment_log")`` with options path, startingOffsets (earliest, latest or an offset as JSON),
    maxLag and position (a file for the query's own offset, in a shared folder)."""

    @classmethod
    def name(cls) -> str:
        return "segment_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SegmentReader:  # noqa: N802
        return SegmentReader({k.lower(): v for k, v in self.options.items()})


def log_source(spark: SparkSession, root: str, checkpoint: str, starting: str | dict = "earliest", max_lag: int = MAX_LAG) -> DataFrame:
    """The log as a stream of (partition, segment, row, key, value, timestamp).

    ``checkpoint`` is the folder of the query that reads it: a restarted query goes on where its last planned batch
    ended. ``starting``: earliest, latest, or an offset such as ``log_end`` gives. An empty or missing log gives
    no rows until a segment is appended.
    """
    ensure_shipped(spark)
    spark.dataSource.register(SegmentLog)
    start = json.dumps(starting) if isinstance(starting, dict) else starting
    return spark.readStream.format("segment_log").option("path", root).option("startingOffsets", start) \
        .option("maxLag", str(max_lag)).option("position", f"{checkpoint.rstrip('/')}/log-position.json").load()


def log_end(root: str) -> dict:
    """The offset behind the log's last record, to start a replay from."""
    return Segments(root).end()
