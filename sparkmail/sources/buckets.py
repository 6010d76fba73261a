"""Tables in buckets by key, of which a change rewrites or opens only the buckets it touches.

A table is a folder of bucket folders and of numbered manifests. A manifest lists, for each bucket, the folders that make
it up; the highest one is the table. A merge reads the buckets of the changed keys, writes these anew beside the old ones
and publishes the next manifest, so all other files keep their names, readers never see half a change, and a
failed or repeated write leaves the table as it was. Files are sorted by key, so that a reader skips row groups.

The number of buckets is fixed when the table is made; choose it so that a bucket (rows / buckets) fits a task. Rows are
dealt by a hash of the key, so a bucket grows with the number of keys and no key may hold more than a bucket's rows:
keys are unique in these tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkmail.operators.ranks import col, unused

#: Folders of a bucket from which on an append puts them together.
MOST_FOLDERS = 8
#: Tags of merges that a manifest keeps, so that a repeated one is known.
TAGS = 1000
MANIFEST = "manifest-"


class BucketTable:
    """A table of unique ``keys``. Jobs run when methods are called; one writer at a time (a second one fails)."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), list(keys), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests ---

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[len(MANIFEST):-5]) for n in names if n.startswith(MANIFEST) and n.endswith(".json"))

    def manifest(self, number: int | None = None) -> dict:
        """The newest manifest, or that of an earlier ``number``: number, schema, buckets (bucket -> folders) and done (tags of appends)."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "schema": None, "buckets": {}, "done": {}}
        path = self._path(f"{self.root}/{MANIFEST}{number if number is not None else numbers[-1]:010d}.json")
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, old: dict, **changes) -> dict:
        new = old | changes | {"number": old["number"] + 1}
        aside = self._path(f"{self.root}/.{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        target = self._path(f"{self.root}/{MANIFEST}{new['number']:010d}.json")
        # A rename onto a file that is there fails: of two writers the second one does.
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise RuntimeError(f"{target.toString()}: published by another writer")
        return new

    # --- reading ---

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame) -> list[int]:
        """The buckets of the keys of ``df``: ``buckets`` numbers at most."""
        return sorted(r[0] for r in df.select(self.bucket()).distinct().collect())

    def _open(self, manifest: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, buckets: list[int] | None = None, number: int | None = None) -> DataFrame:
        """The rows of all buckets, or of some; as of an earlier manifest if ``number`` is given."""
        m = self.manifest(number)
        if m["schema"] is None:
            raise FileNotFoundError(f"{self.root}: no table")
        wanted = m["buckets"] if buckets is None else {str(b): m["buckets"].get(str(b), []) for b in buckets}
        return self._open(m, [f for folders in wanted.values() for f in folders])

    # --- writing ---

    def _write(self, df: DataFrame, folder: str) -> dict[str, str]:
        """Writes the rows by bucket and returns the folder of each bucket that has some."""
        own = unused(df.columns, "_bucket")[0]
        rows = df.withColumn(own, self.bucket())
        rows.repartition(self.buckets, own).sortWithinPartitions(own, *[col(k) for k in self.keys]) \
            .write.mode("overwrite").partitionBy(own).parquet(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if "=" in n}

    def create(self, df: DataFrame) -> dict:
        """Makes the table of the rows of ``df`` (also an empty one); fails if there is one."""
        old = self.manifest()
        if old["number"]:
            raise FileExistsError(f"{self.root}: there already")
        made = self._write(df, f"data-{uuid.uuid4().hex[:12]}")
        return self._publish(old, schema=df.schema.json(), buckets={b: [f] for b, f in made.items()})

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], tag: str | None = None) -> list[int]:
        """Replaces the touched buckets by ``apply(their rows, changes)`` and returns their numbers. ``apply`` must give rows
        with the table's columns and keys of these buckets only. ``changes`` is read twice; without any the table stays as it is.
        A merge repeated with the ``tag`` of one of the last ``TAGS`` merges changes nothing."""
        old = self.manifest()
        if tag is not None and tag in old["done"]:
            return []
        touched = self.touched(changes)
        if not touched:
            return []
        rows = self._open(old, [f for b in touched for f in old["buckets"].get(str(b), [])])
        names = StructType.fromJson(json.loads(old["schema"])).names
        made = self._write(apply(rows, changes).select(*[col(c) for c in names]), f"data-{uuid.uuid4().hex[:12]}")
        strange = set(map(int, made)) - set(touched)
        if strange:
            raise ValueError(f"rows of buckets {sorted(strange)}, which no change touched")
        kept = {b: f for b, f in old["buckets"].items() if int(b) not in touched}
        done = old["done"] if tag is None else dict(list(old["done"].items())[1 - TAGS:]) | {tag: ""}
        self._publish(old, buckets=kept | {b: [f] for b, f in made.items()}, done=done)
        return touched

    def append_unseen(self, rows: DataFrame, tag: str, most_folders: int = MOST_FOLDERS) -> DataFrame:
        """Adds the ``rows`` whose key is not there and returns them. Only their buckets' files are opened.

        ``rows`` must have unique keys; a null key is always new. ``tag`` names the append: one repeated with the same tag (a micro-batch that is
        run again) adds nothing and returns what it added before. A bucket of more than ``most_folders`` appends is put together."""
        old = self.manifest()
        if tag in old["done"]:
            return self._open(old, [old["done"][tag]] if old["done"][tag] else [])
        touched = self.touched(rows)
        seen = self._open(old, [f for b in touched for f in old["buckets"].get(str(b), [])])
        names = StructType.fromJson(json.loads(old["schema"])).names
        fresh = rows.select(*[col(c) for c in names]).join(seen.select(*[col(k) for k in self.keys]), self.keys, "left_anti") \
            .select(*[col(c) for c in names])
        folder = f"tag-{tag}-{uuid.uuid4().hex[:8]}"
        made = self._write(fresh, folder)
        new = dict(old["buckets"])
        full = [b for b in made if len(new.get(b, [])) + 1 > most_folders]
        for b, f in made.items():
            new[b] = [*new.get(b, []), f]
        if full:
            whole = self._write(self._open(old, [f for b in full for f in new[b]]), f"data-{uuid.uuid4().hex[:12]}")
            new |= {b: [f] for b, f in whole.items()}
        # Of the tags only the last are needed: a stream repeats its latest batch.
        done = dict(list(old["done"].items())[-1:]) | {tag: folder if made else ""}
        self._publish(old, buckets=new, done=done)
        return self._open(old, list(made.values()))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the manifests but the newest ``keep``, and the folders that none of these lists; returns the folders deleted."""
        numbers = self._numbers()
        kept = numbers[-keep:]
        used = set()
        for n in kept:
            m = self.manifest(n)
            used |= {f for folders in m["buckets"].values() for f in folders} | {f for f in m["done"].values() if f}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{MANIFEST}{n:010d}.json"), False)
        gone = 0
        for top in self._fs.listStatus(self._path(self.root)):
            name = top.getPath().getName()
            if not name.startswith(("data-", "tag-")) or name in used:
                continue
            for part in self._fs.listStatus(top.getPath()):
                if "=" in part.getPath().getName() and f"{name}/{part.getPath().getName()}" not in used:
                    self._fs.delete(part.getPath(), True)
                    gone += 1
        return gone
