"""A Merkle manifest of a dataset, and the proofs of all its rows.

Each row is a leaf; the leaves of a group (source) form a tree with ``ARITY``
children a node, and the groups' roots, in order, another one. The manifest holds the
nodes of all trees and the root.

Rows are proved and checked by octopus multiproofs. Leaves lie in range partitions.
A partition needs, besides its own leaves, only nodes just left and right of what it can
derive itself: at each level the other members of the runs that it shares with its
neighbours. These coordinates (a few per level) are computed from the
partition's first and last leaf, fetched from the manifest once, by one join, and all other
interior nodes on the way to the root are derived in the partition, once for all its
leaves. Every row's own proof is then read off locally.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmail.llm.common import if_small
from sparkmail.operators.ranks import col, with_position
from sparkmail.session import ensure_shipped, stage_table

ARITY = 3
#: Levels that one task builds at once: a block has ARITY ** LEVELS leaves at most.
LEVELS = 7
#: Leaves of a range partition, on average.
PART_LEAVES = 1 << 15
#: The key of the tree of group roots; those of groups are empty (null) or start with "+".
TOP = "^"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def widths(n: int) -> list[int]:
    """Nodes of each level of a tree of n leaves, from the leaves to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def climb(start: int, nodes: list[str], n: int) -> list[str]:
    """The parents of the ``nodes`` at places ``start`` on (a multiple of ARITY; the last run may end at n)."""
    assert start % ARITY == 0
    return [sha("".join(nodes[i:i + ARITY])) for i in range(0, len(nodes), ARITY)] if n > 1 else nodes


def build_nodes(leaves: DataFrame) -> DataFrame:
    """(tree, level, idx, digest): the nodes above the ``leaves`` (tree, idx, n, digest), n being the tree's leaves.

    LEVELS levels a round: a block of ARITY ** LEVELS consecutive nodes is one row and one call, whatever the
    size of its tree, so a group with a third of the rows is spread over all tasks. The nodes go to the
    next round by table; there are a few rounds (log of the largest tree)."""
    def run(batches):
        for batch in batches:
            out = []
            for tree, level, block, n, nodes in zip(*(c.to_pylist() for c in batch.columns)):
                at = block * ARITY**LEVELS
                digests = [x["digest"] for x in nodes]
                for up in range(1, LEVELS + 1):
                    if n == 1:
                        break
                    digests, at, n = climb(at, digests, n), at // ARITY, -(-n // ARITY)
                    out += [(tree, level + up, at + i, n, d) for i, d in enumerate(digests)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["tree", "level", "idx", "n", "digest"])

    spark = leaves.sparkSession
    ensure_shipped(spark)
    made, now, level = None, leaves.where("n > 1"), 0
    while now.limit(1).count():
        blocks = now.groupBy("tree", F.floor(F.col("idx") / ARITY**LEVELS).alias("block")) \
            .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("nodes")) \
            .select("tree", F.lit(level).alias("level"), "block", "n", "nodes")
        built = stage_table(blocks.mapInArrow(run, "tree string, level int, idx long, n long, digest string"), "merkle-nodes")
        made = built if made is None else made.unionByName(built)
        level += LEVELS
        now = built.where((F.col("level") == level) & (F.col("n") > 1)).select("tree", "idx", "n", "digest")
    return made if made is not None else leaves.select("tree", F.lit(0).alias("level"), "idx", "n", "digest").limit(0)


@dataclass
class Manifest:
    """``leaves`` (id, tree, idx, part, leaf, claim), ``nodes`` (tree, level, idx, digest; the leaves of the group trees
    are not repeated there), ``groups`` (tree, n, place, subroot) and ``root`` (null for an empty dataset)."""
    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    root: str | None


def build_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source",
                   columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                   claim: dict[str, Column] | None = None, part_leaves: int = PART_LEAVES) -> Manifest:
    """The manifest of ``docs``: a leaf per row, of the ``columns``, in the order of ids within each value of ``group_col``.

    ``claim`` replaces columns in a second digest of each row, ``claim``: that of the row as somebody else
    has it, to be checked against the manifest. Rows with equal ids are ordered by their digests; null ids come
    first, null groups are one group, before all others. The texts are read once.
    """
    claim = claim or {}
    group = col(group_col).cast("string")
    leaves = docs.select(
        col(id_col).cast("long").alias("id"), F.when(group.isNull(), "").otherwise(F.concat(F.lit("+"), group)).alias("tree"),
        leaf_of(*[col(c) for c in columns]).alias("leaf"),
        leaf_of(*[claim.get(c, col(c)) for c in columns]).alias("claim")) \
        .withColumn("tie", F.monotonically_increasing_id())
    leaves = stage_table(leaves, "merkle-leaves")
    leaves = with_position(leaves, [F.col("id"), F.col("leaf"), F.col("tie")], ["tree"], "idx", part="part", part_rows=part_leaves).drop("tie")
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    leaves = stage_table(leaves, "merkle-placed")
    sizes = stage_table(sizes, "merkle-sizes")
    numbered = leaves.join(if_small(sizes), "tree").select("tree", "idx", "n", F.col("leaf").alias("digest"))
    nodes = build_nodes(numbered)
    tops = nodes.where("n = 1").select("tree", F.col("digest").alias("subroot")) \
        .unionByName(numbered.where("n = 1").select("tree", F.col("digest").alias("subroot")))
    groups = stage_table(with_position(stage_table(sizes.join(tops, "tree"), "merkle-tops"), [F.col("tree")], position="place"), "merkle-groups")
    n = groups.count()
    upper = groups.select(F.lit(TOP).alias("tree"), F.col("place").alias("idx"), F.lit(n).cast("long").alias("n"), F.col("subroot").alias("digest"))
    above = build_nodes(upper)
    root = (above.where("n = 1") if n > 1 else upper).select("digest").first()
    nodes = nodes.drop("n").unionByName(above.drop("n")) \
        .unionByName(upper.select("tree", F.lit(0).alias("level"), "idx", "digest"))
    return Manifest(leaves, nodes, groups, root[0] if root else None)


def missing(spans: DataFrame) -> DataFrame:
    """(part, tree, level, idx): the nodes that a partition cannot derive from its leaves ``first`` to ``last`` of a tree
    of n leaves (rows of part, tree, first, last, n): the least set that completes all runs on the way to the root."""
    def run(batches):
        for batch in batches:
            out = []
            for part, tree, first, last, n in zip(*(c.to_pylist() for c in batch.columns)):
                for level, width in enumerate(widths(n)[:-1]):
                    low, high = first // ARITY * ARITY, min(last // ARITY * ARITY + ARITY, width)
                    out += [(part, tree, level, i) for i in (*range(low, first), *range(last + 1, high))]
                    first, last = first // ARITY, last // ARITY
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.int32(), pa.string(), pa.int32(), pa.int64()))], names=["part", "tree", "level", "idx"])

    return spans.select("part", "tree", "first", "last", "n").mapInArrow(run, "part int, tree string, level int, idx long")


class Octopus:
    """The nodes of one tree that a partition knows: its own ``leaves`` from place ``first`` on, what was fetched, and what follows."""

    def __init__(self, first: int, leaves: list[str], n: int, fetched: dict[tuple[int, int], str]):
        self.levels: list[tuple[int, list[str]]] = []
        for level, width in enumerate(widths(n)[:-1]):
            last = first + len(leaves) - 1
            low, high = first // ARITY * ARITY, min(last // ARITY * ARITY + ARITY, width)
            whole = [*(fetched[level, i] for i in range(low, first)), *leaves, *(fetched[level, i] for i in range(last + 1, high))]
            self.levels.append((low, whole))
            leaves, first = climb(low, whole, width), low // ARITY
        self.root = leaves[0]
        # The siblings on the way from each node to the root, from the top down; shared by all below.
        self.paths: list[list[str]] = [[""]]
        for level in range(len(self.levels) - 1, 0, -1):
            low, whole = self.levels[level]
            above = self.paths[0]
            start = self.levels[level + 1][0] if level + 1 < len(self.levels) else 0
            self.paths.insert(0, [self.siblings(level, low + i) + above[(low + i) // ARITY - start] for i in range(len(whole))])

    def run(self, level: int, idx: int) -> tuple[list[str], int]:
        """The members of a node's run, and which of them it is."""
        low, whole = self.levels[level]
        at = idx // ARITY * ARITY - low
        return whole[at:at + ARITY], idx % ARITY

    def siblings(self, level: int, idx: int) -> str:
        run, own = self.run(level, idx)
        return "".join(run[:own] + run[own + 1:])

    def proof(self, idx: int) -> str:
        """All siblings on a leaf's way to the root, level by level, left to right."""
        if not self.levels:
            return ""
        above = self.paths[0]
        start = self.levels[1][0] if len(self.levels) > 1 else 0
        return self.siblings(0, idx) + above[idx // ARITY - start]

    def fold(self, idx: int, digest: str) -> str:
        """The root that follows from a leaf's ``digest`` and its siblings."""
        for level in range(len(self.levels)):
            run, own = self.run(level, idx)
            if run[own] == digest:
                return self.root  # the interiors above are those derived from this very digest
            digest = sha("".join(run[:own] + [digest] + run[own + 1:]))
            idx //= ARITY
        return digest


def prove(manifest: Manifest, proofs: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of each row of the dataset.

    ``folded_root`` is computed from the row's claimed digest and its siblings; ``verified`` tells whether it is the
    manifest's root. ``proof`` (the siblings' digests one after the other) is null unless ``proofs``, which spares its bytes.
    """
    leaves, nodes, groups, root = manifest.leaves, manifest.nodes, manifest.groups, manifest.root
    spark: SparkSession = leaves.sparkSession
    ensure_shipped(spark)
    schema = "id long, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"
    if root is None:
        return spark.createDataFrame([], schema)
    own = leaves.groupBy("part", "tree").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    own = stage_table(own.join(if_small(groups), "tree"), "merkle-spans")
    n_groups = groups.count()
    upper = own.groupBy("part").agg(F.min("place").alias("first"), F.max("place").alias("last")) \
        .select("part", F.lit(TOP).alias("tree"), "first", "last", F.lit(n_groups).cast("long").alias("n"))
    asked = stage_table(missing(own.select("part", "tree", "first", "last", "n").unionByName(upper)), "merkle-asked")
    stored = nodes.unionByName(leaves.select("tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest")))
    fetched = stored.join(if_small(asked), ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "digest")
    # What each partition is told of its trees: the size (level -1, with the manifest's subroot) and place (level -2).
    told = own.select("part", "tree", F.lit(-1).alias("level"), F.col("n").alias("idx"), F.col("subroot").alias("digest")) \
        .unionByName(own.select("part", "tree", F.lit(-2).alias("level"), F.col("place").alias("idx"), F.lit(None).cast("string").alias("digest")))

    known = stage_table(fetched.unionByName(told), "merkle-fetched")

    def expand(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        by_tree: dict[str, dict[tuple[int, int], str]] = {}
        facts: dict[str, tuple[int, str]] = {}
        place: dict[str, int] = {}
        for tree, level, idx, digest in zip(known["tree"], known["level"], known["idx"], known["digest"]):
            if level == -1:
                facts[tree] = int(idx), digest
            elif level == -2:
                place[tree] = int(idx)
            else:
                by_tree.setdefault(tree, {})[int(level), int(idx)] = digest
        out = []
        trees = []
        rows = rows.sort_values(["tree", "idx"])
        for tree, part in rows.groupby("tree", sort=False):
            trees.append((place[tree], tree, part, Octopus(int(part["idx"].iloc[0]), part["leaf"].tolist(), facts[tree][0], by_tree.get(tree, {}))))
        trees.sort(key=lambda t: t[0])
        top = Octopus(trees[0][0], [t[3].root for t in trees], n_groups, by_tree.get(TOP, {}))
        for at, tree, part, own in trees:
            upper = top.proof(at)
            same = top.fold(at, own.root)
            for key, idx, leaf, claim in zip(part["id"], part["idx"].tolist(), part["leaf"], part["claim"]):
                whole = own.proof(idx) + upper
                folded = same if claim == leaf else top.fold(at, own.fold(idx, claim))
                out.append((key, leaf, facts[tree][1], root, whole if proofs else None, sha(whole), folded, folded == root))
        names = ["id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]
        return pd.DataFrame(out, columns=names).astype({"id": "Int64", "proof": object})

    return leaves.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(expand, schema)


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", claim: dict[str, Column] | None = None, part_leaves: int = PART_LEAVES,
                    **options) -> DataFrame:
    """``prove`` of ``build_manifest``: every row's proof, and whether its claimed version folds into the root.

    A row's leaf hashes the columns doc_id, source, lang, n_chars and text (option ``columns``), null as ``-``;
    each source's leaves ascend by id. Null texts and empty texts differ. A repeated row is a leaf of its own; null
    ids and sources come first; an empty table gives an empty result; other columns of ``docs`` are not read.
    """
    return prove(build_manifest(docs, id_col, claim=claim, part_leaves=part_leaves, **options))
