"""A Merkle manifest of a dataset: a digest of every record, a tree of them per group and one tree over the groups' roots.

Leaves are ranked within their group by a range partitioning, so no group is sorted in one task. Blocks of BLOCK leaves, aligned at
multiples of BLOCK, are the subtrees that one task walks in postorder: a node's digest is returned to its parent, and while the walk unwinds the
siblings' digests are appended to the leaves below. The blocks' roots are the leaves of the next distributed walk, until a group is one
node; the groups' roots, in order, are the leaves of the last tree. On the way down each block hands its own path on to what it holds. Only
digests and keys are shuffled, each level's table is written to the shared folder, and a block's path is never kept per leaf: the last walk
makes a leaf's proof where it folds it.

Defined results: nulls are told apart from empty values by their encoding; rows with one id are leaves of their own, ordered by their digests (equal rows
have equal results but for their places in the tree); a null id comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.sources.shared import materialize

#: Consecutive nodes of a run, and the levels of a block (1024 leaves for runs of two).
RUN, LEVELS = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Starts of runs that are broadcast: some 64 bytes each. Beyond that they are joined by shuffling.
FEW = 1 << 18


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with pos, 0 and on within each group by ``order``; tasks get ranges of (group, order), so a large group has many."""
    table = materialize(
        rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()), "ranked"
    ).withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(
        table.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).withColumn(
            "_start", F.coalesce(F.sum("_n").over(before), F.lit(0))
        ).drop("_n"), "runs"
    )
    starts = F.broadcast(runs) if runs.limit(FEW + 1).count() <= FEW else runs
    return table.join(starts, [group, "_part"]).withColumn("pos", F.col("_start") + F.col("_at") - F.col("_first")).drop(
        "_at", "_part", "_first", "_start"
    )


def walk(digests: list[str], height: int | None, run: int = RUN) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest of a tree over some leaves, and for each leaf the (left, right) siblings of its ancestors and itself, lowest first.

    Without ``height`` the tree ends where one node remains; else lone nodes are hashed up to that level.
    """
    above: list[list[tuple[str, str]]] = [[] for _ in digests]
    if height is None:
        height, width = 0, len(digests)
        while width > 1:
            height, width = height + 1, -(-width // run)

    def node(level: int, begin: int) -> str:
        """The digest of the node over the leaves from ``begin`` on; its leaves get the siblings of each level below."""
        if level == 0:
            return digests[begin]
        size = run ** (level - 1)
        begins = range(begin, min(begin + run * size, len(digests)), size)
        below = [node(level - 1, b) for b in begins]
        for i, b in enumerate(begins):
            pair = "".join(below[:i]), "".join(below[i + 1 :])
            for leaf in above[b : b + size]:
                leaf.append(pair)
        return hashlib.sha256("".join(below).encode()).hexdigest()

    return node(height, 0), above


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = hashlib.sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def _block(table: pa.Table, levels: int, run: int) -> tuple[pa.Table, str, list[list[tuple[str, str]]]]:
    """A block's nodes in order, its root and their paths. Blocks that are full or not the first of their group stand on a level of their own."""
    table = table.sort_by("pos")
    inner = len(table) == run**levels or table.column("pos")[0].as_py() > 0
    return table, *walk(table.column("digest").to_pylist(), levels if inner else None, run)


def blocks(nodes: DataFrame, levels: int = LEVELS, run: int = RUN) -> DataFrame:
    """The roots (grp, pos, digest) of the blocks of nodes (grp, pos, digest)."""
    size = run**levels

    def roots(table: pa.Table) -> pa.Table:
        table, root, _ = _block(table, levels, run)
        return pa.table({"grp": table.column("grp")[:1], "pos": pa.array([table.column("pos")[0].as_py() // size]), "digest": pa.array([root])})

    block = F.expr(f"pos div {size}").alias("block")
    return nodes.select("grp", "pos", "digest").groupBy("grp", block).applyInArrow(roots, "grp string, pos long, digest string")


def climb(nodes: DataFrame, levels: int = LEVELS, run: int = RUN) -> list[DataFrame]:
    """Tables of nodes, from the given ones up to one node a group; those made here are written."""
    found = [nodes]
    while not found[-1].where("pos > 0").isEmpty():
        found.append(materialize(blocks(found[-1], levels, run), "merkle-blocks"))
    return found


PATH = "grp string, pos long, lefts array<string>, rights array<string>, subroot string, root string"


def descend(nodes: DataFrame, above: DataFrame, schema: str, make: Callable, levels: int = LEVELS, run: int = RUN) -> DataFrame:
    """What ``make`` (a block's nodes, the path of each to the root, the row of the block) gives for all blocks. above: PATH rows of the blocks."""
    size = run**levels

    def block(nodes: pa.Table, parent: pa.Table) -> pa.Table:
        nodes, _, paths = _block(nodes, levels, run)
        last = parent.to_pylist()[0]
        rest = list(zip(last["lefts"], last["rights"]))
        return make(nodes, [p + rest for p in paths], last)

    mine = nodes.withColumn("_block", F.expr(f"pos div {size}"))
    theirs = above.withColumnRenamed("pos", "_block")
    return mine.groupBy("grp", "_block").cogroup(theirs.groupBy("grp", "_block")).applyInArrow(block, schema)


def _paths(nodes: pa.Table, paths: list, last: dict) -> pa.Table:
    n, text = len(nodes), pa.list_(pa.string())
    return pa.table({
        "grp": nodes.column("grp"), "pos": nodes.column("pos"), "lefts": pa.array([[x for x, _ in p] for p in paths], text),
        "rights": pa.array([[x for _, x in p] for p in paths], text), "subroot": pa.array([last["subroot"]] * n, pa.string()), "root": pa.array([last["root"]] * n, pa.string())
    })


def _down(tables: list[DataFrame], top: DataFrame, levels: int, run: int) -> DataFrame:
    """Paths (PATH) of the second table's nodes, or of the only table's, given those of the topmost one's."""
    for nodes in reversed(tables[1:-1]):
        top = materialize(descend(nodes, top, PATH, _paths, levels, run), "merkle-paths")
    return top


def proofs(leaves: DataFrame, levels: int = LEVELS, run: int = RUN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of leaves (grp: the group's place in the order of groups; doc_id, leaf, tampered: another
    digest to fold in place of the leaf's, or null)."""
    kind = leaves.schema["doc_id"].dataType
    placed = ranked(leaves.withColumnRenamed("leaf", "digest"), "grp", "doc_id", "digest")
    tables = climb(placed, levels, run)
    # The roots of all groups are the leaves of the last tree; its only group is the empty string.
    tops = ranked(tables[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "grp", "name")
    over = climb(tops, levels, run)
    no = F.array().cast("array<string>")
    summit = materialize(
        over[-1].select("grp", "pos", no.alias("lefts"), no.alias("rights"), F.lit("").alias("subroot"), F.col("digest").alias("root")), "merkle-summit"
    )

    def named(nodes: pa.Table, paths: list, last: dict) -> pa.Table:
        table = _paths(nodes, paths, last)
        zero = pa.array([0] * len(nodes), pa.int64())
        return table.set_column(0, "grp", nodes.column("name")).set_column(1, "pos", zero).set_column(4, "subroot", nodes.column("digest"))

    groups = materialize(descend(tops, _down(over, summit, levels, run), PATH, named, levels, run), "merkle-groups")
    above = _down(tables, groups, levels, run)

    def proven(nodes: pa.Table, paths: list, last: dict) -> pa.Table:
        digests, changed = nodes.column("digest").to_pylist(), nodes.column("tampered").to_pylist()
        ends = [folded(d if t is None else t, p) for d, t, p in zip(digests, changed, paths)]
        told = [hashlib.sha256("".join(a + b for a, b in p).encode()).hexdigest() for p in paths]
        n = len(nodes)
        return pa.table({
            "doc_id": nodes.column("doc_id"), "leaf": nodes.column("digest"), "subroot": pa.array([last["subroot"]] * n, pa.string()), "root": pa.array([last["root"]] * n, pa.string()),
            "proof_sha256": pa.array(told, pa.string()), "folded_root": pa.array(ends, pa.string()), "verified": pa.array([e == last["root"] for e in ends], pa.bool_())
        })

    schema = f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return descend(placed, above, schema, proven, levels, run)


def manifest(docs: DataFrame, group: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: tuple[Column, dict[str, Column]] | None = None) -> DataFrame:
    """Proofs of all records, grouped by a text column (null first, then by bytes). ``tampered``: where a condition holds, the digest of the record with other values for some
    fields is folded in place of the leaf's, as a test of the proofs."""
    leaf = digest(*map(F.col, fields))
    other = F.lit(None).cast("string")
    if tampered:
        condition, values = tampered
        other = F.when(condition, digest(*(values.get(f, F.col(f)) for f in fields)))
    # A mark in front of the names, so that none of them is the empty string, which stands for null.
    name = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group))
    return proofs(docs.select(name.alias("grp"), "doc_id", leaf.alias("leaf"), other.alias("tampered")))
