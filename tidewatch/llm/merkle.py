"""Merkle manifest of a dataset: one tree per group of rows, one over the groups, and a witness for every row.

A row's leaf is the SHA-256 of its fields. Within a group leaves ascend by id, and while several nodes remain every
``FANOUT`` consecutive ones (the last run may be shorter, even one) become the hash of their digests. What remains
is the group's subroot; subroots in the order of the groups make the root in the same way.

Method: incremental witnesses. Leaves get their place by a range partitioning and running counts, and go to aligned
blocks of ``FANOUT ** STEP`` places. A task streams a block's leaves in order and appends each to the open runs; a
leaf carries a partial witness, and when the run of an enclosing subtree is complete the digests of the siblings
extend the witnesses of all leaves below. The roots of the blocks are appended in the same way, step by step, until
a group has one node; then the subroots are. On the way back a block begins with the witness of its root, which
completes those of its leaves. No task holds more than one block, whatever the size of a group.

Null ids come first; rows that share an id are ordered by their leaf, and equal rows are interchangeable. The null
group comes first, then groups by their UTF-8 bytes. Null and empty fields differ. An empty table has no rows and no
root. Other columns of the table, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import partitions
from tidewatch.session import settle

FANOUT = 16
STEP = 3  # levels in a block
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """SHA-256 of the fields, each its length in bytes and its value, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def height(nodes: int, fanout: int = FANOUT) -> int:
    """Levels until one node remains."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


class Spans:
    """A witness as it is: per level the digests of the siblings before and after."""

    def __init__(self, claim: str):
        self.before: list[str] = []
        self.after: list[str] = []

    def extend(self, before: str, after: str) -> None:
        self.before.append(before)
        self.after.append(after)


class Folded:
    """A witness in constant space: the hash of all siblings so far, and the claimed leaf folded with them."""

    def __init__(self, claim: str):
        self.proof = hashlib.sha256()
        self.node = claim

    def extend(self, before: str, after: str) -> None:
        self.proof.update((before + after).encode())
        self.node = digest(before + self.node + after)


class OpenTree:
    """Nodes appended one by one; ``open[k]`` is the unfinished run of level k with the witnesses below each node."""

    def __init__(self, levels: int, fanout: int):
        self.fanout, self.levels = fanout, levels
        self.open: list[list[tuple[str, list]]] = [[] for _ in range(levels + 1)]

    def append(self, node: str, witness: list, level: int = 0) -> None:
        self.open[level].append((node, witness))
        if level < self.levels and len(self.open[level]) == self.fanout:
            self.close(level)

    def close(self, level: int) -> None:
        """A run is complete: its digests extend every witness below, and its hash is a node of the next level."""
        run, self.open[level] = self.open[level], []
        digests = [d for d, _ in run]
        held = []
        for k, (_, witnesses) in enumerate(run):
            before, after = "".join(digests[:k]), "".join(digests[k + 1 :])
            for w in witnesses:
                w.extend(before, after)
            held += witnesses
        self.append(digest("".join(digests)), held, level + 1)

    def finish(self) -> tuple[str, list]:
        for level in range(self.levels):
            if self.open[level]:
                self.close(level)
        return self.open[self.levels][0]


def _placed(nodes: DataFrame, *order: str) -> DataFrame:
    """Nodes (grp, ...) with ``place`` in their group's order, ``total`` of the group; written once."""
    ties = nodes.withColumn("tie", F.monotonically_increasing_id())
    keys = ["grp", *order, "tie"]
    there = ties.repartitionByRange(partitions(nodes), *keys).sortWithinPartitions(*keys).drop("tie").withColumn("row", F.monotonically_increasing_id())
    there = settle(there.withColumn("part", F.shiftright("row", 33)), "merkle-order")
    runs = there.groupBy("grp", "part").agg(F.min("row").alias("begin"), F.count("*").alias("size"))
    group = Window.partitionBy("grp")  # a group has at most one run per partition
    before = F.sum("size").over(group.orderBy("part")) - F.col("size")
    runs = runs.select(F.col("grp").alias("run_grp"), F.col("part").alias("run_part"), (before - F.col("begin")).alias("shift"), F.sum("size").over(group).alias("total"))
    met = there.join(runs, F.col("grp").eqNullSafe(F.col("run_grp")) & (F.col("part") == F.col("run_part")))
    return met.select(*nodes.columns, (F.col("row") + F.col("shift")).alias("place"), "total")


_NODE = "grp string, place long, total long, digest string"


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    """Rows of a block side by side in their order; one block lies in one partition."""
    cut = nodes if "block" in nodes.columns else nodes.withColumn("block", F.expr(f"place div {size}"))
    return cut.repartition(partitions(nodes), "grp", "block").sortWithinPartitions("grp", "block", "place")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list[dict]]]:
    """Per batch the rows of each block in turn; the flag says that a block begins."""
    last: object = object()
    for b in batches:
        rows: list[dict] = []
        for r in b.to_pylist():
            key = (r["grp"], r["block"])
            if key != last:
                if rows:
                    yield False, rows
                yield True, []
                rows, last = [], key
            rows.append(r)
        if rows:
            yield False, rows


def _roots(nodes: DataFrame, fanout: int, step: int) -> DataFrame:
    """The next step's nodes: the root of every block, at the place of the block."""
    size = fanout**step
    schema = pa.schema([("grp", pa.string()), ("place", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, own = None, None
        for begins, rows in _runs(batches):
            if begins and tree is not None:
                yield row(tree, own)
            if begins:
                tree = None
            for r in rows:
                if tree is None:
                    tree, own = OpenTree(min(step, height(r["total"], fanout)), fanout), r
                tree.append(r["digest"], [])
        if tree is not None:
            yield row(tree, own)

    def row(tree: OpenTree, r: dict) -> pa.RecordBatch:
        out = {"grp": r["grp"], "place": r["block"], "total": -(-r["total"] // size), "digest": tree.finish()[0]}
        return pa.RecordBatch.from_pylist([out], schema=schema)

    return _blocks(nodes.select("grp", "place", "total", "digest"), size).mapInArrow(run, _NODE)


def _witnessed(nodes: DataFrame, above: DataFrame, fanout: int, step: int, folded: bool, own: str = "") -> DataFrame:
    """Nodes with the witness up to the root: within their block, then that of the block, ``above`` (grp, block, subroot, before, after).

    ``folded`` gives proof and node of each claim instead of the digests. ``own`` names further columns, with types.
    """
    size = fanout**step
    kept = [c.split(" ")[0] for c in own.split(", ") if c]
    head = above.withColumns({"place": F.lit(-1).cast("long"), "total": F.lit(0).cast("long")})
    there = nodes.select("grp", "place", "total", "digest", *kept, *(["claim"] if folded else []), F.expr(f"place div {size}").alias("block"))
    both = _blocks(there.unionByName(head, allowMissingColumns=True), size)
    shape = ", ".join(["grp string, place long, digest string, subroot string", *([own] if own else []), "proof_sha256 string, folded string" if folded else "before array<string>, after array<string>"])
    schema = nodes.sparkSession.createDataFrame([], shape).limit(0).toArrow().schema
    kind = Folded if folded else Spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, tree, held = None, None, []
        for begins, rows in _runs(batches):
            if begins and top is not None:
                yield done(top, tree, held)
            if begins:
                top, tree, held = None, None, []
            for r in rows:
                if top is None:
                    top = r  # the block's own row comes first
                    continue
                if tree is None:
                    tree = OpenTree(min(step, height(r["total"], fanout)), fanout)
                w = kind(r["claim"] if folded else r["digest"])
                tree.append(r["digest"], [w])
                held.append(({c: r[c] for c in ("grp", "place", "digest", *kept)}, w))
        if top is not None:
            yield done(top, tree, held)

    def done(top: dict, tree: OpenTree, held: list[tuple[dict, Spans | Folded]]) -> pa.RecordBatch:
        tree.finish()
        out = []
        for r, w in held:
            for before, after in zip(top["before"], top["after"], strict=True):
                w.extend(before, after)
            r["subroot"] = top["subroot"]
            out.append(r | ({"proof_sha256": w.proof.hexdigest(), "folded": w.node} if folded else {"before": w.before, "after": w.after}))
        return pa.RecordBatch.from_pylist(out, schema=schema)

    return both.mapInArrow(run, shape)


def _steps(nodes: DataFrame, fanout: int, step: int) -> list[DataFrame]:
    """Nodes, the roots of their blocks, and so on until each group has one node."""
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > 1:
        out.append(settle(_roots(out[-1], fanout, step), "merkle-roots"))
    return out


def _descend(steps: list[DataFrame], above: DataFrame, fanout: int, step: int, folded: bool = False, own: str = "") -> DataFrame:
    """Witnesses of the first step's nodes. ``above``: (grp, subroot, before, after) of each group's last node."""
    now = above.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(steps) - 2, 0, -1):
        there = _witnessed(steps[k], now, fanout, step, False)
        now = settle(there.select("grp", F.col("place").alias("block"), "subroot", "before", "after"), "merkle-witness")
    return _witnessed(steps[0], now, fanout, step, folded, own)


@dataclass
class Manifest:
    """``entries``: (grp, id, claim, digest, place, total). ``groups``: (grp, subroot, before, after). ``root``: None without rows."""

    entries: DataFrame
    steps: list[DataFrame]
    groups: DataFrame
    root: str | None
    fanout: int
    step: int

    def witnesses(self) -> DataFrame:
        """(grp, place, digest, subroot, id, before, after): per level, leaf to root, the siblings' digests as one text each."""
        return _descend(self.steps, self.groups, self.fanout, self.step, own="id string")

    def audit(self) -> DataFrame:
        """(grp, place, digest, subroot, id, proof_sha256, folded): the hash of the siblings and the claim folded with them."""
        return _descend(self.steps, self.groups, self.fanout, self.step, folded=True, own="id string")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = COLUMNS, claims: dict[str, Column] | None = None, fanout: int = FANOUT, step: int = STEP) -> Manifest:
    """Trees over ``docs``. ``claims`` replaces fields by what is to be checked against the manifest (none: the rows as they are)."""
    fields = [F.col(c) for c in columns]
    claimed = [(claims or {}).get(c, F.col(c)) for c in columns]
    rows = docs.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), leaf_of(*fields).alias("digest"), leaf_of(*claimed).alias("claim"))
    entries = settle(_placed(rows, "id", "digest").withColumn("id", F.col("id").cast("string")), "merkle-leaves")
    steps = _steps(entries, fanout, step)
    # A group that is one node early stays that node. The groups' last nodes are the leaves of one more tree.
    over = _placed(steps[-1].select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("name"), "digest"), "name")
    over = settle(over, "merkle-groups")
    over_steps = _steps(over, fanout, step)
    last = over_steps[-1].where("total = 1").first()
    if last is None:
        return Manifest(entries, steps, over.selectExpr("name grp", "digest subroot", "array(digest) before", "array(digest) after"), None, fanout, step)
    start = docs.sparkSession.createDataFrame([(None, last["digest"], [], [])], "grp string, subroot string, before array<string>, after array<string>")
    groups = settle(_descend(over_steps, start, fanout, step, own="name string").select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "before", "after"), "merkle-tops")
    return Manifest(entries, steps, groups, last["digest"], fanout, step)
