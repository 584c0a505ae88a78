"""Merkle manifest of a table: one hash tree for each group, one tree over the groups.

Every row is a leaf; the leaves of a group ascend by key, and while several nodes remain
every two consecutive ones (the last run may hold one) become their digest. Group roots,
ordered by group, form the last tree in the same way. A proof lists what a leaf is hashed
with on its way to the root.

The trees are evaluated by time-forward processing. A node's label is (level, number),
and a digest is a message to its parent's label in a priority queue, so that a sweep in
label order finds all children of a node together. The sweep runs in bands of `BITS`
levels: a task sweeps the queue of one block of at most 2^BITS consecutive nodes, and the
messages that leave the band go through a written table, dealt by the label of the block
that receives them. A reversed sweep then hands every node what its parent was given, in
front of it the digests of the node's siblings; what arrives at a leaf is its proof. A
table of n rows takes log(n) / BITS bands each way, and no task holds more than a block.

Defined cases: a null field is written `-`; a null group is a group of its own and comes
first; null keys come first; rows with equal keys are ordered by their digest, equal rows
are leaves of their own; an empty table has no leaves and a null root; other columns do
not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelloom.operators.ordering import ranked
from panelloom.sources.storage import stage

BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEFT, RIGHT, ALONE = "<", ">", "="  # where a proof's digest stands, seen from the node; a node may be alone


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """Digest of a row's fields."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def forward(digests: list[str], levels: int) -> list[list[str]]:
    """Digests of the nodes of each level, swept in label order; a node's queue entries are its children."""
    found = [digests, *[[] for _ in range(levels)]]
    queue = [(1, i >> 1, i, d) for i, d in enumerate(digests)]  # sorted, so it is a heap
    while queue and queue[0][0] <= levels:
        level, number = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, number):
            children.append(heappop(queue)[3])
        digest = _digest(*children)
        found[level].append(digest)
        heappush(queue, (level + 1, number >> 1, number, digest))
    return found


def backward(nodes: list[list[str]], suffix: list[str]) -> list[list[str]]:
    """What reaches each node of the lowest level: its siblings level by level, then `suffix`."""
    found: list = [None] * len(nodes[0])
    queue = [(1 - len(nodes), 0, suffix)]
    while queue:
        level, number, known = heappop(queue)
        if level == 0:
            found[number] = known
            continue
        below = nodes[-level - 1]
        first, last = 2 * number, min(2 * number + 1, len(below) - 1)
        if first == last:
            heappush(queue, (level + 1, first, [ALONE, *known]))
        else:
            heappush(queue, (level + 1, first, [RIGHT + below[last], *known]))
            heappush(queue, (level + 1, last, [LEFT + below[first], *known]))
    return found


def _levels(total: int, bits: int) -> int:
    """Levels that a block rises: the whole band, or up to the root if the tree is one block."""
    return bits if total > 1 << bits else (total - 1).bit_length()


def _blocks(items: DataFrame, bits: int) -> DataFrame:
    return items.withColumn("block", F.shiftright("pos", bits))


def _rise(items: DataFrame, bits: int) -> DataFrame:
    """(tree, pos, total, digest) of the nodes on top of the band, one for each block."""
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("pos")
        total = rows["total"][0].as_py()
        top = forward(rows["digest"].to_pylist(), _levels(total, bits))[-1]
        return pa.table({"tree": rows["tree"].slice(0, 1), "pos": rows["block"].slice(0, 1),
                         "total": pa.array([-(-total >> bits)], pa.int64()), "digest": pa.array(top, pa.string())})

    return _blocks(items, bits).groupBy("tree", "block").applyInArrow(run, "tree string, pos long, total long, digest string")


def _fall(items: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """The rows of `items` with their proofs; `above` gives those of the nodes on top of the band."""
    names = items.columns

    def run(group: pa.Table, known: pa.Table) -> pa.Table:
        rows = group.sort_by("pos")
        nodes = forward(rows["digest"].to_pylist(), _levels(rows["total"][0].as_py(), bits))
        proofs = backward(nodes, known["proof"][0].as_py())
        return rows.select(names).append_column("proof", pa.array(proofs, pa.list_(pa.string())))

    schema = items.withColumn("proof", F.lit(None).cast("array<string>")).schema
    above = above.select(F.col("tree").alias("owner"), F.col("pos").alias("into"), "proof")
    return _blocks(items, bits).groupBy("tree", "block").cogroup(above.groupBy("owner", "into")).applyInArrow(run, schema)


def _climb(items: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The bands' nodes from the leaves on, and (tree, digest) of the roots."""
    bands, roots = [items], []
    while True:
        top = stage(_rise(bands[-1], bits), "merkle-band")
        roots.append(top.where("total = 1"))
        rest = top.where("total > 1")
        if not rest.limit(1).count():
            break
        bands.append(rest)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return bands, found.select("tree", "digest")


def _descend(bands: list[DataFrame], proofs: DataFrame, bits: int) -> DataFrame:
    """The leaves with their proofs; `proofs` (tree, proof) gives those of the roots."""
    starts = proofs.select(F.col("tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof")
    above = None
    for items in reversed(bands):
        # Trees whose root is on top of this band start here, the others go on from the band above.
        here = items.where(f"total <= {1 << bits}").select("tree").distinct().join(starts, "tree").select("tree", "pos", "proof")
        known = here if above is None else here.unionByName(above.select("tree", "pos", "proof"))
        above = _fall(items, known, bits)
        if items is not bands[0]:
            above = stage(above, "merkle-proofs")
    return above


@dataclass
class Manifest:
    """Leaves (with `tree`, `pos`, `total`, `digest` and carried columns), the trees' roots, and the root of all."""

    bands: list[DataFrame]
    tops: list[DataFrame]
    subroots: DataFrame  # tree, digest
    root: DataFrame      # one row: digest (null if there are no leaves)
    bits: int

    def proofs(self) -> DataFrame:
        """Every leaf with `proof`: entries from the leaf's level to the root, see `fold`."""
        whole = self.tops[0].select("tree").distinct().select("tree", F.array().cast("array<string>").alias("proof"))
        outer = _descend(self.tops, whole, self.bits).select(F.col("name").alias("tree"), "proof")
        return _descend(self.bands, stage(outer, "merkle-outer"), self.bits)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    def step(known, entry):
        side, other = F.substring(entry, 1, 1), entry.substr(F.lit(2), F.lit(64))
        return F.sha2(F.when(side == LEFT, F.concat(other, known)).when(side == RIGHT, F.concat(known, other)).otherwise(known), 256)
    return F.aggregate(proof, start, step)


def siblings(proof: Column) -> Column:
    """All digests of a proof in one string."""
    return F.array_join(F.transform(proof, lambda e: e.substr(F.lit(2), F.lit(64))), "")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS,
             carry: Callable[[], dict[str, Column]] | None = None, bits: int = BITS) -> Manifest:
    """Hash trees of the rows: one for each value of `group`, leaves in ascending order of `key`.

    `carry` names further columns that the leaves keep (the key is kept as `key`).
    """
    kept = carry() if carry else {}
    named = docs.select(F.col(key).alias("key"), F.concat(F.lit("="), F.col(group).cast("string")).alias("tree"),
                        leaf([F.col(f) for f in fields]).alias("digest"), *[c.alias(n) for n, c in kept.items()])
    leaves = stage(named.withColumn("tree", F.coalesce("tree", F.lit(""))), "merkle-leaves")  # null sorts first
    items = _items(leaves, [F.col("key").asc_nulls_first(), F.col("digest")], bits)
    bands, subroots = _climb(items, bits)
    subroots = stage(subroots, "merkle-subroots")
    tops, root = _climb(_items(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"),
                               [F.col("name")], bits), bits)
    return Manifest(bands, tops, subroots, root.agg(F.max("digest").alias("digest")), bits)


def _items(rows: DataFrame, order: list[Column], bits: int) -> DataFrame:
    """Rows numbered from 0 in each tree (`pos`), with the tree's number of rows (`total`)."""
    totals = stage(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("total")), "merkle-totals")
    numbered = ranked(rows, order, "pos", ["tree"]).withColumn("pos", F.col("pos") - 1)
    return stage(numbered.join(totals, "tree"), "merkle-items")
