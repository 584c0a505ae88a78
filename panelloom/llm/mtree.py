"""Exact top-k inner product search by best-first search in M-trees.

Inner products become distances by one more component: a candidate x gets
sqrt(M - |x|^2), M being the largest squared norm, and a query gets 0, so
distance^2 = |q|^2 + M - 2 <q, x>: the highest products are the nearest candidates.

The root is a bounded set of routing vectors with covering radii. Below it, each
cell's rows are split by hash into shards of bounded size, so neither a crowded region
nor a vector that a third of the rows share grows a task. A shard is a paged M-tree:
every node has a routing vector, a covering radius and its distance to its parent's
routing vector, and leaf entries keep their distance to the leaf's.

A query first searches the shard it lies in. Its k-th distance there bounds the rest: it
goes on only to cells that reach into that radius. Within a shard every query takes its
nodes by least lower bound, and |d(q, parent) - d(node, parent)| - radius skips a node, or
an entry, before its own distance is computed. Queries that are at the same node in the
same step share its array operations. Products are exact integers; bounds have slack.

Defined cases: vectors that are null or hold a null or non-finite component take no
part; shorter vectors count as padded with zeros; null identifiers are candidates that
lose ties; repeated rows are candidates of their own; products are clipped to +-(2^63 - 1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelloom.sources.storage import stage

SHARD = 1024
ROUTES = 1024
FANOUT = 8
LEAF = 48
QUERIES_AT_ONCE = 2048
EXACT = 1 << 52
MOST = (1 << 63) - 1
SLACK = 1e-6


def integers(vectors: DataFrame) -> DataFrame:
    """row, vec_id and components floor(256 x) of the vectors that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("embedding").isNotNull() & whole)
    parts = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", parts.alias("v"))


class Space:
    """The component count, the largest squared norm, and whether doubles hold every product."""

    def __init__(self, size: int, top: int, norm: float):
        self.size, self.safe, self.norm = size, top * top * max(size, 1) < EXACT, norm

    def matrix(self, lists) -> np.ndarray:
        out = np.zeros((len(lists), self.size), np.int64)
        for i, x in enumerate(lists):
            out[i, :len(x)] = x
        return out

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Candidates with their further component."""
        x = x.astype(float)
        return np.column_stack([x, np.sqrt(np.maximum(self.norm - (x * x).sum(1), 0))])

    def products(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products of all rows of q with all of x."""
        if self.safe:
            return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
        exact = q.astype(object) @ x.T.astype(object)
        return np.array([[min(max(s, -MOST), MOST) for s in row] for row in exact], np.int64).reshape(len(q), len(x))


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def grow(points: np.ndarray, seed: int = 5) -> list[dict]:
    """Nodes of an M-tree over the points: parent, centre, radius, distance to the parent's centre, entries of leaves."""
    rng, nodes = np.random.default_rng(seed), []
    todo = [(np.arange(len(points)), points.mean(0), -1)]
    while todo:
        members, centre, parent = todo.pop()
        apart = _distances(points[members], centre)
        node = {"parent": parent, "centre": centre, "radius": apart.max(initial=0.0), "entries": members, "apart": apart,
                "to_parent": 0.0 if parent < 0 else float(_distances(nodes[parent]["centre"][None], centre)[0])}
        nodes.append(node)
        if len(members) <= LEAF:
            continue
        node["entries"], node["apart"] = members[:0], apart[:0]
        routes = points[rng.choice(members, FANOUT, replace=False)]
        nearest = np.argmin(((points[members][:, None] - routes) ** 2).sum(2), 1)
        if np.bincount(nearest).max() > 0.9 * len(members):  # hardly split, as when most are equal: halve by order
            nearest = np.arange(len(members)) * FANOUT // len(members)
        todo += [(members[nearest == j], routes[j], len(nodes) - 1) for j in range(FANOUT) if (nearest == j).any()]
    return nodes


class Tree:
    """A shard's nodes, ready for search."""

    def __init__(self, pages: pd.DataFrame, space: Space):
        pages = pages.sort_values("node")
        array = lambda name: [np.frombuffer(x) for x in pages[name]]
        self.space = space
        self.centres = np.array(array("centre")).reshape(len(pages), space.size + 1)
        self.radius, self.to_parent = pages["radius"].to_numpy(), pages["to_parent"].to_numpy()
        parents = pages["parent"].to_numpy()
        self.children = [np.flatnonzero(parents == i) for i in range(len(pages))]
        self.apart = array("apart")
        self.points = [np.frombuffer(x, np.int64).reshape(-1, space.size) for x in pages["points"]]
        self.rows = [np.asarray(x, np.int64) for x in pages["rows"]]
        self.ids = [np.asarray(x, np.int64) for x in pages["ids"]]

    def search(self, asked: np.ndarray, own: np.ndarray, k: int, reach: np.ndarray, least: np.ndarray) -> list[list]:
        """For each query the best k as (-product, id, row), given that farther ones than `reach` and products
        below `least` don't matter."""
        at = np.column_stack([asked.astype(float), np.zeros(len(asked))])
        base = (at * at).sum(1) + self.space.norm
        reach, least = reach.astype(float), least.copy()
        best: list[list] = [[] for _ in asked]
        far, bound = np.zeros((len(asked), len(self.radius))), np.full((len(asked), len(self.radius)), np.inf)
        far[:, 0] = _distances(at, self.centres[0])
        bound[:, 0] = np.maximum(far[:, 0] - self.radius[0], 0)
        while True:
            nodes = bound.argmin(1)
            low = bound[np.arange(len(asked)), nodes]
            live = np.flatnonzero(np.isfinite(low) & (low <= reach))
            if not len(live):
                return best
            for node in np.unique(nodes[live]).tolist():
                who = live[nodes[live] == node]
                bound[who, node] = np.inf
                if len(self.children[node]):
                    self._descend(node, who, at, reach, far, bound)
                else:
                    self._scan(node, who, asked, own, k, base, reach, least, far, best)

    def _descend(self, node, who, at, reach, far, bound) -> None:
        near = self.children[node]
        open_ = np.abs(far[who, node][:, None] - self.to_parent[near]) - self.radius[near] <= reach[who][:, None]
        near, open_ = near[open_.any(0)], open_[:, open_.any(0)]
        if len(near):
            gap = at[who][:, None] - self.centres[near]
            apart = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
            here = np.ix_(who, near)
            far[here] = apart
            bound[here] = np.where(open_ & (apart - self.radius[near] <= reach[who][:, None]), np.maximum(apart - self.radius[near], 0), np.inf)

    def _scan(self, node, who, asked, own, k, base, reach, least, far, best) -> None:
        some = (np.abs(far[who, node][:, None] - self.apart[node]) <= reach[who][:, None]) & (self.rows[node] != own[who][:, None])
        columns = np.flatnonzero(some.any(0))
        if not len(columns):
            return
        some = some[:, columns]
        got = self.space.products(self.points[node][columns], asked[who])
        some &= got >= least[who][:, None]
        if len(columns) > k:  # all that tie with the k-th stay
            some &= got >= np.partition(np.where(some, got, -MOST - 1), -k, axis=1)[:, -k][:, None]
        ids, rows = self.ids[node][columns], self.rows[node][columns]
        for i in np.flatnonzero(some.any(1)).tolist():
            w, found = who[i], np.flatnonzero(some[i])
            best[w] = sorted(best[w] + list(zip((-got[i, found]).tolist(), ids[found].tolist(), rows[found].tolist())))[:k]
            if len(best[w]) == k and -best[w][-1][0] > least[w]:
                least[w] = -best[w][-1][0]
                reach[w] = min(reach[w], np.sqrt(max(base[w] - 2.0 * float(least[w]), 0.0)) * (1 + 1e-9) + SLACK)


NO_ID = (1 << 63) - 1  # stands for a null identifier within tasks: the last in ties
PAGES = ("cell int, sub int, node int, parent int, radius double, to_parent double, centre binary, apart binary, "
         "points binary, rows array<long>, ids array<long>")
FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def _route(vectors: DataFrame, space: Space, routes: np.ndarray) -> DataFrame:
    """The nearest routing vector of each row, and its distance."""
    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                points = space.lifted(space.matrix(part["v"].to_pylist()))
                squares = (points ** 2).sum(1)[:, None] - 2 * points @ routes.T + (routes ** 2).sum(1)
                cell = squares.argmin(1)
                apart = _distances(points, routes[cell])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(apart)],
                                                 [*part.schema.names, "cell", "apart"])

    return vectors.mapInArrow(run, "row long, vec_id long, v array<long>, cell int, apart double")


def _pages(placed: DataFrame, space: Space) -> DataFrame:
    """Build the tree of every shard: one row a node."""
    def build(key, part):
        part = part.sort_values(["vec_id", "row"])
        vectors = space.matrix(list(part["v"]))
        rows, ids = part["row"].to_numpy(np.int64), part["vec_id"].fillna(NO_ID).to_numpy(np.int64)
        nodes = grow(space.lifted(vectors))
        return pd.DataFrame([{
            "cell": key[0], "sub": key[1], "node": i, "parent": n["parent"], "radius": n["radius"], "to_parent": n["to_parent"],
            "centre": n["centre"].tobytes(), "apart": n["apart"].tobytes(), "points": vectors[n["entries"]].tobytes(),
            "rows": rows[n["entries"]], "ids": ids[n["entries"]]} for i, n in enumerate(nodes)])

    narrow = placed.select("cell", "sub", "row", F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "v")
    return narrow.groupBy("cell", "sub").applyInPandas(build, PAGES)


def _search(asked: DataFrame, pages: DataFrame, space: Space, k: int, blocks: int) -> DataFrame:
    """Search queries (query_row, query_id, v, reach, least, cell, sub) in their shards, a bounded block of queries at a time."""
    def run(key, queries, nodes):
        out = []
        if len(queries) and len(nodes):
            own, ids = queries["query_row"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64)
            found = Tree(nodes, space).search(space.matrix(list(queries["v"])), own, k, queries["reach"].to_numpy(),
                                              queries["least"].to_numpy(np.int64))
            out = [(row, i, r, j, -s) for row, i, best in zip(own.tolist(), ids.tolist(), found) for s, j, r in best]
        return pd.DataFrame(out, columns=["query_row", "query_id", "row", "vec_id", "score"])

    held = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keyed = asked.withColumn("block", F.pmod(F.xxhash64("query_row"), F.lit(blocks)).cast("int"))
    by = ("cell", "sub", "block")
    return keyed.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(run, FOUND)


def top(vectors: DataFrame, k: int = 5, every: int = 50, shard: int = SHARD, routes: int = ROUTES) -> DataFrame:
    """The k highest products of each query (ids divisible by `every`) with all other rows."""
    spark = vectors.sparkSession
    rows = stage(integers(vectors), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = F.aggregate("v", F.lit(0).cast("double"), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    facts = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(most), F.max(norm),
                     F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long"))).first()
    total, size, largest, norm_top, queries = (x or 0 for x in facts)
    space = Space(size, int(largest), float(norm_top))
    wanted = min(max(total // shard, 1), routes)
    drawn = rows.orderBy(F.xxhash64("v"), "row").limit(wanted).select("v").collect()  # at most `routes` rows
    centres = space.lifted(space.matrix([r.v for r in drawn])) if drawn else np.zeros((1, size + 1))
    centres = np.unique(centres, axis=0)

    routed = stage(_route(rows, space, centres), "routed")
    cells = {r.cell: (r.n, r.radius) for r in routed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect()}  # a row for each routing vector at most
    subs = spark.createDataFrame([(c, -(-n // shard)) for c, (n, _) in cells.items()], "cell int, subs int")
    placed = routed.join(F.broadcast(subs), "cell").withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")).cast("int"))
    pages = stage(_pages(placed, space), "pages")
    blocks = max(1, -(-queries // QUERIES_AT_ONCE))

    asked = placed.filter(F.pmod("vec_id", F.lit(every)) == 0).select(
        F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "v", "cell", "sub")
    begun = stage(_search(asked.withColumns({"reach": F.lit(float("inf")), "least": F.lit(-MOST - 1)}), pages, space, k, blocks), "begun")

    # The k-th product so far bounds the distance; fewer than k leave it open.
    bound = begun.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bounded = asked.withColumnsRenamed({"cell": "own_cell", "sub": "own_sub"}).join(bound, "query_row", "left")
    known = list(cells)
    radii, middle = np.array([cells[c][1] for c in known]), centres[known] if known else centres

    def onward(batches):
        for batch in batches:
            at = space.matrix(batch["v"].to_pylist()).astype(float)
            square = (at ** 2).sum(1)
            floor = np.array([x or 0 for x in batch["least"].to_pylist()], np.int64)
            full = np.array([n == k for n in batch["n"].to_pylist()])
            reach = np.where(full, np.sqrt(np.maximum(square + space.norm - 2.0 * floor.astype(float), 0)) * (1 + 1e-9) + SLACK, np.inf)
            for part in (slice(i, i + 500) for i in range(0, len(at), 500)):
                apart = np.sqrt(np.maximum(square[part, None] - 2 * at[part] @ middle[:, :-1].T + (middle ** 2).sum(1), 0))
                who, where = np.nonzero(apart - radii <= reach[part, None] + 1e-5 * (1 + apart))
                taken = batch.take(pa.array(who + part.start))
                yield pa.RecordBatch.from_arrays(
                    [*(taken[c] for c in ("query_row", "query_id", "v", "own_cell", "own_sub")),
                     pa.array(np.array(known, np.int32)[where]), pa.array(reach[part][who]),
                     pa.array(np.where(full, floor, -MOST - 1)[part][who], pa.int64())],
                    ["query_row", "query_id", "v", "own_cell", "own_sub", "cell", "reach", "least"])

    further = bounded.mapInArrow(onward, "query_row long, query_id long, v array<long>, own_cell int, own_sub int, cell int, reach double, least long")
    further = further.join(F.broadcast(subs), "cell").withColumn("sub", F.explode(F.expr("sequence(0, subs - 1)")))
    further = further.filter((F.col("cell") != F.col("own_cell")) | (F.col("sub") != F.col("own_sub")))
    found = begun.unionByName(_search(further.select("query_row", "query_id", "v", "reach", "least", "cell", "sub"), pages, space, k, blocks))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
