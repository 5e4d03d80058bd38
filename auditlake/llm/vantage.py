"""Nearest neighbours by inner product: vantage-point trees, one in each shard, pruned by the triangle inequality.

A vector x becomes the point (x / m, sqrt(1 - |x / m|^2)) with m the largest norm, a query q the point (q / |q|, 0). The
distance of the two is sqrt(2 - 2 q.x / (|q| m)), so the largest inner product is the smallest distance, of a true metric.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import materialize, tidy

#: Rows of a shard, distinct vectors of a leaf, queries of a block that meet one copy of a shard, and queries searched together.
SHARD_ROWS, LEAF, BLOCK_QUERIES, BATCH = 4096, 256, 65_536, 1024
#: The sample that the tree over shards is fitted on: so many rows and bytes at most, and so many of them for each of its leaves.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_LEAF = 65_536, 32 << 20, 32
#: What rounding may do to distances between points of norm 1, and to their products.
SLACK, SCORE_SLACK = 1e-6, 1e-9


def taking_part(vector: Column) -> Column:
    """False for vectors that are null, empty or zero, or hold null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, added up from the first component on, so equal rows give equal bits."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length: (places, matrix) of a list column's rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths())
    values, out = np.asarray(column.flatten(), dtype=np.float64), {}
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = at, values[begins[at][:, None] + np.arange(n)]
    return out


def points(x: np.ndarray, most: float) -> np.ndarray:
    scaled = x / most
    return np.hstack([scaled, np.sqrt(np.maximum(1 - (scaled * scaled).sum(1, keepdims=True), 0))])


def far(products: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * products, 0))


class Tree:
    """A vantage-point tree over points. A node is (vantage, inner child, its nearest and farthest distance, outer child, its own) or an array of rows."""

    def __init__(self, p: np.ndarray, leaf: int):
        self.nodes: list = [None]
        self.leaves: list[int] = []
        todo = [(0, np.arange(len(p)))]
        while todo:
            at, rows = todo.pop()
            if len(rows) <= leaf:
                self.nodes[at] = rows
                self.leaves.append(at)
                continue
            # the row farthest from the first one sees the others at the most various distances
            v = p[rows[np.argmin(p[rows] @ p[rows[0]])]]
            d = far(p[rows] @ v)
            half = np.argpartition(d, len(rows) // 2)
            parts = half[: len(rows) // 2], half[len(rows) // 2 :]
            node = [v]
            for part in parts:
                node += [len(self.nodes), d[part].min(), d[part].max()]
                todo.append((len(self.nodes), rows[part]))
                self.nodes.append(None)
            self.nodes[at] = tuple(node)


class Router:
    """A tree over a sample that deals all vectors to cells: at each node what is nearer than the median goes inside."""

    def __init__(self, p: np.ndarray, leaf: int):
        self.vantages, self.radii, self.children, self.cells = [], [], [], 0
        self.paths: list[list[tuple[int, bool]]] = []
        self.root = self._grow(p, leaf, [])

    def _grow(self, p: np.ndarray, leaf: int, path: list) -> int:
        """The node's number, or minus one minus its cell."""
        if len(p) > leaf:
            v = p[np.argmin(p @ p[0])]
            d = far(p @ v)
            r = float(np.median(d))
            if (d <= r).any() and (d > r).any():
                at = len(self.vantages)
                self.vantages.append(v)
                self.radii.append(r)
                self.children.append(None)
                self.children[at] = self._grow(p[d <= r], leaf, [*path, (at, True)]), self._grow(p[d > r], leaf, [*path, (at, False)])
                return at
        self.paths.append(path)
        self.cells += 1
        return -self.cells

    def cell(self, p: np.ndarray) -> np.ndarray:
        """The cell of each point; a point of a query stands for what is nearest to it."""
        out, todo = np.zeros(len(p), dtype=np.int64), [(self.root, np.arange(len(p)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
                continue
            inside = far(p[rows] @ self.vantages[at]) <= self.radii[at]
            todo += [(self.children[at][0], rows[inside]), (self.children[at][1], rows[~inside])]
        return out

    def least(self, p: np.ndarray) -> np.ndarray:
        """No point of a cell is nearer to a query than this: queries x cells."""
        out = np.zeros((len(p), self.cells))
        if not self.vantages:
            return out
        beyond = far(p @ np.array(self.vantages).T) - np.array(self.radii)
        for c, path in enumerate(self.paths):
            for at, inside in path:
                np.maximum(out[:, c], beyond[:, at] if inside else -beyond[:, at], out=out[:, c])
        return out


class Best:
    """The best k found so far of each query: larger score first, then smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.k, self.scores, self.ids = k, np.full((queries, k), -np.inf), np.zeros((queries, k), dtype=np.int64)

    def add(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.unique(q)
        old = self.scores[touched] > -np.inf
        q = np.concatenate([q, np.repeat(touched, old.sum(1))])
        scores, ids = np.concatenate([scores, self.scores[touched][old]]), np.concatenate([ids, self.ids[touched][old]])
        order = np.lexsort((ids, -scores, q))
        q, scores, ids = q[order], scores[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.scores[q[keep], place[keep]], self.ids[q[keep], place[keep]] = scores[keep], ids[keep]


class Shard:
    """A shard's vectors of one length: distinct ones in a tree, each with its smallest ids, which are all that k places can hold."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: float, k: int, leaf: int):
        self.x, group = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, group))
        group, ids = group.reshape(-1)[order], ids[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])]
        group, ids = group[new], ids[new]
        first = np.arange(len(group)) - np.searchsorted(group, group) <= k
        group, self.ids = group[first], ids[first]
        self.begins, self.counts = np.searchsorted(group, np.arange(len(self.x))), np.bincount(group, minlength=len(self.x))
        self.most, self.k = most, k
        self.p = points(self.x, most)
        self.tree = Tree(self.p, leaf)
        self.visited = 0

    def _leaf(self, rows, active, q, unit, own, scale, best: Best, known) -> None:
        worst = np.maximum(best.scores[active, -1], known[active])
        self.visited += len(active) * len(rows)
        near = unit[active] @ self.p[rows, :-1].T >= (worst / scale[active] - SCORE_SLACK)[:, None]
        a, b = np.nonzero(near)
        if not len(a):
            return
        a, b = active[a], rows[b]
        scores, n = product(q[a], self.x[b]), self.counts[b]
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begins[b], n)
        a, scores, ids = np.repeat(a, n), np.repeat(scores, n), self.ids[places]
        keep = (ids != own[a]) & (scores >= known[a])
        best.add(a[keep], scores[keep], ids[keep])

    def search(self, own: np.ndarray, q: np.ndarray, known: np.ndarray, factor: float) -> Best:
        """own: the queries' ids, which they don't find; known: the k-th best score found elsewhere, or minus infinity."""
        norm = np.linalg.norm(q, axis=1)
        unit, scale, best = q / norm[:, None], norm * self.most, Best(len(q), self.k)
        home, todo = np.zeros(len(q), dtype=np.int64), [(0, np.arange(len(q)))]
        while todo:  # each query to the leaf that it would be in
            at, active = todo.pop()
            node = self.tree.nodes[at]
            if isinstance(node, np.ndarray):
                home[active] = at
                self._leaf(node, active, q, unit, own, scale, best, known)
                continue
            d = far(unit[active] @ node[0][:-1])
            inside = d <= (node[3] + node[5]) / 2
            todo += [(at, rows) for at, rows in ((node[1], active[inside]), (node[4], active[~inside])) if len(rows)]
        todo = [(0, np.arange(len(q)))]
        while todo:  # all other leaves that the bounds don't exclude
            at, active = todo.pop()
            node = self.tree.nodes[at]
            if isinstance(node, np.ndarray):
                if len(active := active[home[active] != at]):
                    self._leaf(node, active, q, unit, own, scale, best, known)
                continue
            worst = np.maximum(best.scores[active, -1], known[active])
            limit = np.where(worst > -np.inf, far(np.where(worst > -np.inf, worst, 0) / scale[active]), np.inf) + SLACK
            d = far(unit[active] @ node[0][:-1])
            for child, low, high in (node[1:4], node[4:7]):
                rows = active[~(np.maximum(low - d, d - high) * factor > limit)]
                if len(rows):
                    todo.append((child, rows))
        return best


def _runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows alike in columns."""
    keys = np.array([np.asarray(batch.column(c)) for c in columns]).T
    cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def _searcher(most: float, k: int, factor: float, leaf: int):
    """Rows come by shard and block, vectors (kind 0) before queries (kind 1); queries come out with the best ids and scores."""

    def run(batches):
        key, held, shards = None, [], None
        for batch in batches:
            for (shard, block, kind), part in _runs(batch, ["shard", "block", "kind"]):
                if (shard, block) != key:
                    key, held, shards = (shard, block), [], None
                if kind == 0:
                    held.append(part.select(["id", "vector"]))
                    continue
                if shards is None:
                    shards = {}
                    if held:
                        t = pa.Table.from_batches(held)
                        ids = np.asarray(t["id"].combine_chunks())
                        shards = {n: Shard(ids[at], x, most, k, leaf) for n, (at, x) in by_length(t["vector"]).items()}
                    held = []
                for a in range(0, part.num_rows, BATCH):
                    some = part.slice(a, BATCH)
                    own, known = np.asarray(some.column("id")), np.asarray(some.column("known"), dtype=np.float64)
                    scores, ids = [[]] * len(own), [[]] * len(own)
                    for n, (at, q) in by_length(some.column("vector")).items():
                        if n in shards:
                            best = shards[n].search(own[at], q, known[at], factor)
                            for i, s, x in zip(at, best.scores, best.ids, strict=True):
                                m = int((s > -np.inf).sum())
                                scores[i], ids[i] = s[:m], x[:m]
                    yield pa.RecordBatch.from_arrays(
                        [some.column("number"), some.column("id"), some.column("vector"), some.column("shard"), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))],
                        ["number", "id", "vector", "shard", "ids", "scores"],
                    )

    return tidy(run)


FOUND = "number long, id long, vector array<double>, shard long, ids array<long>, scores array<double>"
#: A cell's shards are numbered from cell * SUBS on.
SUBS = 1 << 32


def _meet(index: DataFrame, routed: DataFrame, blocks: int, most: float, k: int, factor: float, leaf: int) -> DataFrame:
    """Queries searched in the shards they are routed to; a shard is copied once for each block of queries that comes to it."""
    routed = routed.withColumn("block", F.pmod("number", F.lit(blocks)).cast("long"))
    copies = index.join(routed.select("shard", "block").distinct(), "shard")
    columns = ["shard", "block", "kind", "number", "id", "vector", "known"]
    both = copies.withColumns({"kind": F.lit(0).cast("long"), "number": F.lit(0).cast("long"), "known": F.lit(0.0)}).select(*columns)
    both = both.unionByName(routed.withColumn("kind", F.lit(1).cast("long")).select(*columns))
    return both.repartition("shard", "block").sortWithinPartitions("shard", "block", "kind").mapInArrow(_searcher(most, k, factor, leaf), FOUND)


def nearest(rows: DataFrame, id_column: str, vector: str, is_query: Column, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds the k rows with the largest inner product.

    A subtree or shard is left out where factor times its least possible distance is over that of the k-th best so far:
    at 1 the result is exact, above it fewer are visited. A first round searches each query's own shard, a second one all
    others that its k-th best leaves over. Scores are inner products in double precision; ties go to the smaller id.

    The tree that deals rows to cells is fitted on SAMPLE_ROWS rows at most; every row is indexed. Cells of more than
    shard_rows rows are split by id. Vectors that are null, empty or zero, or hold null or non-finite components take no
    part, nor do rows with a null id. Equal rows count once; a row is not found by queries of its own id. Vectors are
    compared with those of equal length only. An empty table gives no rows. Further columns are ignored.
    """
    part = rows.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks")).filter(taking_part(F.col("vector")))
    sums = part.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))), F.max(F.size("vector"))).first()
    total, most, longest = sums[0], sums[1] or 1.0, sums[2] or 1
    wanted = min(SAMPLE_ROWS, max(SAMPLE_BYTES // (8 * longest), SAMPLE_LEAF), SAMPLE_LEAF * -(-total // shard_rows))
    routers: dict[int, Router] = {}
    if total > shard_rows:
        share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, 1.2 * wanted / total) * (1 << 30))
        some = part.filter(share).limit(wanted).select("vector").toArrow()
        sizes = by_length(some["vector"]) if some.num_rows else {}
        routers = {n: Router(points(x, most), max(len(x) * shard_rows // total, SAMPLE_LEAF)) for n, (_, x) in sizes.items() if len(x) > SAMPLE_LEAF}
    first = dict(zip(routers, np.cumsum([1, *(r.cells for r in routers.values())]).tolist(), strict=False))

    def place(batches):  # cell 0 takes all lengths without a tree of their own
        for b in batches:
            cells = np.zeros(b.num_rows, dtype=np.int64)
            for n, (at, x) in by_length(b.column("vector")).items() if b.num_rows else ():
                if n in routers:
                    cells[at] = first[n] + routers[n].cell(points(x, most))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells)], [*b.schema.names, "cell"])

    placed = materialize(part.mapInArrow(tidy(place), "id long, vector array<double>, asks boolean, cell long"), "vectors")
    # as many rows as the router has cells, which the sample bounds
    shards = {r["cell"]: -(-r["n"] // shard_rows) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    split = {c: n for c, n in shards.items() if n > 1}
    sub = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, n in split.items() for x in (c, n)]), "cell"), F.lit(1)) if split else F.lit(1)
    index = placed.select("id", "vector", (F.col("cell") * SUBS + F.pmod(F.xxhash64("id"), sub)).alias("shard"))
    asked = placed.filter("asks").dropDuplicates(["id", "vector"]).select(F.monotonically_increasing_id().alias("number"), "id", "vector", (F.col("cell") * SUBS).alias("shard"), F.lit(float("-inf")).alias("known"))
    asked = materialize(asked, "vector-queries")
    blocks = max(-(-asked.count() // BLOCK_QUERIES), 1)
    home = materialize(_meet(index, asked, blocks, most, k, factor, leaf), "vectors-home")

    def route(batches):
        for b in batches:
            at, to, known = [], [], []
            scores, own = b.column("scores").to_pylist(), np.asarray(b.column("shard"))
            worst = np.array([s[-1] if len(s) == k else -np.inf for s in scores])
            for n, (rows, q) in by_length(b.column("vector")).items() if b.num_rows else ():
                norm = np.linalg.norm(q, axis=1)
                cells, least = [0], np.zeros((len(rows), 1))
                if n in routers:
                    unit = np.hstack([q / norm[:, None], np.zeros((len(rows), 1))])
                    least = routers[n].least(unit)
                    cells = list(range(first[n], first[n] + routers[n].cells))
                w = worst[rows]
                limit = np.where(w > -np.inf, far(np.where(w > -np.inf, w, 0) / (norm * most)), np.inf) + SLACK
                for j, c in enumerate(cells):
                    go = rows[~(least[:, j] * factor > limit)]
                    for s in range(shards.get(c, 0)):
                        there = go[own[go] != c * SUBS + s]
                        at.append(there)
                        to.append(np.full(len(there), c * SUBS + s))
                        known.append(worst[there])
            at = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
            picked = b.select(["number", "id", "vector"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.concatenate(to) if to else [], pa.int64()), pa.array(np.concatenate(known) if known else [], pa.float64())], ["number", "id", "vector", "shard", "known"])

    routed = home.mapInArrow(tidy(route), "number long, id long, vector array<double>, shard long, known double")
    others = _meet(index, materialize(routed, "vectors-routed"), blocks, most, k, factor, leaf)
    both = home.select("number", "id", "ids", "scores").unionByName(others.select("number", "id", "ids", "scores"))
    pairs = both.select("number", F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("number", "query_id", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
