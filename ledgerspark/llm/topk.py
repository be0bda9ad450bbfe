"""Exact top-k by inner product with a KD-tree per shard.

Each shard's vectors become a tree of median splits; every node, inner ones too, carries its tight bounding
box. Queries go down a tree together: nodes that are not opened wait in a heap, best bound first, each with
the queries that may still need it. No vector of a box can score more than the sum over dimensions of the
larger of ``q * low`` and ``q * high``. An inner node that is opened gives its two children, a leaf its
scores, and a query stays out of every node whose bound is below its k-th score known so far, with whole
subtrees unopened. That score travels: every shard first sends each query to its most promising leaf, the
k-th best over all shards becomes each query's starting bound, and only then are the trees searched in full.

Trees and blocks of queries are stored rows. They meet in cells, groups of blocks by groups of trees: a task
holds the queries of a cell while its trees pass by, so neither side is collected, broadcast or multiplied
by the shards of the other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.session import discard, store

K = 5
SCALE = 256
EVERY = 50
SHARD_ROWS = 4096
LEAF_ROWS = 64
QUERY_ROWS = 512
# Blocks of queries that go down a tree together: their scores on a leaf stay in the processor's cache.
TOGETHER = 8
# Bytes of query vectors, as doubles, that a task holds at once.
HELD_BYTES = 1 << 26
# Trees that a task searches for the queries it holds; fewer where there would be less than so many cells a core.
CELL_TREES = 64
CELLS_PER_CORE = 4


@dataclass
class Tree:
    """A KD-tree over rows in ``order``. Node ``i`` has the rows ``[begin, end)`` of it, its box, and its
    first child (the other follows), or -1 for a leaf."""

    order: np.ndarray
    nodes: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build_tree(vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    order = np.arange(len(vectors))
    nodes = [[0, len(vectors), -1]]
    at = 0
    while at < len(nodes):
        begin, end, _ = nodes[at]
        if end - begin > leaf_rows:
            part = vectors[order[begin:end]]
            dim = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            # The median by rank halves the rows even where many share one value.
            middle = (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(part[:, dim], middle)]
            nodes[at][2] = len(nodes)
            nodes += [[begin, begin + middle, -1], [begin + middle, end, -1]]
        at += 1
    boxes = [(vectors[order[b:e]].min(axis=0), vectors[order[b:e]].max(axis=0)) for b, e, _ in nodes]
    low, high = (np.array(x) for x in zip(*boxes, strict=True))
    return Tree(order, np.array(nodes, np.int64), low, high)


class Asked:
    """Queries that search together, and the best ``k`` rows that each has found so far.

    ``least`` and ``least_id`` are score and id of a row that a query's final k-th does not come after;
    rows that do are not kept. The row ``own`` is no candidate.
    """

    def __init__(self, vectors: np.ndarray, own: np.ndarray, least: np.ndarray, least_id: np.ndarray, k: int):
        self.vectors, self.own, self.k = vectors, own, k
        self.least, self.least_id = least.astype(np.float64), least_id.astype(np.int64)
        self.total = float(np.abs(vectors).sum(axis=1, dtype=np.float64).max(initial=0))
        whole = np.empty(0, np.int64)
        self.best = (whole, np.empty(0), whole, whole)
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def sides(self, kind: type) -> np.ndarray:
        """Each query beside its absolute values: times a box's middle and half width they are its bound.

        Made anew for each tree: what a task holds meanwhile are the narrow vectors.
        """
        v = self.vectors.astype(kind)
        return np.hstack([v, np.abs(v)])

    def take(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Keep what may be among the best of ``scores``, one row for each of ``who`` and a column a vector."""
        kth = self.least[who].astype(scores.dtype)
        hit = scores >= kth[:, None]
        many, width = np.count_nonzero(hit), scores.shape[1]
        if not many:
            return
        if width > self.k + 1 and many > 2 * (self.k + 1) * len(who):
            # Beside the query's own row no more than k can count, and those that equal the last of them.
            place = width - self.k - 1
            hit &= scores >= np.partition(scores, place, axis=1)[:, place, None]
        at, which = np.divmod(np.flatnonzero(hit), width)
        found, query = scores[at, which].astype(np.float64), who[at]
        keep = (rows[which] != self.own[query]) & ((found > self.least[query]) | (ids[which] <= self.least_id[query]))
        if keep.any():
            self.fresh.append((query[keep], found[keep], ids[which[keep]], rows[which[keep]]))
            self.waiting += int(np.count_nonzero(keep))
            if self.waiting >= len(self.own):
                self.settle()

    def settle(self) -> None:
        """Put what was found among the best; ties go to the smaller id, then to the smaller row."""
        query, score, ids, rows = (np.concatenate(x) for x in zip(self.best, *self.fresh, strict=True))
        order = np.lexsort((rows, ids, -score, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[rank < self.k]
        self.best = (query[order], score[order], ids[order], rows[order])
        self.fresh, self.waiting = [], 0
        query, score, ids, _ = (x[rank[rank < self.k] == self.k - 1] for x in self.best)
        nearer = (score > self.least[query]) | ((score == self.least[query]) & (ids < self.least_id[query]))
        self.least[query[nearer]], self.least_id[query[nearer]] = score[nearer], ids[nearer]


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, asked: Asked, first: bool = False) -> int:
    """Search one shard for all queries of ``asked``; how many nodes they opened, each counted by itself.

    Nodes bound below a query's ``least`` are not opened for it, equal ones are, since ties go to the smaller
    id. With ``first`` each query follows the better child of each node to one leaf, for a first bound.
    """
    low, high = tree.low.astype(np.float64), tree.high.astype(np.float64)
    # No product adds up to more. Below 2**22 all sums and their halves are exact in single precision; else
    # bounds are raised by what rounding can take off them.
    most = asked.total * max(np.abs(low[0]).max(initial=0), np.abs(high[0]).max(initial=0))
    kind = np.float32 if most < 2**22 else np.float64
    loose = kind(0 if kind is np.float32 else 4 * vectors.shape[1] * np.finfo(kind).eps * most)
    boxes = np.hstack([(high + low) / 2, (high - low) / 2]).astype(kind)
    sides, vectors = asked.sides(kind), vectors.astype(kind)
    dim, opened = vectors.shape[1], 0
    everyone = np.arange(len(asked.own))
    open_ = [(0.0, 0, everyone, sides @ boxes[0] + loose)]
    while open_:
        _, at, who, bound = heapq.heappop(open_)
        still = bound >= asked.least[who].astype(kind)
        if not still.all():
            who = who[still]
        if not len(who):
            continue
        opened += len(who)
        begin, end, child = tree.nodes[at].tolist()
        if child < 0:
            part = sides[:, :dim] if len(who) == len(everyone) else sides[who, :dim]
            asked.take(who, part @ vectors[begin:end].T, ids[begin:end], rows[begin:end])
            continue
        part = sides if len(who) == len(everyone) else sides[who]
        both = part @ boxes[child : child + 2].T + loose
        needed = both >= asked.least[who].astype(kind)[:, None]
        if first:
            better = both[:, 0] >= both[:, 1]
            needed &= np.stack([better, ~better], axis=1)
        for i in range(2):
            some = np.flatnonzero(needed[:, i])
            if len(some):
                limits = both[some, i]
                heapq.heappush(open_, (-float(limits.max()), child + i, who[some], limits))
    return opened


def search_one(
    tree: Tree, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int, query: np.ndarray, k: int, least: float
) -> tuple[list[tuple[float, int, int]], int]:
    """Best ``k`` of one shard for one query as ``(-score, id, row)``, and how many nodes were opened.

    ``least`` is a score that the query's final k-th reaches.
    """
    last = np.array([np.iinfo(np.int64).max])
    asked = Asked(query[None], np.array([own]), np.array([least]), last, k)
    opened = search(tree, vectors, ids, rows, asked)
    asked.settle()
    _, score, of, row = asked.best
    return list(zip((-score).tolist(), of.tolist(), row.tolist(), strict=True)), opened


def integer_vectors(table: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """``vec_id`` and integer vector; vectors with NULL or non-finite components take no part."""
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale))
    sound = F.col(embedding).isNotNull() & ~F.exists(
        embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    return table.where(sound & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v")
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1 if len(whole) else 0)


def _narrow(v: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that holds them all."""
    largest = np.abs(v).max(initial=0)
    return v.astype(np.int16 if largest < 2**15 else np.int32 if largest < 2**31 else np.float64)


def top_k(
    table: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    every: int = EVERY,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: best ``k`` rows by integer inner product, per query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own,
    rows of the same id or vector included. Components become ``floor(scale * x)``. Ties go to the smaller
    id; fewer rows than ``k`` give all of them. Vectors that are NULL or hold NULL, NaN or infinite
    components take no part, nor do rows without an id; vectors score against those of their own length
    only. A repeated id is a candidate, and where divisible a query, once per row. An empty table gives
    none; other columns of ``table`` do not matter. Scores are exact while they stay below 2**53.
    """
    # The number of a row is fixed by being written.
    numbered = integer_vectors(table, vec_id, embedding, scale).withColumn("row", F.monotonically_increasing_id())
    written = store(numbered, "vectors")
    vectors = written.withColumn("dim", F.size("v"))
    asking = F.col("vec_id") % every == 0
    count, asked, widest = vectors.agg(F.count(F.lit(1)), F.count_if(asking), F.coalesce(F.max("dim"), F.lit(0))).first()
    shards = max(1, -(-count // shard_rows))
    blocks = max(1, -(-asked // QUERY_ROWS))
    # Cells: every group of blocks meets every group of trees in one of them.
    cell_blocks = max(1, HELD_BYTES // (8 * max(1, widest) * QUERY_ROWS))
    block_groups = -(-blocks // cell_blocks)
    cores = table.sparkSession.sparkContext.defaultParallelism
    tree_groups = min(shards, max(-(-shards // CELL_TREES), -(-CELLS_PER_CORE * cores // block_groups)))
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))

    stored = "ids binary, numbers binary, kind string, rows binary"

    def plant(rows: pa.Table) -> pa.Table:
        v = _matrix(rows["v"])
        tree = build_tree(v)
        whole = _narrow(np.concatenate([v[tree.order], tree.low, tree.high]))
        n, m = len(v), len(tree.nodes)
        made = {
            "part": pa.array([rows["shard"][0].as_py() % tree_groups], pa.int32()),
            "dim": pa.array([v.shape[1]], pa.int32()),
            "ids": [rows["vec_id"].to_numpy()[tree.order].tobytes()],
            "numbers": [rows["row"].to_numpy()[tree.order].tobytes()],
            "kind": [whole.dtype.str],
            "rows": [whole[:n].tobytes()],
            "nodes": [tree.nodes.tobytes()],
            "low": [whole[n : n + m].tobytes()],
            "high": [whole[n + m :].tobytes()],
        }
        return pa.table(made)

    trees = store(
        placed.groupBy("shard", "dim").applyInArrow(
            plant, f"part int, dim int, {stored}, nodes binary, low binary, high binary"
        ),
        "trees",
    )
    queries = store(
        vectors.where(asking)
        .withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
        .select("block", "dim", "vec_id", "v", "row"),
        "queries",
    )
    discard(written)

    def pack(rows: pa.Table) -> pa.Table:
        v = _narrow(_matrix(rows["v"]))
        made = {
            "part": pa.array([rows["block"][0].as_py() % block_groups], pa.int32()),
            "dim": pa.array([v.shape[1]], pa.int32()),
            "ids": [rows["vec_id"].to_numpy().tobytes()],
            "numbers": [rows["row"].to_numpy().tobytes()],
            "kind": [v.dtype.str],
            "rows": [v.tobytes()],
            "least": [rows["least"].to_numpy().tobytes()],
            "least_id": [rows["least_id"].to_numpy().tobytes()],
        }
        return pa.table(made)

    def cells(bounded: DataFrame) -> DataFrame:
        """Blocks and trees by the cells in which they meet, in each the blocks first."""
        packed = bounded.groupBy("block", "dim").applyInArrow(
            pack, f"part int, dim int, {stored}, least binary, least_id binary"
        )
        none = F.lit(None).cast("binary")
        asked = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tree_groups - 1)))).select(
            (F.col("other") * block_groups + F.col("part")).alias("cell"), F.lit(0).alias("side"), *packed.columns[1:],
            *[none.alias(x) for x in ("nodes", "low", "high")],
        )
        met = trees.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(block_groups - 1)))).select(
            (F.col("part") * block_groups + F.col("other")).alias("cell"), F.lit(1).alias("side"), *trees.columns[1:],
            *[none.alias(x) for x in ("least", "least_id")],
        )
        # Each cell is one task: by a hash of it some tasks would get several cells, others none.
        both = asked.unionByName(met).repartitionById(tree_groups * block_groups, F.col("cell"))
        return both.sortWithinPartitions("cell", "dim", "side")

    names = ["query", "query_id", "vec_id", "number", "score"]

    def run(first: bool):
        def gathered(blocks: list[dict]) -> tuple[Asked, np.ndarray]:
            """Blocks that search together, and the ids of their queries."""
            ids, own, least, least_id = (
                np.concatenate([np.frombuffer(b[x], kind) for b in blocks])
                for x, kind in (("ids", np.int64), ("numbers", np.int64), ("least", np.float64), ("least_id", np.int64))
            )
            v = np.concatenate([np.frombuffer(b["rows"], b["kind"]) for b in blocks]).reshape(len(ids), blocks[0]["dim"])
            return Asked(v, own, least, least_id, k), ids

        def best(parts: list[tuple[Asked, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for asked, query_ids in parts:
                asked.settle()
                query, score, ids, rows = asked.best
                whole = pa.array(score).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([asked.own[query], query_ids[query], ids, rows, whole], names=names)

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, waiting, parts = None, [], []
            for row in (x for batch in batches for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                if cell != (row["cell"], row["dim"]):
                    yield from best(parts)
                    cell, waiting, parts = (row["cell"], row["dim"]), [], []
                if row["side"] == 0:
                    waiting.append(row)
                    continue
                parts += [gathered(waiting[i : i + TOGETHER]) for i in range(0, len(waiting), TOGETHER)]
                waiting = []
                ids, numbers = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["numbers"], np.int64)
                v = np.frombuffer(row["rows"], row["kind"]).reshape(len(ids), row["dim"])
                nodes = np.frombuffer(row["nodes"], np.int64).reshape(-1, 3)
                low, high = (np.frombuffer(row[x], row["kind"]).reshape(len(nodes), row["dim"]) for x in ("low", "high"))
                tree = Tree(np.arange(len(ids)), nodes, low, high)
                for asked, _ in parts:
                    search(tree, v, ids, numbers, asked, first)
            yield from best(parts)

        return searched

    schema = "query long, query_id long, vec_id long, number long, score long"
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "number")
    unbounded = queries.withColumns({"least": F.lit(float("-inf")), "least_id": F.lit(0).cast("long")})
    found = cells(unbounded).mapInArrow(run(True), schema)
    # The k-th best of what all shards found so far: a bound that the final k-th reaches.
    kth = (
        found.withColumn("place", F.row_number().over(order)).where(F.col("place") == k)
        .select(F.col("query").alias("of"), F.col("score").cast("double").alias("least"), F.col("vec_id").alias("least_id"))
    )
    bounded = store(
        queries.join(kth.hint("merge"), F.col("row") == F.col("of"), "left").select(
            *queries.columns,
            F.coalesce("least", F.lit(float("-inf"))).alias("least"),
            F.coalesce("least_id", F.lit(0)).alias("least_id"),
        ),
        "bounded",
    )
    discard(queries)
    return (
        cells(bounded).mapInArrow(run(False), schema)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
