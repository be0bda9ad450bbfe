"""Centroid clustering with heap-ordered bounds.

Each vector has an upper bound of the distance to its own centroid and a lower bound of the distance to
the second nearest. When centroids move, the gap between the two shrinks by at most what its own centroid
and the farthest moved other centroid have moved. Instead of touching every gap, a cluster keeps a heap of
gaps, each offset by what had accumulated when it was put there; only vectors whose gap is used up are
popped and compared with all centroids again. All others keep their centroid, which is proved.

Vectors are cut into blocks, rows of a table whose heaps travel with them. A round is one narrow pass over
the blocks, without a shuffle: it writes the next table and sums per cluster, and only these sums, one row
per cluster and component, are brought together. Integer vectors make sums and distances exact.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import sent
from ledgerspark.session import batches_of, discard, store

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
START = "1:"
# Vectors of one block, at most: a row of the table of blocks.
BLOCK_ROWS = 4096
# Blocks that a task has in memory together.
READ_BLOCKS = 8
# Below this size of components, products of vectors are exact as doubles.
EXACT = 1 << 20
# Bounds are doubles: a gap counts as used up a little early.
SLACK = 1e-7


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, one line per vector."""
    largest = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if largest < EXACT else np.int64
    v, c = vectors.astype(kind), centroids.astype(kind)
    return ((v**2).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c**2).sum(axis=1)[None]).astype(np.int64)


def two_nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (of equals the first) and the gap to the second nearest."""
    d = squared(vectors, centroids)
    own = d.argmin(axis=1)
    nearest = d[np.arange(len(d)), own]
    if d.shape[1] == 1:
        return own, np.full(len(d), np.inf)
    d[np.arange(len(d)), own] = np.iinfo(np.int64).max
    return own, np.sqrt(d.min(axis=1).astype(np.float64)) - np.sqrt(nearest.astype(np.float64))


class Block:
    """Vectors, their clusters, and per cluster a heap of ``(gap + what had accumulated, vector)``."""

    def __init__(self, vectors: np.ndarray, cluster: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.vectors, self.cluster, self.heaps = vectors, cluster, heaps

    @classmethod
    def first(cls, vectors: np.ndarray, centroids: np.ndarray) -> Block:
        own, gap = two_nearest(vectors, centroids)
        block = cls(vectors, own, [[] for _ in centroids])
        for c, heap in enumerate(block.heaps):
            members = np.flatnonzero(own == c)
            heap.extend(zip(gap[members].tolist(), members.tolist(), strict=True))
            heapq.heapify(heap)
        return block

    def move(self, centroids: np.ndarray, accumulated: np.ndarray) -> int:
        """Assign again after centroids moved; returns how many vectors had to be looked at."""
        popped: list[int] = []
        for heap, used in zip(self.heaps, accumulated.tolist(), strict=True):
            limit = used + SLACK * (1 + used)
            while heap and heap[0][0] <= limit:
                popped.append(heapq.heappop(heap)[1])
        if popped:
            own, gap = two_nearest(self.vectors[popped], centroids)
            self.cluster[popped] = own
            for vector, c, key in zip(popped, own.tolist(), (gap + accumulated[own]).tolist(), strict=True):
                heapq.heappush(self.heaps[c], (key, vector))
        return len(popped)

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Exact squared distance of each vector to its own centroid."""
        away = self.vectors.astype(np.int64) - centroids[self.cluster]
        return (away**2).sum(axis=1)

    def sums(self, count: int) -> np.ndarray:
        """Per cluster: vectors, then the sum of each component."""
        out = np.zeros((count, 1 + self.vectors.shape[1]), np.int64)
        for c in range(count):
            mine = self.vectors[self.cluster == c]
            out[c] = [len(mine), *mine.sum(axis=0, dtype=np.int64)]
        return out

    def packed(self) -> dict:
        """The block as values of a row; a heap stays in heap order."""
        heaps = [x for heap in self.heaps for x in heap]
        return {
            "cluster": self.cluster.astype(np.int16).tobytes(),
            "sizes": np.array(list(map(len, self.heaps)), np.int32).tobytes(),
            "keys": np.array([x[0] for x in heaps], np.float64).tobytes(),
            "members": np.array([x[1] for x in heaps], np.int32).tobytes(),
        }

    @classmethod
    def unpacked(cls, row: dict) -> Block:
        vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, row["width"])
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int32)).tolist()
        keys, members = np.frombuffer(row["keys"]).tolist(), np.frombuffer(row["members"], np.int32).tolist()
        heaps = [list(zip(keys[a:b], members[a:b], strict=True)) for a, b in zip([0, *ends], ends, strict=False)]
        return cls(vectors, np.frombuffer(row["cluster"], np.int16).astype(np.int64), heaps)


BLOCKS = (
    "ids array<{kind}>, vectors binary, kind string, width int, cluster binary, sizes binary, keys binary,"
    " members binary, looked long, sums array<long>"
)


def whole_vectors(
    table: DataFrame, vec_id: str, embedding: str, dimensions: int, scale: int
) -> DataFrame:
    """``vec_id, v`` of the vectors that take part, components ``floor(scale * x)``."""
    sound = F.col(embedding).isNotNull() & (F.size(embedding) == dimensions) & ~F.exists(
        embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * scale))
    return table.where(sound).select(F.col(vec_id).alias("vec_id"), whole.alias("v"))


def _started(vectors: DataFrame, clusters: int, start: str) -> np.ndarray:
    """Vectors of the smallest hashes, in that order; rows without an id only where others run out."""
    order = F.sha2(F.concat(F.lit(start), F.col("vec_id").cast("string")), 256)
    found = vectors.orderBy(order.asc_nulls_last(), "v").limit(clusters).select("v").toArrow().column("v").to_pylist()
    return np.array(found, np.int64).reshape(len(found), -1 if found else 0)


def _first_blocks(vectors: DataFrame, centroids: np.ndarray, dimensions: int) -> DataFrame:
    common = sent(vectors.sparkSession, centroids)
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        centroids = common()
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(begin, BLOCK_ROWS)
                v = batch.column(1).flatten().to_numpy().reshape(-1, dimensions)
                small = np.abs(v).max() < 1 << 15
                v = v.astype(np.int16) if small else v
                yield _row(batch.column(0), v, Block.first(v, centroids), batch.num_rows)

    return vectors.mapInArrow(run, BLOCKS.format(kind=kind))


def _row(ids: pa.Array, vectors: np.ndarray, block: Block, looked: int) -> pa.RecordBatch:
    values = {
        "vectors": vectors.tobytes(), "kind": vectors.dtype.str, "width": vectors.shape[1], **block.packed(),
        "looked": looked, "sums": block.sums(len(block.heaps)).ravel().tolist(),
    }
    kinds = [pa.binary(), pa.string(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.list_(pa.int64())]
    columns = [pa.array([v], k) for v, k in zip(values.values(), kinds, strict=True)]
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([listed, *columns], names=["ids", *values])


def _rows(batch: pa.RecordBatch):
    """Blocks of a batch, one in memory at a time."""
    for i in range(batch.num_rows):
        one = batch.slice(i, 1)
        row = {name: one.column(name)[0].as_py() for name in one.schema.names if name not in ("ids", "sums")}
        yield one.column("ids").flatten(), row, Block.unpacked(row)


def _moved_blocks(blocks: DataFrame, centroids: np.ndarray, accumulated: np.ndarray) -> DataFrame:
    common = sent(blocks.sparkSession, (centroids, accumulated))

    def run(batches):
        centroids, accumulated = common()
        for batch in batches:
            for ids, _, block in _rows(batch):
                looked = block.move(centroids, accumulated)
                yield _row(ids, block.vectors, block, looked)

    return blocks.mapInArrow(run, blocks.schema)


def _new_centroids(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the means; a cluster without vectors keeps its centroid."""
    each = blocks.select(F.posexplode("sums").alias("at", "part")).groupBy("at").agg(F.sum("part").alias("part"))
    found = {row["at"]: row["part"] for row in each.collect()}
    width = centroids.shape[1] + 1
    out = centroids.copy()
    for c in range(len(centroids)):
        count = found.get(c * width, 0)
        if count:
            out[c] = [found[c * width + 1 + i] // count for i in range(width - 1)]
    return out


def accumulate(accumulated: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What gaps of each cluster have lost so far: its own move and the largest move of another."""
    move = np.sqrt(((after - before).astype(np.float64) ** 2).sum(axis=1))
    others = np.array([np.delete(move, c).max(initial=0.0) for c in range(len(move))])
    return accumulated + move + others


def clustered(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS,
    rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, start: str = START,
) -> DataFrame:
    """One row per vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors of another length, NULL ones, and those with NULL, NaN or infinite components take no part.
    Components become ``floor(scale * x)``. Centroids start as the vectors whose ``sha256`` of ``start``
    and id is smallest (fewer vectors give fewer centroids; of rows with one id the smaller vector comes
    first, rows without an id come last). Ties go to the smaller number. Equal rows stay as many rows; an
    empty table gives none; other columns of ``table`` do not matter. Exact while components stay below
    2**26 in size.
    """
    spark = table.sparkSession
    vectors = whole_vectors(table, vec_id, embedding, dimensions, scale)
    centroids = _started(vectors, clusters, start)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    with batches_of(spark, BLOCK_ROWS):
        blocks = store(_first_blocks(vectors, centroids, dimensions), "blocks")
    accumulated = np.zeros(len(centroids))
    for _ in range(rounds):
        moved = _new_centroids(blocks, centroids)
        accumulated = accumulate(accumulated, centroids, moved)
        centroids = moved
        with batches_of(spark, READ_BLOCKS):
            following = store(_moved_blocks(blocks, centroids, accumulated), "blocks")
        discard(blocks)
        blocks = following
    with batches_of(spark, READ_BLOCKS):
        flat = store(_members(blocks, centroids), "members")
    discard(blocks)
    return _described(flat, centroids)


def _members(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance``: one row per vector."""
    common = sent(blocks.sparkSession, centroids)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        centroids = common()
        for batch in batches:
            for ids, _, block in _rows(batch):
                columns = [ids, pa.array(block.cluster.astype(np.int32)), pa.array(block.distances(centroids))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def _described(flat: DataFrame, centroids: np.ndarray) -> DataFrame:
    """What is known per cluster, one value for each of them, beside every vector."""
    found = {row["cluster"]: row["part"] for row in flat.groupBy("cluster").agg(F.sum("distance").alias("part")).collect()}
    each = [found.get(c, 0) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return flat.select(
        "vec_id", "cluster", "distance", of(each, "long").alias("cluster_inertia"),
        F.lit(sum(each)).cast("long").alias("inertia"), of(names, "string").alias("centroid_sha256"),
    )
