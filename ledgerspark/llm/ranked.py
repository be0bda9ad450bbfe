"""Ranked lexical search by range-maximum sparse tables over posting lists.

Documents are tokenised once; a document keeps its number of terms and its occurrences of the terms that
are asked for. What that table adds up to gives the weights and the document factors. Its rows are then
dealt into shards of about so many postings, and each shard answers all queries of a block.

In a shard every posting list has a sparse table of the positions of range maxima, so the largest impact
of a term in any interval of documents is one comparison. A query starts with the interval of all
documents. The interval whose summed maxima are largest is split at the document that holds its largest
single contribution: that document is scored, and what lies left and right of it are two intervals again.
The search ends when no interval can hold a document that belongs among the best. Nothing is skipped for
any other reason, so results are exact.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import sent, slices, text_or_empty
from ledgerspark.session import store

K = 10
# Postings of one shard, about; sparse tables of a shard take some 90 bytes a posting.
SHARD_POSTINGS = 1 << 20
# Queries, and different terms of queries, that one pass over the documents serves, about.
BLOCK_QUERIES = 4096
BLOCK_TERMS = 1 << 18
# Intervals that a query opens together: the best of its heap.
OPENED = 32

# Bytes of terms stay (A-Z in lower case), all others become spaces.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.translate(_TERM_BYTES).split()


def weight(n: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Postings:
    """Posting lists of a shard in one array, with the sparse table of range maxima."""

    def __init__(self, keys: np.ndarray, impacts: np.ndarray):
        """``keys`` are ``term << 32 | document``, ascending."""
        self.keys, self.impacts = keys, impacts
        level = np.arange(len(keys), dtype=np.int32)
        self.levels = [level]
        longest = int(np.bincount(np.unique(keys >> 32, return_inverse=True)[1]).max()) if len(keys) else 0
        width = 1
        while 2 * width <= longest:
            left, right = level[: len(level) - width], level[width:]
            level = np.where(impacts[left] >= impacts[right], left, right)
            self.levels.append(level)
            width *= 2
        # All levels in one array, so that a look-up of many ranges is one access.
        self.begins = np.concatenate(([0], np.cumsum([len(x) for x in self.levels])))[:-1].astype(np.int64)
        self.table = np.concatenate(self.levels) if len(keys) else np.empty(0, np.int32)
        del self.levels

    def largest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and impact of the first largest in each range ``[low, high)``; 0 where it is empty."""
        length = high - low
        some = length > 0
        level = np.frexp(np.maximum(length, 1))[1] - 1
        a = self.table[np.where(some, self.begins[level] + low, 0)]
        b = self.table[np.where(some, self.begins[level] + high - (np.int64(1) << level.astype(np.int64)), 0)]
        at = np.where(self.impacts[a] >= self.impacts[b], a, b)
        return at, np.where(some, self.impacts[at], 0)


def best(lists: Postings, terms: np.ndarray, weights: np.ndarray, k: int = K, opened: int = OPENED) -> list[tuple[int, int]]:
    """The ``k`` best ``(document, score)`` of one query, ties to the smaller document number."""
    low, high = np.searchsorted(lists.keys, terms << 32), np.searchsorted(lists.keys, (terms + 1) << 32)
    held = high > low
    terms, weights, low, high = terms[held] << 32, weights[held], low[held], high[held]
    if not len(terms):
        return []
    found: list[tuple[int, int]] = []  # a heap of (score, -document), worst first
    open_: list[tuple] = []
    number = itertools.count()

    def push(first: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Intervals by the ranges of every term and the first document that they may hold."""
        at, most = lists.largest(low, high)
        most = most * weights
        bound = most.sum(axis=1)
        split = lists.keys[at[np.arange(len(at)), most.argmax(axis=1)]] & 0xFFFFFFFF
        least, last = (found[0][0], -found[0][1]) if len(found) == k else (0, -1)
        for i in np.flatnonzero((bound > least) | ((bound == least) & (first < last))).tolist():
            heapq.heappush(open_, (-int(bound[i]), int(first[i]), next(number), int(split[i]), low[i], high[i]))

    push(np.zeros(1, np.int64), low[None], high[None])
    while open_:
        taken = []
        while open_ and len(taken) < opened:
            nearest = heapq.heappop(open_)
            if len(found) == k and (-nearest[0], -nearest[1]) < found[0]:
                # No later interval is better, so none is left that counts.
                open_.clear()
                break
            taken.append(nearest)
        if not taken:
            break
        split = np.array([x[3] for x in taken], np.int64)
        low, high = np.array([x[4] for x in taken]), np.array([x[5] for x in taken])
        keys = terms[None] | split[:, None]
        at = np.searchsorted(lists.keys, keys)
        inside = np.minimum(at, len(lists.keys) - 1)
        here = lists.keys[inside] == keys
        scores = (np.where(here, lists.impacts[inside], 0) * weights).sum(axis=1)
        for score, document in zip(scores.tolist(), split.tolist(), strict=True):
            if score > 0:
                if len(found) < k:
                    heapq.heappush(found, (score, -document))
                else:
                    heapq.heappushpop(found, (score, -document))
        first = np.array([x[1] for x in taken], np.int64)
        # Left of the split and right of it.
        push(np.concatenate((first, split + 1)), np.concatenate((low, at + here)), np.concatenate((at, high)))
    return [(-document, score) for score, document in sorted(found, reverse=True)]


def _counted(docs: DataFrame, doc_id: str, text: str, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, place, n, terms, times``: documents that have terms, with the asked terms they hold."""
    known = sent(docs.sparkSession, numbers)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        number_of = known().get
        place = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, 1):
                sizes, terms, times = [], [], []
                for words in map(terms_of, batch.column(1).cast(pa.binary()).to_pylist()):
                    own = Counter(map(number_of, words))
                    own.pop(None, None)
                    sizes.append(len(words))
                    terms.append(np.fromiter(own.keys(), np.int32, len(own)).tobytes())
                    times.append(np.fromiter(own.values(), np.int32, len(own)).tobytes())
                n = pa.array(sizes, pa.int64())
                places = pa.array(np.arange(place, place + len(sizes)))
                place += len(sizes)
                columns = [batch.column(0), places, n, pa.array(terms, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "place", "n", "terms", "times"])

    return rows.mapInArrow(run, f"doc_id {kind}, place long, n long, terms binary, times binary").where("n > 0")


def _document_counts(counted: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term; tasks pass on one row per term."""

    def run(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "df"])

    found = counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(terms, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def _searched(counted: DataFrame, queries: list[tuple[int, np.ndarray]], terms: int, k: int, shard_postings: int) -> DataFrame:
    """``query, doc_id, score``: the best of every shard for each query of a block."""
    n, length, postings = counted.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("terms")), F.lit(0)) / 4
    ).first()
    df = _document_counts(counted, terms)
    weights = np.array([weight(n, int(x)) for x in df], np.int64)
    asked = sent(counted.sparkSession, [(q, own, weights[own]) for q, own in queries])
    kind = counted.schema["doc_id"].dataType.simpleString()

    def search(table: pa.Table) -> pa.Table:
        # Ids in ascending order, NULL last: document numbers then decide ties as ids do.
        table = table.sort_by([("doc_id", "ascending"), ("place", "ascending")])
        held = table.column("terms").to_pylist()
        docs = np.repeat(np.arange(len(held)), [len(x) // 4 for x in held])
        own = np.frombuffer(b"".join(held), np.int32).astype(np.int64)
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), np.int32).astype(np.int64)
        factor = np.array([8 * (10 + (90 * x * n) // length) for x in table.column("n").to_pylist()], np.int64)
        impacts = 1_000_000_000 * times // (1000 * times + factor[docs])
        keys = own << 32 | docs
        order = np.argsort(keys, kind="stable")
        lists = Postings(keys[order], impacts[order])
        found = [(q, d, s) for q, mine, w in asked() for d, s in best(lists, mine, w, k)]
        q, d, s = zip(*found, strict=True) if found else ((), (), ())
        ids = table.column("doc_id").take(pa.array(d, pa.int64())).combine_chunks()
        return pa.table({"query": pa.array(q, pa.int32()), "doc_id": ids, "score": pa.array(s, pa.int64())})

    shards = max(1, -(-int(postings) // shard_postings))
    return (
        counted.where(F.octet_length("terms") > 0)
        .withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInArrow(search, f"query int, doc_id {kind}, score long")
    )


def ranked(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", k: int = K, shard_postings: int = SHARD_POSTINGS,
    block_queries: int = BLOCK_QUERIES, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best ``k`` documents of every item, scores above 0 only.

    Every row of ``docs`` is a document, repeated ones too. Equal scores go to the smaller id, NULL ids
    last; of rows with one id and score any comes first. Fewer documents than ``k`` give all; items
    without terms (or NULL) and empty tables give none; an item given twice is answered twice, with
    ranks for each of its rows. NULL texts have no terms. Other columns of both tables do not matter.

    Items are served in blocks of bounded size, one pass over the documents each. A block's items are
    on the driver; an item is one row, whatever its length.
    """
    spark = docs.sparkSession
    stated = store(items.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("text")), "items")
    rows, size = stated.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # A term and what parts it from the next are two bytes at least.
    blocks = max(1, -(-rows // block_queries), -(-size // (2 * block_terms)))
    numbered = stated.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    item_kind, doc_kind = stated.schema["item_id"].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    answered = None
    for block in range(blocks):
        own = numbered.where(F.col("block") == block).select("item_id", "text").toArrow()
        numbers: dict[bytes, int] = {}
        queries = []
        for q, content in enumerate(own.column("text").cast(pa.binary()).to_pylist()):
            mine = sorted({numbers.setdefault(t, len(numbers)) for t in terms_of(content)})
            queries.append((q, np.array(mine, np.int64)))
        counted = store(_counted(docs, doc_id, text, numbers), "postings")
        found = _searched(counted, queries, len(numbers), k, shard_postings)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = sent(spark, own.column("item_id").combine_chunks())

        def named(batches, ids=ids):
            names = ids()
            for batch in batches:
                columns = [names.take(batch.column(0)), *batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "rank", "doc_id", "score"])

        part = top.select("query", "rank", "doc_id", "score").mapInArrow(
            named, f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long"
        )
        answered = part if answered is None else answered.unionByName(part)
    return answered
