"""SimHash near-duplicates: fingerprints, links within a Hamming distance, linked groups.

Links are found by a self-join of binary tries. Fingerprints are first dealt into cells that share
enough bits: with ``b`` blocks of the 64 bits and at most ``e`` differing bits, ``b - e`` blocks
agree, so every choice of ``b - e`` blocks is one table and its bits are the cell's key. Inside a
cell the fingerprints are a trie over their sorted order; pairs of its nodes are walked together,
level by level for all cells of a batch at once. A pair carries the number of bits in which its two
prefixes differ and is dropped as soon as that exceeds the budget.

A large cell is dealt into tiles, and each pair of tiles is a cell of its own, so no cell outgrows a
task and no link is lost. A cell sends a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import only_staying, over_texts
from ledgerspark.llm.components import components
from ledgerspark.session import lookup_side, store

BITS = 64
SEED = 42
SHINGLE = 4
MAX_BITS = 4
TILE = 512
# Tables get more key bits until a cell holds this many fingerprints on average.
CELL_ROWS = 64
# Node pairs this small are compared directly.
DIRECT = 32
# Cells walked together: as many as could hold this many pairs.
PAIRS_AT_ONCE = 4_000_000


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``shingle`` words, repeats included; a shorter text with words is one run."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: max(1, n - shingle + 1)].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], SEED) for i, j in zip(begins, ends[min(shingle, n) - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of the hashes of a text's shingles, 0 of none."""
    if not len(hashes):
        return 0
    rows = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    # A block of at most 255 rows is summed without leaving bytes.
    ones = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(bits), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text; see ``fingerprints``."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id`` and ``fp``, the fingerprint as a signed long.

    Words are runs of non-white-space with A-Z lower-cased. Every shingle counts as often as it
    occurs; a text with fewer words is one shingle, a text without words (or NULL) has fingerprint 0.
    """

    def make():
        return lambda texts: [pa.array([fingerprint(t, shingle) for t in texts], pa.int64())]

    return over_texts(docs, doc_id, text, make, "fp long")


def tables(count: int, max_bits: int) -> list[int]:
    """Masks of the key bits of each table, as few as keep cells of ``count`` rows small."""
    for agree in range(1, BITS - max_bits):
        blocks = max_bits + agree
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        parts = [sum(1 << bit for bit in range(low, high)) for low, high in zip(edges, edges[1:], strict=False)]
        masks = [sum(chosen) for chosen in combinations(parts, agree)]
        if count <= CELL_ROWS << min(mask.bit_count() for mask in masks) or len(masks) > 64:
            return masks
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def walk(values: np.ndarray, roots: tuple[np.ndarray, ...], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``budget`` bits. ``values``: sorted within each root's ranges.

    ``roots`` are the pairs of trie nodes to begin with, as ``(low, high, low, high)`` ranges of
    ``values``; a node paired with itself gives each pair of its members once.
    """
    la, ha, lb, hb = roots
    differ = np.zeros(len(la), np.int64)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for bit in range(BITS - 1, -2, -1):
        size = (ha - la) * (hb - lb)
        small = size <= DIRECT if bit >= 0 else size > 0
        if small.any():
            n = size[small]
            pair = np.repeat(np.flatnonzero(small), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = (hb - lb)[pair]
            i, j = la[pair] + k // width, lb[pair] + k % width
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            # Within one node each pair is met twice and each member once with itself.
            near &= (la[pair] != lb[pair]) | (i < j)
            left.append(i[near])
            right.append(j[near])
            keep = ~small
            la, ha, lb, hb, differ = la[keep], ha[keep], lb[keep], hb[keep], differ[keep]
        if bit < 0 or not len(la):
            break
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        ma, mb = ha - (ones[ha] - ones[la]), hb - (ones[hb] - ones[lb])
        own = la == lb
        la, ha, lb, hb, differ = (
            np.concatenate(parts)
            for parts in (
                (la, ma, la, ma[~own]),
                (ma, ha, ma, ha[~own]),
                (lb, mb, mb, lb[~own]),
                (mb, hb, hb, mb[~own]),
                (differ, differ, differ + 1, differ[~own] + 1),
            )
        )
        open_ = (la < ha) & (lb < hb) & (differ <= budget) & ~((la == lb) & (ha - la < 2))
        la, ha, lb, hb, differ = la[open_], ha[open_], lb[open_], hb[open_], differ[open_]
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` members the smallest one it is linked with, over any number of links."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        label = label[label]
        if (label == before).all():
            break
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    while (label != label[label]).any():
        label = label[label]
    return label


def _cell_links(values: np.ndarray, tile: np.ndarray, cell: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole cells: ``cell`` ascends, ``tile`` tells the two sides of a cell apart."""
    order = np.lexsort((values, tile, cell))
    values, tile, cell = values[order], tile[order], cell[order]
    runs = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1]))))
    ends = np.append(runs[1:], len(values))
    # A cell with two runs joins them; a cell with one run joins the run with itself.
    first = np.concatenate(([True], cell[runs[1:]] != cell[runs[:-1]]))
    last = np.concatenate((first[1:], [True]))
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    low, high = [], []
    possible = np.cumsum((ends[a] - runs[a]) * (ends[b] - runs[b])) // PAIRS_AT_ONCE
    for part in np.unique(possible):
        mine = possible == part
        i, j = walk(values, (runs[a[mine]], ends[a[mine]], runs[b[mine]], ends[b[mine]]), budget)
        # Members and links of this part only.
        nodes, at = np.unique(np.concatenate((i, j)), return_inverse=True)
        label = forest(len(nodes), at[: len(i)], at[len(i) :])
        child = np.flatnonzero(label != np.arange(len(nodes)))
        low.append(values[nodes[label[child]]])
        high.append(values[nodes[child]])
    return np.concatenate(low), np.concatenate(high)


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``(a, b)`` whose connected groups are those of all links within ``max_bits``.

    ``distinct`` holds each fingerprint once, in the column ``fp``.
    """
    masks = tables(distinct.count(), max_bits)
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
            for i, mask in enumerate(masks)
        ]
    )
    dealt = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"))
    large = lookup_side(
        sizes.where(F.col("n") > TILE).select(
            F.col("t").alias("lt"), F.col("key").alias("lkey"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles")
        )
    )
    tiles = F.coalesce(F.col("tiles"), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    tiled = (
        dealt.join(large, (F.col("t") == F.col("lt")) & (F.col("key") == F.col("lkey")), "left")
        .select("fp", "t", "key", own.alias("tile"), F.sequence(F.lit(0), tiles - 1).alias("others"))
        .select("fp", "t", "key", "tile", F.explode("others").alias("other"))
        .select(
            "t", "key", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "fp"
        )
    )
    cells = tiled.repartition("t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain_end(batches):
            if batch is not None:
                part = [np.asarray(batch.column(i)) for i in range(6)]
                rest = part if rest is None else [np.concatenate(x) for x in zip(rest, part, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            t, key, x, y, tile, fp = rest
            new = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            cut = len(t) if batch is None else (int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0)
            if batch is not None and cut < 20_000:
                continue
            cell = np.concatenate(([0], np.cumsum(new)))[:cut]
            # Both sides of a cell of two tiles must have rows.
            count = np.bincount(cell)
            pure = x[:cut] == y[:cut]
            with_first = np.bincount(cell, weights=tile[:cut] == x[:cut])
            useful = (count > 1)[cell] & (pure | ((with_first > 0) & (with_first < count))[cell])
            low, high = _cell_links(
                fp[:cut][useful].view(np.uint64), tile[:cut][useful], cell[useful], max_bits
            ) if useful.any() else (np.empty(0, np.uint64), np.empty(0, np.uint64))
            rest = [column[cut:] for column in rest]
            yield pa.RecordBatch.from_arrays(
                [pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], names=["a", "b"]
            )

    return cells.mapInArrow(run, "a long, b long")


def chain_end(batches: Iterator) -> Iterator:
    """The batches, then None."""
    yield from batches
    yield None


def near_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per document: ``doc_id, text_key, fp, component_id, stays``.

    ``component_id`` is the smallest id that links reach from the document, its own included;
    ``stays`` is true for the document of that id. NULL ids take part but never name a group that
    has another id. Equal rows stay as many rows. An empty table gives no rows. Other columns of
    ``docs`` are not looked at.
    """
    prints = store(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    # Per group the smallest id, then the smallest key of its text; a row without id comes last.
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    distinct = store(prints.groupBy("fp").agg(F.min(first).alias("least")), "distinct")
    roots = lookup_side(components(links(distinct.select("fp"), max_bits)))
    linked = distinct.join(roots, F.col("fp") == F.col("node"))
    names = lookup_side(linked.groupBy(F.col("root").alias("named")).agg(F.min("least").alias("name")))
    named = lookup_side(
        distinct.join(roots, F.col("fp") == F.col("node"), "left")
        .join(names, F.col("root") == F.col("named"), "left")
        .select(F.col("fp").alias("own_fp"), F.coalesce("name", "least").alias("name"))
    )
    stays = F.col("doc_id").eqNullSafe(F.col("name.id")) & (F.col("text_key") == F.col("name.key"))
    return prints.join(named, F.col("fp") == F.col("own_fp")).select(
        "doc_id", "text_key", "fp", F.col("name.id").alias("component_id"), stays.alias("stays")
    )


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one per group of near copies, all columns unchanged."""
    decided = near_groups(docs, doc_id, text, **options).select("doc_id", "text_key", "stays")
    return only_staying(docs, decided, doc_id, text)
