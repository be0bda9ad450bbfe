"""Near copies by the overlap of their word shingles: exact Jaccard similarity, no pair lost.

A text is the set of its shingles. Links come from two joins, and every link is checked on the whole sets.

First the SimHash fingerprints of the texts meet in the binary trie self-join of ``simhash``: texts of one
fingerprint, and those whose fingerprints differ in few bits. A pair of similarity 0.8 may differ in more bits
than any affordable budget, so what fingerprints cannot see is found by sets joined on prefixes: where the
shingles of all texts have one order, two sets of similarity ``s`` share a shingle among the first
``n - ceil(s * n) + 1`` of each. The order is by hash, with shingles that a sample of the texts shows to be
common at the end; it decides only how many sets meet, never whether a similar pair does.

Prefixes are a little longer than that, so that similar sets share several shingles there (``least_shared``);
sets that share fewer with all others go at once.

A pair that meets is first bounded by a bitmap of each set, which holds the parity of how many shingles fall on
each place: every place where two bitmaps differ needs a shingle that only one of the sets has. Pairs that could
still be similar are checked on the whole sets, so none is lost.

As only connected groups are wanted, the sets of one shingle and of about one size are compared with one of them,
the middle. Of the others each has an apartness: the shingles that either it or the middle has. Two of
them have apart what one apartness has and the other has not. So where both apartnesses together are small enough,
both sets are similar to the middle and need no link of their own; otherwise the apartnesses of a similar pair must
overlap, by a number that their sizes give. So they are joined on prefixes as the sets were, first what the middle
has not, then what it has. A large group around one text needs few pairs of its square, also where most of its
sets are not similar to each other. Where many apartnesses meet again, one of their sets is the next middle.

Written are the prefixes of all texts, once, and the postings of shingles that texts share there. Whole
sets are made again from the texts of those that meet, and a table goes when its successor is written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm import simhash
from ledgerspark.llm.common import give_back, only_staying, over_texts, sent, slices, text_key, text_or_empty
from ledgerspark.llm.components import components
from ledgerspark.session import discard, lookup_side, store

SEED = simhash.SEED
SHINGLE = 5
# Sets of this similarity or more are near copies: OF / OUT_OF.
OF, OUT_OF = 4, 5
# One text in so many tells which shingles are common, and how many of those go to the end.
SAMPLED = 16
COMMON = 1 << 18
# A prefix is longer by one shingle for so many of its set.
EXTRA = 32
# Beside the middle, so many sets of a shingle meet each with each.
FEW = 3
# An apartness that gives more pairs than so many times its sets gets a middle of its own, so many times over.
WIDE = 16
LEVELS = 3
# Bits of the smallest bitmap of a set.
FEWEST_BITS = 64
# Nodes that a task remembers, so that copies in it are one.
REMEMBERED = 1 << 20


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text with words is one run."""
    return np.unique(simhash.shingle_hashes(text, size).view(np.int64))


def parities(words: np.ndarray) -> bytes:
    """Whether an odd number of the shingles falls on each place: a power of two of bits, at least one per shingle."""
    places = max(FEWEST_BITS, 1 << max(len(words) - 1, 0).bit_length())
    odd = np.bincount(words & np.int64(places - 1), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one of two sets only, by their bitmaps."""
    if len(a) < len(b):
        a, b = b, a
    x, y, n = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a)
    while n > len(b):
        # Half as many places: the upper half falls on the lower one.
        n //= 2
        x = (x >> 8 * n) ^ (x & ((1 << 8 * n) - 1))
    return (x ^ y).bit_count()


def could_be_similar(n: int, a: bytes, m: int, b: bytes) -> bool:
    """Whether sets of ``n`` and ``m`` shingles with these bitmaps may be similar."""
    apart = max(least_apart(a, b), abs(n - m))
    return OUT_OF * (n + m - apart) >= OF * (n + m + apart)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``OF / OUT_OF``."""
    both = len(a) + len(b)
    union = len(np.union1d(a, b))
    return OUT_OF * (both - union) >= OF * union


def node_of(words: np.ndarray) -> int:
    """Equal sets have equal nodes."""
    return xxhash.xxh64_intdigest(words.tobytes()) - (1 << 63)


def prefix(words: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The shingles of a set of which it must share some with a similar one, those of ``late`` after all others."""
    n = len(words)
    if not n:
        return words
    if len(late):
        at = np.minimum(np.searchsorted(late, words), len(late) - 1)
        words = words[np.argsort(late[at] == words, kind="stable")]
    return words[: n - (OF * n + OUT_OF - 1) // OUT_OF + 1 + n // EXTRA]


def common_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """The most common shingles of a sample of the texts, sorted."""
    sampled = docs.select(text_or_empty(text).alias("text")).where(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(SAMPLED)) == 0)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 0):
                own = [shingles(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
                words, times = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(times)], names=["word", "times"])
        give_back()

    often = sampled.mapInArrow(run, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    often = often.where("times > 1").orderBy(F.col("times").desc(), "word").limit(COMMON)
    return np.sort(often.select("word").toArrow().column(0).to_numpy())


def prefixes(docs: DataFrame, late: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text_key, node, fp, n, bits, prefix``.

    ``fp`` is the SimHash of the same shingles, repeats included. Equal sets of a task have one prefix.
    """
    common = sent(docs.sparkSession, late)

    def make():
        late, met = common(), set()

        def added(texts):
            if len(met) > REMEMBERED:
                met.clear()
            nodes, prints, sizes, bits, firsts = [], [], [], [], []
            for t in texts:
                hashes = simhash.shingle_hashes(t, SHINGLE)
                own = np.unique(hashes.view(np.int64))
                node = node_of(own)
                nodes.append(node)
                prints.append(simhash.fingerprint_of(hashes))
                sizes.append(len(own))
                bits.append(parities(own))
                firsts.append(np.empty(0, np.int64) if node in met else prefix(own, late))
                met.add(node)
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
            return [
                pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()),
                pa.array(bits, pa.binary()), lists,
            ]

        return added

    return over_texts(docs, doc_id, text, make, "node long, fp long, n int, bits binary, prefix array<long>")


def fingerprint_pairs(marks: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of sets whose fingerprints are equal or linked by the trie self-join."""
    prints = marks.select("node", "fp")
    # One set stands for all of its fingerprint.
    firsts = lookup_side(prints.groupBy(F.col("fp").alias("own")).agg(F.min("node").alias("first")))
    equal = prints.join(firsts, F.col("fp") == F.col("own")).where("node != first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    linked = lookup_side(simhash.links(firsts.select(F.col("own").alias("fp"))))
    left = firsts.select(F.col("own").alias("fa"), F.col("first").alias("x"))
    right = firsts.select(F.col("own").alias("fb"), F.col("first").alias("y"))
    near = linked.join(left, F.col("a") == F.col("fa")).join(right, F.col("b") == F.col("fb")).select("x", "y")
    return equal.unionByName(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _at_least(n):
    """A similar set has so many of ``n`` shingles."""
    return F.floor((F.lit(OF) * n + (OUT_OF - 1)) / OUT_OF)


def least_shared(n):
    """So many shingles a set of ``n`` shares with a similar one in their prefixes.

    Similar sets have all but ``n - ceil(s * n)`` of each in common, so their first common shingles are in both
    prefixes: one, and one for each by which the shorter prefix is longer. The smaller set has ``s * n`` or more.
    """
    return F.floor(_at_least(n) / EXTRA) + 1


def postings(marks: DataFrame) -> DataFrame:
    """``word, node, n, odd`` for the prefix of each set that shares enough of it; ``odd`` shingles are its own."""
    each = marks.select(F.explode("prefix").alias("word"), "node", "n")
    shared = lookup_side(
        each.groupBy("word").agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low < high").select(F.col("word").alias("shared"))
    )
    # A set comes once per task that has it; the same row twice adds no pair that was not there.
    found = store(each.join(shared, F.col("word") == F.col("shared")).drop("shared").distinct(), "shared")
    n = F.col("n")
    enough = lookup_side(
        found.groupBy(F.col("node").alias("own"), "n").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= least_shared(n))
        .select("own", (n - _at_least(n) + 1 + F.floor(n / EXTRA) - F.col("times")).cast("int").alias("odd"))
    )
    kept = store(found.join(enough, F.col("node") == F.col("own")).select("word", "node", "n", "odd"), "postings")
    discard(found)
    return kept


class Sets:
    """Whole sets of chosen nodes, made from the texts that have them."""

    def __init__(self, docs: DataFrame, text: str, marks: DataFrame):
        self.texts = docs.select(text_key(text).alias("key"), text_or_empty(text).alias("text"))
        # One text stands for all of a set.
        self.keys = marks.groupBy("node").agg(F.min("text_key").alias("key"))
        self.bits = marks.select("node", F.struct("n", "bits").alias("own"))

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` whose sets could be similar by their bitmaps."""
        met = lookup_side(pairs.select(F.explode(F.array("a", "b")).alias("met")).distinct())
        own = store(
            self.bits.join(met, F.col("node") == F.col("met"), "left_semi").groupBy("node").agg(F.first("own").alias("own")), "bits"
        )
        both = pairs.join(own.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(
            own.select(F.col("node").alias("b"), F.col("own").alias("y")), "b"
        )

        def run(batches):
            for batch in batches:
                kept = [
                    could_be_similar(n, x, m, y)
                    for n, x, m, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

        columns = ["a", "b", F.col("x.n").alias("n"), F.col("x.bits").alias("left"), F.col("y.n").alias("m"), F.col("y.bits").alias("right")]
        found = store(both.select(*columns).mapInArrow(run, "a long, b long"), "pairs")
        discard(own)
        return found

    def of(self, nodes: DataFrame) -> DataFrame:
        """``node, words`` of the column ``met``, written."""
        wanted = lookup_side(nodes.join(self.keys, F.col("met") == F.col("node")).select(F.col("key").alias("own")).distinct())
        # Many rows of one text are one.
        chosen = self.texts.join(wanted, F.col("key") == F.col("own"), "left_semi").select("text")

        def run(batches):
            met = set()
            for whole in batches:
                for batch in slices(whole, 0):
                    found = [shingles(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
                    own = {node_of(x): x.tobytes() for x in found}
                    new = [x for x in own if x not in met]
                    met.update(new)
                    if len(met) > REMEMBERED:
                        met.clear()
                    columns = [pa.array(new, pa.int64()), pa.array([own[x] for x in new], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "words"])
            met.clear()
            give_back()

        return store(chosen.mapInArrow(run, "node long, words binary").dropDuplicates(["node"]), "sets")


def _checked(pairs: DataFrame, sets: Sets) -> DataFrame:
    """The pairs ``a, b`` that are similar, written."""
    pairs = lookup_side(pairs.distinct())
    if pairs.isEmpty():
        return pairs
    pairs = sets.bounded(pairs)
    met = lookup_side(pairs.select(F.explode(F.array("a", "b")).alias("met")).distinct())
    own = sets.of(met)
    both = (
        pairs.join(own.select(F.col("node").alias("a"), F.col("words").alias("left")), "a")
        .join(own.select(F.col("node").alias("b"), F.col("words").alias("right")), "b")
        .select("a", "b", "left", "right")
    )

    def run(batches):
        for batch in batches:
            near = [
                similar(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64))
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))
        give_back()

    found = store(both.mapInArrow(run, "a long, b long"), "links")
    discard(own)
    discard(pairs)
    return found


def _could_be(x: str, y: str):
    """Sets of too different size cannot be similar."""
    return OUT_OF * F.least(x, y) >= OF * F.greatest(x, y)


def _labels(edges: DataFrame) -> DataFrame:
    """``own, root``: the group that the edges give a set so far; a set without edges is its own."""
    return lookup_side(components(edges)).select(F.col("node").alias("own"), "root")


def _labelled(rows: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """The rows with the group of their set.

    Labels are looked up where they are needed; postings are written once.
    """
    found = rows.join(labels, F.col(node) == F.col("own"), "left")
    return found.withColumn(label, F.coalesce("root", node)).drop("own", "root")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _twos_and_lists(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` of the words that two sets have, and ``key, node, n, odd, size, least`` of the others, written.

    A key is a word and a class of sizes. Similar sets are of one class or of two that follow one another; a set
    is in its own list and in the next. With a similar one it has ``least`` keys of one class.
    """
    own = F.struct("node", "n")
    words = lookup_side(
        members.groupBy(F.col("word").alias("own"))
        .agg(F.count(F.lit(1)).alias("times"), F.min(own).alias("x"), F.max(own).alias("y")).where("times > 1")
    )
    twos = words.where("times = 2").select("x", "y", F.col("x.n").alias("nx"), F.col("y.n").alias("ny")).where(_could_be("nx", "ny"))
    # A little wider than the ratio of similar sets, so that no rounding parts them.
    size = F.floor(F.log("n") / math.log(1.01 * OUT_OF / OF)).cast("int")
    more = members.join(words.where("times > 2").select("own"), F.col("word") == F.col("own"))
    keys = more.select("word", "node", "n", "odd", F.explode(F.array(size, size + 1)).alias("size"))
    lists = keys.select(F.xxhash64("word", "size").alias("key"), "node", "n", "odd", "size", least_shared(F.col("n")).cast("int").alias("least"))
    return twos.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), store(lists, "lists")


def _enough(rows: DataFrame) -> DataFrame:
    """The rows of sets that have ``least`` keys of one class."""
    own = lookup_side(
        rows.groupBy(F.col("node").alias("own"), F.col("size").alias("own_size"), "least")
        .agg(F.count(F.lit(1)).alias("times")).where("times >= least").select("own", "own_size")
    )
    return rows.join(own, (F.col("node") == F.col("own")) & (F.col("size") == F.col("own_size")), "left_semi")


def apartness(words: np.ndarray, middle: np.ndarray, away: bool) -> tuple[np.ndarray, int, int, int]:
    """What one of two sets has only, those of ``words`` first, as far as it is looked at; how many there are; and
    how many of them a set that is ``away`` must look up, and how many it must show to one that is away.

    With ``a`` and ``b`` apart from a middle of ``c`` shingles, two sets of ``n`` and ``m`` are similar if they
    have at most ``d = (n + m) / 9`` apart, so the two apartnesses share ``t >= (a + b - d) / 2``. Sets that are away
    are not similar to the middle: ``9 * a > n + c``. For the other that gives ``18 * t > 9 * b + c - m``. As
    ``b >= t`` and ``4 * m <= 5 * n``, it is ``t >= a - n / 4`` as well. Where ``t`` of ``a`` are shared, the first of
    them is among ``a - t + 1``. (Here for a similarity of 4 / 5.)
    """
    parts = np.setdiff1d(words, middle, assume_unique=True), np.setdiff1d(middle, words, assume_unique=True)
    n, c, a = len(words), len(middle), len(parts[0]) + len(parts[1])
    both, part = OF + OUT_OF, OUT_OF - OF
    # t >= a - d, and d is at most part * (n + OUT_OF * n / OF) / both = part * n / OF.
    least = max(1, -(-(OF * a - part * n) // OF))
    looked = max(0, a - least + 1) if away else 0
    shown = max(0, a - max(least, (both * a + part * (c - n)) // (2 * both) + 1) + 1)
    return np.concatenate(parts)[: max(looked, shown)], a, looked, shown


def _apart(met: DataFrame, sets: Sets) -> DataFrame:
    """``key, node, n, odd, label, a, at, looks, shown`` for what ``node`` and ``middle`` of a row have apart, written.

    A key is a middle and a shingle, ``at`` its place in the apartness of ``a`` shingles.
    """
    own = sets.of(lookup_side(met.select(F.explode(F.array("middle", "node")).alias("met")).distinct()))
    middles = lookup_side(own.join(met.select(F.col("middle").alias("met")).distinct(), F.col("node") == F.col("met"), "left_semi"))
    both = met.join(own.select(F.col("node").alias("own"), "words"), F.col("node") == F.col("own")).join(
        middles.select(F.col("node").alias("at_middle"), F.col("words").alias("others")), F.col("middle") == F.col("at_middle")
    )
    names = ["middle", "node", "n", "odd", "label"]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 6):
                found = [
                    apartness(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64), away.as_py())
                    for away, x, y in zip(batch.column(5), batch.column(6), batch.column(7), strict=True)
                ]
                times = np.array([len(x[0]) for x in found])
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                a, looked, shown = (np.repeat(np.array([x[k] for x in found]), times) for k in (1, 2, 3))
                rows = pa.array(np.repeat(np.arange(batch.num_rows), times))
                columns = [batch.column(k).take(rows) for k in range(5)]
                columns += [pa.array(np.concatenate([x[0] for x in found])), pa.array(a, pa.int32()), pa.array(at, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(at < looked), pa.array(at < shown)], names=[*names, "word", "a", "at", "looks", "shown"])
        give_back()

    schema = "middle long, node long, n int, odd int, label long, word long, a int, at int, looks boolean, shown boolean"
    spread = both.select(*names, "away", "words", "others").mapInArrow(run, schema)
    found = store(spread.select(F.xxhash64("middle", "word").alias("key"), "node", "n", "odd", "label", "a", "at", "looks", "shown"), "apart")
    discard(own)
    return found


def _meeting(spread: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of sets whose apartnesses may overlap enough, from rows of ``_apart``."""
    left = spread.where("looks").select("key", *(F.col(c).alias(f"{c}_x") for c in ("node", "n", "label", "a", "at")))
    right = spread.where("shown").select("key", *(F.col(c).alias(f"{c}_y") for c in ("node", "n", "label", "a", "at")))
    # After the first shingle that both have, they cannot share more than what follows.
    room = F.least(F.col("a_x") - F.col("at_x"), F.col("a_y") - F.col("at_y"))
    both, part = OF + OUT_OF, OUT_OF - OF
    enough = 2 * both * room >= both * (F.col("a_x") + F.col("a_y")) - part * (F.col("n_x") + F.col("n_y"))
    met = left.join(right, "key").where((F.col("label_x") != F.col("label_y")) & enough & _could_be("n_x", "n_y"))
    return met.select(*_pair("node_x", "node_y"))


def similar_links(marks: DataFrame, members: DataFrame, sets: Sets, levels: int = LEVELS) -> DataFrame:
    """Edges ``a, b`` of similar sets whose connected groups are those of all similar pairs.

    ``marks`` are the rows of ``prefixes``, ``members`` their postings ``word, node, n, odd``.
    """
    twos, lists = _twos_and_lists(members)
    edges = _checked(fingerprint_pairs(marks).unionByName(twos), sets)
    labels = _labels(edges)
    for step in range(levels):
        labelled = _labelled(lists, labels)
        # A set with few shingles of its own is likely the text that others were made from.
        order = F.struct("odd", F.xxhash64("node", F.lit(step)).alias("h"), "node", "n", "label")
        middles = lookup_side(
            labelled.groupBy("key")
            .agg(F.min(order).alias("first"), F.min("label").alias("low"), F.max("label").alias("high"))
            .where("low < high")
            .select(F.col("key").alias("w"), F.col("first.node").alias("middle"), F.col("first.n").alias("mn"), F.col("first.label").alias("ml"))
        )
        near = labelled.join(middles, F.col("key") == F.col("w")).where((F.col("label") != F.col("ml")) & _could_be("n", "mn"))
        edges = edges.unionByName(_checked(near.select(*_pair("node", "middle")), sets))
        labels = _labels(edges)
        # What is left: pairs of one key between different groups, without the middle.
        others = _labelled(lists, labels).join(middles.select("w", "middle"), F.col("key") == F.col("w")).where("node != middle")
        open_ = lookup_side(
            others.groupBy(F.col("key").alias("open"))
            .agg(F.count(F.lit(1)).alias("sets"), F.min("label").alias("low"), F.max("label").alias("high"))
            .where("low < high").select("open", "sets")
        )
        if open_.isEmpty():
            break
        left = store(others.join(open_, F.col("key") == F.col("open")).select("key", "node", "n", "odd", "size", "least", "label", "middle", "sets"), "left")
        discard(lists)
        few = left.where(F.col("sets") <= FEW)
        x, y = (few.select("key", F.col("node").alias(f"node_{s}"), F.col("n").alias(f"n_{s}"), F.col("label").alias(f"label_{s}")) for s in "xy")
        met = x.join(y, "key").where((F.col("label_x") < F.col("label_y")) & _could_be("n_x", "n_y"))
        direct = met.select(*_pair("node_x", "node_y"))
        # A pair that has not met yet has all its keys here.
        many = _enough(left.where(F.col("sets") > FEW)).select("middle", "node", "n", "odd", "label").distinct()
        many = lookup_side(_labelled(many, labels, "middle", "group").withColumn("away", F.col("label") != F.col("group")))
        if many.isEmpty():
            edges, lists = edges.unionByName(_checked(direct, sets)), left
            break
        spread = _apart(many, sets)
        looks, shown = (F.count_if(c) for c in ("looks", "shown"))
        wide = (looks * shown > WIDE * (looks + shown)) & F.lit(step < levels - 1)
        keys = lookup_side(
            spread.groupBy(F.col("key").alias("own"))
            .agg(F.min("label").alias("low"), F.max("label").alias("high"), looks.alias("looked"), shown.alias("showed"), wide.alias("wide"))
            .where("low < high and looked > 0 and showed > 0").select("own", "wide")
        )
        met = spread.join(keys, F.col("key") == F.col("own"))
        # Pairs of wide keys wait for the next middle, those of the last level do not.
        edges = edges.unionByName(_checked(direct.unionByName(_meeting(met.where("not wide"))), sets))
        again = met.where("wide").select("key", "node", "n", "odd").distinct()
        lists = store(again.select("*", F.lit(0).alias("size"), F.lit(1).alias("least")), "lists")
        discard(left)
        discard(spread)
        if lists.isEmpty():
            break
        labels = _labels(edges)
    discard(lists)
    return edges


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text_key, component_id, stays``.

    ``component_id`` is the smallest id that similar pairs reach from the document, its own included;
    ``stays`` is true for the document of that id. Equal rows are one document more than once; an empty
    table gives none; other columns of ``docs`` do not matter. Texts without words (or NULL) are copies of each
    other. NULL ids take part but never name a group that has another id.
    """
    marks = store(prefixes(docs, common_shingles(docs, text), doc_id, text), "prefixes")
    prints = marks.select("doc_id", "text_key", "node")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    # Equal sets are one.
    least = prints.groupBy("node").agg(F.min(first).alias("least"))
    members = postings(marks)
    roots = lookup_side(components(similar_links(marks, members, Sets(docs, text, marks))).select(F.col("node").alias("linked"), "root"))
    discard(members)
    rooted = least.join(roots, F.col("node") == F.col("linked"), "left").withColumn("root", F.coalesce("root", "node"))
    names = lookup_side(rooted.groupBy(F.col("root").alias("named")).agg(F.min("least").alias("name")))
    named = lookup_side(
        rooted.join(names, F.col("root") == F.col("named")).select(F.col("node").alias("own"), "name")
    )
    stays = F.col("doc_id").eqNullSafe(F.col("name.id")) & (F.col("text_key") == F.col("name.key"))
    return prints.join(named, F.col("node") == F.col("own")).select(
        "doc_id", "text_key", F.col("name.id").alias("component_id"), stays.alias("stays")
    )


def without_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per group of similar texts, all columns unchanged, whatever their
    names. Of equal rows that stay one does; an empty table stays empty."""
    decided = similar_groups(docs, doc_id, text).select("doc_id", "text_key", "stays")
    return only_staying(docs, decided, doc_id, text)
