"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other, and each model also sees the probabilities of the
categories before it. While a model is trained those come from models that have not seen the
document: the labelled rows are dealt into folds, and each fold is predicted by a model of the other
folds. For scoring, one model per category is trained on all labelled rows.

All labelled rows are counted and learned from: they are dealt into shards of bounded size, the chain is
trained on each shard in a task of its own, and weights are averaged by how many rows of a shard have the
word. Scoring is one pass over the texts; weights have a bounded size.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain as chained

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import give_back, sent, slices, text_or_empty
from ledgerspark.session import lookup_side, settle

# Category and the label that it stands for, in the order of the chain.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
# A word is a feature if its counts over all labelled rows depend on a label: the likelihood ratio of
# one degree of freedom at one per cent. How many documents have it does not matter by itself.
ASSOCIATED = 6.63
# The most associated words, if there are more than fit into a task's memory.
VOCABULARY = 1 << 20
# Bytes of a word's beginning that are features as well: they catch inflected and invented forms.
BEGINNINGS = (4, 5, 6)
FOLDS = 3
# Labelled rows of one shard: about so many.
SHARD = 20_000
EPOCHS = 8
BATCH = 256
RATE = 0.3
THRESHOLD = 0.3
REMEMBERED = 500_000
# A task's counts are passed on at this many features.
FLUSH = 400_000
# A-Z in lower case, white space as it is; ASCII characters that are neither letter nor digit go.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NOISE = bytes(b for b in range(128) if not chr(b).isalnum() and b not in b" \t\n\v\f\r")


def word_set(text: bytes) -> set[bytes]:
    """The different words of a text, without punctuation."""
    return set(text.translate(_LOWER, _NOISE).split())


def features(words: set[bytes]) -> set[bytes]:
    """Words, and their beginnings."""
    return words.union(*({b"^" + w[:n] for w in words if len(w) > n} for n in BEGINNINGS))


def key(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature) - (1 << 63)


def word_keys(word: bytes) -> list[int]:
    """Features of a word as 64-bit hashes."""
    return [key(x) for x in (word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) > n))]


def _share(raw: np.ndarray) -> np.ndarray:
    """The logistic function, saturated where it would overflow."""
    return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


class Linear:
    """Logistic regression on words and a few probabilities, by mini-batch gradients."""

    def __init__(self, size: int, extra: int):
        self.words, self.extra, self.bias = np.zeros(size), np.zeros(extra), 0.0

    def raw(self, at: np.ndarray, row: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=self.words[at], minlength=n) + before @ self.extra + self.bias

    def fit(self, lists: list[np.ndarray], before: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> Linear:
        """Adagrad over rows in a fixed drawn order; the same rows give the same weights."""
        share = label.mean() if len(label) else 0.5
        self.bias = float(np.log((share * len(label) + 0.5) / ((1 - share) * len(label) + 0.5)))
        if share in (0.0, 1.0) or not len(label):
            return self
        sizes = np.array([len(x) for x in lists])
        seen_words, seen_rest = np.full(len(self.words), 1e-2), np.full(before.shape[1] + 1, 1e-2)
        drawn = np.random.default_rng(0)
        for _ in range(epochs):
            order = drawn.permutation(len(label))
            for begin in range(0, len(order), BATCH):
                rows = order[begin : begin + BATCH]
                at = np.concatenate([lists[r] for r in rows])
                row = np.repeat(np.arange(len(rows)), sizes[rows])
                miss = _share(self.raw(at, row, len(rows), before[rows])) - label[rows]
                slope = np.bincount(at, weights=miss[row], minlength=len(self.words)) / len(rows)
                seen_words += slope**2
                self.words -= RATE * slope / np.sqrt(seen_words)
                rest = np.append(before[rows].T @ miss, miss.sum()) / len(rows)
                seen_rest += rest**2
                step = RATE * rest / np.sqrt(seen_rest)
                self.extra -= step[:-1]
                self.bias -= float(step[-1])
        return self

    def probability(self, lists: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at = np.concatenate(lists) if lists else np.empty(0, np.int32)
        return _share(self.raw(at, row, len(lists), before))


def places(vocabulary: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted vocabulary; keys outside share the index behind the last."""
    if not len(vocabulary):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    return np.where(vocabulary[at] == keys, at, len(vocabulary))


class Places:
    """Indices of the vocabulary that a word has; words met are remembered up to a bound."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary, self.known = vocabulary, {}

    def of(self, words: list[set[bytes]]) -> list[list[int]]:
        """For each text the indices of its words' features, one for every word that has them."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*words).difference(self.known))
        keys = list(map(word_keys, new))
        at = places(self.vocabulary, np.fromiter(chained.from_iterable(keys), np.int64))
        ends = np.cumsum(list(map(len, keys))).tolist()
        inside = np.append(np.cumsum(at < len(self.vocabulary)), 0)
        begin = 0
        for word, end in zip(new, ends, strict=True):
            # Most words have no feature of the vocabulary.
            if inside[end - 1] > (inside[begin - 1] if begin else 0):
                self.known[word] = [x for x in at[begin:end].tolist() if x < len(self.vocabulary)]
            else:
                self.known[word] = ()
            begin = end
        get = self.known.__getitem__
        return [list(chained.from_iterable(map(get, own))) for own in words]


def _lists(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in column]


def _chain_trainer(size: int, folds: int):
    """A function that fits the chain to the rows of one shard, one model per category.

    What a model sees of the categories before it comes from models of the other folds of the shard, which
    have not seen the row. The result has a weight per word that the shard has, and how many rows have it;
    the bias is word -1, the probabilities of earlier categories are words -2, -3 and so on.
    """

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "words"])
        labels = np.array(part["labels"].tolist(), np.float64)
        lists, fold = _lists(part["words"]), part["fold"].to_numpy()
        n = np.bincount(np.concatenate(lists), minlength=size)
        own = np.flatnonzero(n)
        before, out = np.empty((len(part), 0)), []
        for place, label in enumerate(labels.T):
            model = Linear(size, place).fit(lists, before, label)
            rest = -1 - np.arange(place + 1)
            out.append(
                pd.DataFrame(
                    {
                        "model": place,
                        "at": np.concatenate((rest, own)).astype(np.int32),
                        "weight": np.concatenate(([model.bias], model.extra, model.words[own])),
                        "n": np.concatenate((np.full(len(rest), len(part)), n[own])).astype(np.int64),
                    }
                )
            )
            if place + 1 == labels.shape[1]:
                break
            p = np.empty(len(part))
            for f in range(folds):
                mine, others = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                seen = Linear(size, place).fit([lists[i] for i in others], before[others], label[others])
                p[mine] = seen.probability([lists[i] for i in mine], before[mine])
            before = np.column_stack((before, p))
        return pd.concat(out)

    return train


def _fitted(trained: DataFrame, size: int) -> list[Linear]:
    """One model per category, averaged over the shards."""
    mean = F.sum(F.col("weight") * F.col("n")) / F.sum("n")
    found = trained.groupBy("model", "at").agg(mean.alias("weight")).toArrow()
    number, at, weight = (found.column(c).to_numpy() for c in ("model", "at", "weight"))
    models = []
    for k in range(len(CATEGORIES)):
        model = Linear(size, k)
        own, values = at[number == k], weight[number == k]
        model.words[own[own >= 0]] = values[own >= 0]
        model.extra[-2 - own[own < -1]] = values[own < -1]
        model.bias = float(values[own == -1].sum())
        models.append(model)
    return models


def fit_chain(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    shard: int = SHARD, folds: int = FOLDS,
) -> tuple[np.ndarray, list[tuple[str, Linear]]]:
    """The vocabulary and one model per category, fitted on all labelled documents.

    Labels that are NULL take no part; a document labelled more than once counts with its worst
    labels. A category of which only one class was seen gives its share. Without labels every
    probability is one half.
    """
    spark = docs.sparkSession
    clean = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    shards = max(1, -(-clean.count() // shard))
    known = lookup_side(
        clean.select(
            F.col("doc_id").alias("label_id"),
            F.array(*[F.expr(rule).cast("double") for _, rule in CATEGORIES]).alias("labels"),
        )
    )
    own = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    labelled = own.join(known, F.col("id") == F.col("label_id")).select(F.xxhash64("id", "text").alias("key"), "labels", "text")
    vocabulary = _vocabulary(labelled)
    size = len(vocabulary) + 1
    sorted_keys = sent(spark, vocabulary)

    def numbered(batches):
        found = Places(sorted_keys())
        for whole in batches:
            for batch in slices(whole, 2):
                at = found.of([word_set(t) for t in batch.column(2).cast(pa.binary()).to_pylist()])
                short = pa.array([np.sort(np.array(x, np.int32)).tobytes() for x in at], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), short], names=["key", "labels", "words"])
        del found
        give_back()

    # Every row goes to its shard once; nothing of it is written.
    rows = labelled.mapInArrow(numbered, "key long, labels array<double>, words binary").select(
        "key", F.pmod(F.xxhash64("key"), F.lit(folds)).cast("int").alias("fold"),
        F.pmod(F.xxhash64("key", F.lit(8)), F.lit(shards)).cast("int").alias("shard"), "labels", "words",
    )
    trained = rows.groupBy("shard").applyInPandas(
        _chain_trainer(size, folds), "model int, at int, weight double, n long"
    )
    return vocabulary, list(zip([name for name, _ in CATEGORIES], _fitted(trained, size), strict=True))


def _vocabulary(labelled: DataFrame) -> np.ndarray:
    """Keys that depend on a label, sorted; counted over all labelled rows where the rows are."""
    width = len(CATEGORIES)
    names = [f"p{i}" for i in range(width)]

    def counted(batches):
        # One count for each combination of labels; a task passes on sums.
        counts: dict[tuple, Counter[bytes]] = {}

        def sums():
            found, n, own = [], [], []
            for labels, counter in counts.items():
                found += map(key, counter)
                n += counter.values()
                own += [labels] * len(counter)
            counts.clear()
            n, own = np.array(n, np.int64), np.array(own, np.int64).reshape(-1, width)
            columns = [pa.array(found, pa.int64()), pa.array(n), *(pa.array(n * c) for c in own.T)]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n", *names])

        for whole in batches:
            for batch in slices(whole, 1):
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                for labels, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                    counts.setdefault(tuple(map(int, labels)), Counter()).update(features(word_set(text)))
                    if sum(map(len, counts.values())) > FLUSH:
                        yield sums()
        if counts:
            yield sums()
        give_back()

    sums = labelled.select("labels", "text").mapInArrow(counted, "word long, n long, " + ", ".join(f"{c} long" for c in names))
    sums = sums.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    total = labelled.agg(F.count(F.lit(1)), *[F.sum(F.col("labels")[i]) for i in range(width)]).first()

    def ratio(p, positive):
        """The likelihood ratio of the table of word and label."""
        rows, n = float(total[0]), F.col("n").cast("double")
        cells = []
        for seen, with_word, with_label in (
            (p, n, positive), (n - p, n, rows - positive),
            (positive - p, rows - n, positive), (rows - positive - n + p, rows - n, rows - positive),
        ):
            cells.append(F.when(seen > 0, seen * F.log(seen * rows / (with_word * with_label))).otherwise(0.0))
        return 2 * sum(cells[1:], cells[0])

    ratios = [ratio(F.col(c).cast("double"), float(total[i + 1] or 0)) for i, c in enumerate(names)]
    kept = settle(sums.select("word", F.greatest(*ratios).alias("ratio")).where(F.col("ratio") >= ASSOCIATED))
    if kept.count() > VOCABULARY:
        kept = kept.orderBy(F.col("ratio").desc(), "word").limit(VOCABULARY)
    return np.sort(kept.select("word").toArrow().column(0).to_numpy())


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, shard: int = SHARD, keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) and ``low_quality, toxic, rejected``.

    The first two are the chain's probabilities; ``rejected`` is true where the last is at least
    ``threshold``. NULL texts count as empty. Equal rows stay as many rows; an empty table gives
    none. The added columns are inside one struct ``_tox``, the only name that ``docs`` may not use.
    """
    names = docs.columns if keep is None else keep
    vocabulary, chain = fit_chain(docs, labels, doc_id, text, shard)
    shared = sent(docs.sparkSession, (vocabulary, [(m.words, m.extra, m.bias) for _, m in chain]))
    rows = docs.select(*[F.col(c) for c in names], text_or_empty(text).alias("_tox"))
    scores = pa.struct([(name, pa.float64()) for name, _ in chain])
    schema = ", ".join(f"{name} double" for name, _ in chain)

    def run(batches):
        vocabulary, tables = shared()
        found = Places(vocabulary)
        for whole in batches:
            for batch in slices(whole, len(names)):
                lists = found.of([word_set(t) for t in batch.column(len(names)).cast(pa.binary()).to_pylist()])
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                row = np.repeat(np.arange(len(lists)), sizes)
                at = np.fromiter(chained.from_iterable(lists), np.int64, int(sizes.sum()))
                before = np.empty((len(lists), 0))
                for weights, extra, bias in tables:
                    raw = np.bincount(row, weights=weights[at], minlength=len(lists)) + before @ extra + bias
                    before = np.column_stack((before, _share(raw)))
                struct = pa.StructArray.from_arrays([pa.array(c) for c in before.T], fields=list(scores))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], struct], names=[*names, "_tox"])
        del found
        give_back()

    kept = docs.select(*[F.col(c) for c in names]).schema
    out = kept.add("_tox", docs.sparkSession.createDataFrame([], schema).schema)
    scored = rows.mapInArrow(run, out)
    last = chain[-1][0]
    return scored.withColumn("_tox", F.col("_tox").withField("rejected", F.col(f"_tox.{last}") >= threshold))
