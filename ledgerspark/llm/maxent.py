"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

The probability of a token is that of its class in its context times that of the token in its class.
Classes come from hashed words that keep the same company. The class is a softmax over hashed
features of the context: the word before, the word two before (a skip), the word three before (a
skip), and the pair of the two words before. The word in its class is a softmax with one weight per
word, whose maximum is known: the logarithm of its smoothed count.

Weights start from how often each feature met each class in all training documents, and are trained by
distributed gradient updates from there. The rounds share all training documents among them; every task
descends over its own rows from common weights, and the tasks' weights are averaged by how often each
feature was met. The table of features grows with the words that were counted, up to what a task can hold;
it travels to the executors. Word counts never do: words of a chunk of documents meet their counts in a
join, and only counts come back to the chunk.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import sent, slices, text_or_empty
from ledgerspark.session import store

MOD, HELD_OUT = 7, 2
# The end of a text as a token; no word is empty, so no word is equal to it.
END = b""
CLASSES = 32
# Columns of what a chunk knows about its documents.
HEAD = ["doc_id", "held", "sizes", "partial"]
# Hashed words that are put into classes, and hashed neighbours that describe them.
WORD_BUCKETS = 1 << 14
COMPANY = 32
# Rows of the weight table for all context features together: as many as there are words, a power of two
# between these. Every task passes its table on, so it must stay small beside a task's texts.
FEWEST, MOST = 1 << 12, 1 << 15
CONTEXTS = 4
# How far a feature's counts are believed: occurrences of the average that join its own, and the share of
# the four kinds of features, which say partly the same.
DOUBT, BELIEF = 20.0, 0.5
# Each round descends over its share of the training documents, all rounds over all of them.
ROUNDS = 2
RATE, SEEN = 0.25, 0.1
SCORE_TOKENS = 8_192
STEP_TOKENS = 65_536
# Text that is numbered together.
CHUNK_BYTES = 8 << 20
# A task's word counts are passed on at this many words.
FLUSH = 300_000
# Places of words that a task sums up before it passes them on.
PLACES = 500_000


def words_of(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    found = text.lower().split()
    found.append(END)
    return found


def is_held_out(doc_id: str) -> Column:
    """Whether a document is not learned from: by crc32 of its id as text; NULL as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % MOD == HELD_OUT


def token_lists(texts: pa.Array) -> pa.ListArray:
    """``words_of`` for a column of texts; one space behind the last word leaves an empty end there."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(bare, ""), bare, pc.binary_join_element_wise(bare, "", " ")))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Chunk:
    """Tokens of some texts as one array of indices into their distinct words."""

    def __init__(self, texts: pa.Array | list[bytes]):
        lists = token_lists(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = lists.flatten().dictionary_encode()
        self.words = tokens.dictionary.cast(pa.binary()).to_pylist()
        self.tokens = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        self.hash = _hashes(self.words)
        self.bucket = (self.hash % np.uint64(WORD_BUCKETS)).astype(np.int32)

    def before(self, back: int) -> np.ndarray:
        """Hash of the word ``back`` places earlier in the same text, 0 beyond its beginning."""
        h = self.hash[self.tokens]
        out = np.zeros(len(h), np.uint64)
        out[back:] = h[:-back] if back else h
        out[back:][self.doc[back:] != self.doc[:-back]] = 0
        return out

    def contexts(self, features: int) -> np.ndarray:
        """Feature rows of every token, one line per kind of feature."""
        shift = np.uint64(64 - features.bit_length() + 1)
        one, two, three = self.before(1), self.before(2), self.before(3)
        mixed = (
            one * np.uint64(0x9E3779B97F4A7C15),
            two * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1),
            three * np.uint64(0x165667B19E3779F9) + np.uint64(2),
            (one * np.uint64(0xD6E8FEB86659FD93)) ^ (two * np.uint64(0xA0761D6478BD642F)) + np.uint64(3),
        )
        return np.stack([(m >> shift).astype(np.int64) for m in mixed])


def class_scores(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Score of each class above the best one, one line per token."""
    raw = np.take(weights, rows[0], axis=0)
    one = np.empty_like(raw)
    for more in rows[1:]:
        np.take(weights, more, axis=0, out=one, mode="clip")
        raw += one
    raw += bias
    raw -= raw.max(axis=1, keepdims=True)
    return raw


def first_weights(met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from how often each feature (line) met each class."""
    # Every token has one feature of each kind, so all kinds together count each class alike often.
    share = (met.sum(axis=0) + 1.0) / (met.sum() + met.shape[1])
    own = (met + DOUBT * share) / (met.sum(axis=1, keepdims=True) + DOUBT)
    return (BELIEF * np.log(own / share)).astype(np.float32), np.log(share).astype(np.float32)


def descend(weights: np.ndarray, bias: np.ndarray, chunks: Iterator[Chunk], classes: np.ndarray) -> tuple:
    """Adagrad over the tokens of one task; weights, bias and how often each row was met."""
    weights, bias = weights.copy(), bias.copy()
    seen, seen_bias = np.full(weights.shape, SEEN, np.float32), np.full(bias.shape, SEEN, np.float32)
    met = np.zeros(len(weights), np.int64)
    for chunk in chunks:
        rows, target = chunk.contexts(len(weights)), classes[chunk.bucket[chunk.tokens]]
        for begin in range(0, len(target), STEP_TOKENS):
            part, goal = rows[:, begin : begin + STEP_TOKENS], target[begin : begin + STEP_TOKENS]
            slope = class_scores(weights, bias, part)
            np.exp(slope, out=slope)
            slope /= slope.sum(axis=1, keepdims=True)
            slope[np.arange(len(goal)), goal] -= 1
            count = np.bincount(part.ravel(), minlength=len(weights))
            met += count
            # Only rows that were met move.
            used = np.flatnonzero(count)
            place = np.zeros(len(weights), np.int64)
            place[used] = np.arange(len(used))
            own = place[part].ravel()
            # One column after the other in memory: sums over strided ones take four times as long.
            columns = slope.T.astype(np.float64, order="C")
            by_class = np.stack([np.bincount(own, weights=np.tile(c, len(part)), minlength=len(used)) for c in columns])
            # The mean slope of each row, so that rare and frequent features move alike.
            by_row = (by_class / count[used]).T.astype(np.float32, order="C")
            seen[used] += by_row**2
            weights[used] -= RATE * by_row / np.sqrt(seen[used])
            step = slope.mean(axis=0)
            seen_bias += step**2
            bias -= RATE * step / np.sqrt(seen_bias)
    return weights, bias, met


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(data)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    for whole in batches:
        for batch in slices(whole, 0, CHUNK_BYTES):
            yield batch, Chunk(batch.column(0))


def count_words(training: DataFrame) -> DataFrame:
    """``word, n`` over the column ``text``; tasks pass on sums, so frequent words gather nowhere."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def rows():
            words, n = pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())
            counts.clear()
            return pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(words_of(text))
            if len(counts) > FLUSH:
                yield rows()
        if counts:
            yield rows()

    return training.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _summed(sums: DataFrame, key: str, names: list[str]) -> np.ndarray:
    """A table of fixed size from rows that add up by ``key``: first column the key."""
    total = sums.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
    found = total.toArrow()
    return np.column_stack([found.column(n).to_numpy() for n in [key, *names]])


def word_classes(training: DataFrame, count: int = CLASSES) -> np.ndarray:
    """Class of each hashed word: words that follow and precede the same hashed words go together.

    The description of the hashed words has a fixed size; clustering it is a few products.
    """
    names = [f"c{i}" for i in range(2 * COMPANY)]

    def run(batches):
        table = np.zeros((WORD_BUCKETS, 2 * COMPANY), np.int64)
        for _, chunk in _texts(batches):
            own = chunk.bucket[chunk.tokens].astype(np.int64)
            near = (chunk.hash >> np.uint64(59)).astype(np.int64)[chunk.tokens]
            same = chunk.doc[1:] == chunk.doc[:-1]
            left, right = own[1:][same] * 2 * COMPANY + near[:-1][same], own[:-1][same] * 2 * COMPANY + COMPANY + near[1:][same]
            table += np.bincount(np.concatenate((left, right)), minlength=table.size).reshape(table.shape)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *(pa.array(c) for c in table[used].T)], names=["bucket", *names]
        )

    schema = "bucket long, " + ", ".join(f"{n} long" for n in names)
    found = _summed(training.mapInArrow(run, schema), "bucket", names)
    classes = np.arange(WORD_BUCKETS, dtype=np.int64) % count
    if not len(found):
        return classes
    at, company = found[:, 0], found[:, 1:].astype(np.float64)
    mass = company.sum(axis=1)
    # Square roots of shares: distances between distributions. The sum over all words is taken off.
    shape = np.sqrt(company / np.maximum(mass, 1)[:, None])
    order = np.argsort(-mass, kind="stable")
    centres = shape[order[: min(count, len(order))]]
    for _ in range(12):
        nearest = np.argmin(((centres**2).sum(axis=1)[None] - 2 * shape @ centres.T), axis=1)
        weight = np.bincount(nearest, weights=mass, minlength=len(centres))
        moved = np.stack([np.bincount(nearest, weights=mass * x, minlength=len(centres)) for x in shape.T], axis=1)
        centres = np.where(weight[:, None] > 0, moved / np.maximum(weight, 1e-9)[:, None], centres)
    classes[at] = nearest
    return classes


def met_classes(training: DataFrame, classes: np.ndarray, features: int, count: int = CLASSES) -> np.ndarray:
    """How often each feature met each class, over all training documents."""
    names = [f"c{i}" for i in range(count)]
    common = sent(training.sparkSession, classes)

    def run(batches):
        classes = common()
        table = np.zeros((features, count), np.int64)
        for _, chunk in _texts(batches):
            own = classes[chunk.bucket[chunk.tokens]]
            for kind in chunk.contexts(features):
                table += np.bincount(kind * count + own, minlength=table.size).reshape(table.shape)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c) for c in table[used].T)], names=["row", *names])

    found = _summed(training.mapInArrow(run, "row long, " + ", ".join(f"{n} long" for n in names)), "row", names)
    met = np.zeros((features, count))
    met[found[:, 0].astype(np.int64)] = found[:, 1:]
    return met


def features_for(words: int) -> int:
    """Rows of the weight table for so many different words."""
    return min(MOST, max(FEWEST, 1 << max(words - 1, 1).bit_length()))


def train(training: DataFrame, classes: np.ndarray, features: int, count: int = CLASSES, rounds: int = ROUNDS) -> tuple:
    """Weights and bias: from the counts of all training rows, then after ``rounds`` rounds of descent.

    Every training row takes part in one round.
    """
    spark = training.sparkSession
    weights, bias = first_weights(met_classes(training, classes, features, count))
    names = [f"w{i}" for i in range(count)]
    schema = "row long, met long, " + ", ".join(f"{n} float" for n in names)
    for step in range(rounds):
        common = sent(spark, (weights, bias, classes))

        def run(batches, common=common):
            weights, bias, classes = common()
            weights, bias, met = descend(weights, bias, (chunk for _, chunk in _texts(batches)), classes)
            used = np.flatnonzero(met)
            # Rows weigh by how often they were met; the bias is one more row.
            values = np.vstack((weights[used] * met[used, None], bias * met.sum()))
            columns = [np.append(used, len(weights)), np.append(met[used], met.sum()), *values.astype(np.float32).T]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "met", *names])

        part = training.where(F.pmod(F.xxhash64("text", F.lit(4)), F.lit(rounds)) == step).select("text")
        found = _summed(part.mapInArrow(run, schema), "row", ["met", *names])
        if not len(found):
            continue
        found = found[found[:, 1] > 0]
        at, mean = found[:, 0].astype(np.int64), (found[:, 2:] / found[:, 1:2]).astype(np.float32)
        inside = at < len(weights)
        weights[at[inside]] = mean[inside]
        if (~inside).any():
            bias = mean[~inside][0]
    return weights, bias


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the contract's counts and scores, and the model's score.

    Columns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; scores are
    sums of log10 probabilities over all tokens, the end included. NULL texts count as empty and
    have the end only. A word that was never seen is, in its class, one further word. Equal rows
    stay as many rows; without training documents all counts are 0; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(
        text_or_empty(text).alias("text"), F.col(doc_id).alias("doc_id"), is_held_out(doc_id).alias("held_out")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    training = rows.where(~F.col("held_out")).select("text")
    counts = store(count_words(training), "counts")
    classes = word_classes(training)
    weights, bias = train(training, classes, features_for(counts.count()))

    # Totals per class of words, from the table of counts: as many rows as classes.
    def totals(batches):
        table = np.zeros((2, CLASSES), np.int64)
        for batch in batches:
            own = classes[(_hashes(batch.column(0).to_pylist()) % np.uint64(WORD_BUCKETS)).astype(np.int64)]
            table[0] += np.bincount(own, weights=batch.column(1).to_numpy(), minlength=CLASSES).astype(np.int64)
            table[1] += np.bincount(own, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CLASSES)), pa.array(table[0]), pa.array(table[1])], names=["class", "n", "v"]
        )

    found = _summed(counts.mapInArrow(totals, "class long, n long, v long"), "class", ["n", "v"])
    by_class = np.zeros((CLASSES, 2))
    if len(found):
        by_class[found[:, 0].astype(int)] = found[:, 1:]
    n_all, v_all = int(by_class[:, 0].sum()), int(by_class[:, 1].sum())
    in_class = np.log10(by_class[:, 0] + by_class[:, 1] + 1)
    common = sent(spark, (weights, bias, classes, in_class))

    def scored(batches):
        """Per chunk: one row for its documents, and one per distinct word with where it occurs."""
        from pyspark import TaskContext

        weights, bias, classes, in_class = common()
        task = TaskContext.get().partitionId()
        for number, (batch, chunk) in enumerate(_texts(batches)):
            own = classes[chunk.bucket[chunk.tokens]]
            rows = chunk.contexts(len(weights))
            value = np.empty(len(own))
            for begin in range(0, len(own), SCORE_TOKENS):
                part = slice(begin, begin + SCORE_TOKENS)
                table = class_scores(weights, bias, rows[:, part])
                value[part] = table[np.arange(len(table)), own[part]] - np.log(np.exp(table).sum(axis=1))
            value = value / np.log(10) - in_class[own]
            known = np.bincount(chunk.doc, weights=value, minlength=len(chunk.sizes))
            # Word and document of every token, sorted by word; equal pairs are one place with a count.
            key, times = np.unique(chunk.tokens.astype(np.int64) * len(chunk.sizes) + chunk.doc, return_counts=True)
            word, doc = key // len(chunk.sizes), key % len(chunk.sizes)
            ends = np.cumsum(np.bincount(word, minlength=len(chunk.words))) * 8
            places = np.column_stack((doc, times)).astype(np.int32).tobytes()
            begins = [0, *ends.tolist()]
            # Room for the task, the batch and, where sums are made, the document in one long.
            chunk_id = (task << 20) + number
            # The chunk's documents travel as one serialized batch, whatever the type of their ids.
            head = pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(chunk.sizes), pa.array(known)], names=HEAD
            )
            names = ["chunk", "word", "payload"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk_id]), pa.array([None], pa.binary()), pa.array([_to_bytes(head)], pa.binary())], names=names
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(chunk.words), chunk_id)), pa.array(chunk.words, pa.binary()),
                    pa.array([places[a:b] for a, b in zip(begins, begins[1:], strict=False)], pa.binary()),
                ],
                names=names,
            )

    chunks = rows.mapInArrow(scored, "chunk long, word binary, payload binary")
    seen = counts.select(F.col("word").alias("counted"), "n")
    # A head row has no word and the count -1.
    with_counts = chunks.join(seen, F.col("word") == F.col("counted"), "left").select(
        "chunk", "payload", F.when(F.col("word").isNull(), -1).otherwise(F.coalesce("n", F.lit(0))).alias("n")
    )

    def summed(batches):
        """Places of many words as sums per document: few rows instead of one per word."""
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        names = ["chunk", "head", "docs", "base", "known"]

        def rows():
            nonlocal size
            chunk, doc, times, count = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size = 0
            pair, at = np.unique(chunk * (1 << 20) + doc, return_inverse=True)
            base = np.bincount(at, weights=times * np.log10(count + 1))
            known = np.bincount(at, weights=times * (count > 0)).astype(np.int64)
            own = pair >> 20
            begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))).tolist()
            ends = [*begins[1:], len(own)]
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())
            docs_of = (pair & ((1 << 20) - 1)).astype(np.int32)
            columns = [pa.array(own[begins]), pa.nulls(len(begins), pa.binary()), cut(docs_of), cut(base), cut(known)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            is_head = pc.equal(batch.column(2), -1)
            heads = batch.filter(is_head)
            if heads.num_rows:
                none = pa.nulls(heads.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([heads.column(0), heads.column(1), none, none, none], names=names)
            rest = batch.filter(pc.invert(is_head))
            if not rest.num_rows:
                continue
            places = rest.column(1).to_pylist()
            each = np.fromiter(map(len, places), np.int64, len(places)) // 8
            at = np.frombuffer(b"".join(places), np.int32).reshape(-1, 2)
            held.append((np.repeat(rest.column(0).to_numpy(), each), at[:, 0], at[:, 1], np.repeat(rest.column(2).to_numpy(), each)))
            size += len(at)
            if size > PLACES:
                yield rows()
        if held:
            yield rows()

    sums = with_counts.mapInArrow(summed, "chunk long, head binary, docs binary, base binary, known binary")

    def finished(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(parts)
        head = _from_bytes(next(x for p in parts for x in p["head"] if x is not None))
        sizes = head.column("sizes").to_numpy()
        base, known = np.zeros(len(sizes)), np.zeros(len(sizes))
        for part in parts:
            for row in part[part["docs"].notna()].itertuples():
                at = np.frombuffer(row.docs, np.int32)
                base[at] += np.frombuffer(row.base)
                known[at] += np.frombuffer(row.known, np.int64)
        yield pd.DataFrame(
            {
                "doc_id": pd.Series(head.column("doc_id").to_pylist(), dtype=object),
                "held_out": head.column("held").to_pylist(),
                "n_tokens": sizes,
                "n_known": known.astype(np.int64),
                "train_tokens": n_all,
                "base_score": base - sizes * np.log10(n_all + v_all + 1),
                "score": base + head.column("partial").to_numpy(),
            }
        )

    return sums.groupBy(
        "chunk"
    ).applyInPandas(
        finished,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
