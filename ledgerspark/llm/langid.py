"""Language identification by nearest centroids.

A text is a vector of hashed character n-grams over its letters, weighted by TF-IDF and of length one.
Every language has several centroids, found by clustering its vectors by cosine, since texts of one
language differ in kind. A text gets the language of the centroid nearest by cosine. Each centroid also
has a radius, the distance that few of its own training texts exceed; a text outside the radius of the
centroid nearest to it is marked as rejected.

Document frequencies are counted over all training documents. Clusters are fitted on a bounded sample of
each language, ``sample`` rows about, in one task per language; scoring is one pass over the texts.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import sent, slices, text_or_empty
from ledgerspark.session import lookup_side, store

MOD, HELD_OUT = 5, 0
# What a text without a letter gets, and any text where no language was learned.
UNKNOWN = "und"
# Places of hashed n-grams. Runs of up to three letters of a script are a bounded set, whatever the corpus.
DIMENSIONS = 1 << 14
CENTROIDS = 4
# Rows of one language that its clusters are fitted on, about.
SAMPLE = 1024
STEPS = 8
# A cluster of a smaller share of the sample is no kind of text of its own but a few wrong labels.
LEAST_SHARE = 0.02
# Share of a centroid's training texts that lie inside its radius, and the smallest radius.
INSIDE, LEAST_RADIUS = 0.995, 0.05
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SHIFT = np.uint64(64 - 14)


def letter_table() -> np.ndarray:
    """For every code point its lower case if that is one letter, and a space if it is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    letters = np.flatnonzero(np.fromiter(map(str.isalpha, map(chr, range(len(out)))), bool, len(out)))
    lower = [chr(code).lower() for code in letters.tolist()]
    out[letters] = [ord(low) if len(low) == 1 else code for code, low in zip(letters.tolist(), lower, strict=True)]
    return out


def grams(text: bytes, table: np.ndarray) -> np.ndarray:
    """Places of the one, two and three letter n-grams of a UTF-8 text; a word begins and ends with a space."""
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    padded = np.full(len(codes) + 2, 32, np.uint64)
    padded[1:-1] = table[codes]
    # A run of spaces counts as one.
    space = padded == 32
    padded = padded[~(space & np.concatenate(([False], space[:-1])))]
    if len(padded) < 3:
        return np.empty(0, np.int64)
    one = padded * _FACTORS[0]
    two = (one[:-1] ^ (padded[1:] * _FACTORS[1])) * _FACTORS[2]
    three = (two[:-1] ^ (padded[2:] * _FACTORS[0])) * _FACTORS[1]
    return np.concatenate([(x >> _SHIFT).astype(np.int64) for x in (one[1:-1], two, three)])


def frequencies(text: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that a text has, ascending, and the damped frequency of each."""
    count = np.bincount(grams(text, table), minlength=DIMENSIONS)
    at = np.flatnonzero(count)
    return at, 1 + np.log(count[at])


def unit(at: np.ndarray, value: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of a text, of length one."""
    value = value * idf[at]
    return value / max(float(np.sqrt(value @ value)), 1e-12)


def cluster(vectors: np.ndarray, count: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids by cosine and the radius of each; the same rows in one order give the same centroids.

    Starts are spread: each next one is the vector farthest from the starts before it. Clusters of less
    than ``LEAST_SHARE`` are given up, the largest is kept in any case.
    """
    starts = [0]
    near = vectors @ vectors[0]
    while len(starts) < min(count, len(vectors)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-6:
            break
        starts.append(far)
        near = np.maximum(near, vectors @ vectors[far])
    centroids = vectors[starts]
    for _ in range(steps):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) for c in range(len(centroids))])
        length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-12), centroids)
    sizes = np.bincount((vectors @ centroids.T).argmax(axis=1), minlength=len(centroids))
    centroids = centroids[(sizes >= LEAST_SHARE * len(vectors)) | (sizes == sizes.max())]
    similar = vectors @ centroids.T
    own, most = similar.argmax(axis=1), similar.max(axis=1)
    radius = [
        max(LEAST_RADIUS, float(np.quantile(1 - most[own == c], INSIDE))) if (own == c).any() else LEAST_RADIUS
        for c in range(len(centroids))
    ]
    return centroids, np.array(radius)


def is_held_out(doc_id: str) -> Column:
    """Whether a document is not learned from: by crc32 of its id as text; NULL as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % MOD == HELD_OUT


class Model:
    """Inverse document frequencies, and per centroid its language, vector and radius."""

    def __init__(self, idf: np.ndarray, names: list[str], centroids: np.ndarray, radius: np.ndarray):
        self.idf, self.names, self.radius = idf, names, radius
        # One line per place, so that a text reads the lines of its places only.
        self.by_place = np.ascontiguousarray(centroids.T.astype(np.float32))

    def nearest(self, text: bytes, table: np.ndarray) -> tuple[str, float, bool]:
        """Language, cosine and whether the text lies outside the radius of its centroid."""
        at, value = frequencies(text, table)
        if not len(at) or not self.names:
            return UNKNOWN, 0.0, True
        similar = unit(at, value, self.idf).astype(np.float32) @ self.by_place[at]
        best = int(similar.argmax())
        score = min(1.0, max(0.0, float(similar[best])))
        return self.names[best], score, 1 - score > self.radius[best]


def _document_frequencies(training: DataFrame) -> tuple[int, np.ndarray]:
    """Documents in all and with each place; tasks pass on one row per place."""

    def run(batches):
        table, total, rows = letter_table(), np.zeros(DIMENSIONS, np.int64), 0
        for whole in batches:
            for batch in slices(whole, 0):
                for text in batch.column(0).cast(pa.binary()).to_pylist():
                    total[np.unique(grams(text, table))] += 1
                rows += batch.num_rows
        used = np.flatnonzero(total)
        places, counts = np.append(used, -1), np.append(total[used], rows)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(counts)], names=["place", "n"])

    sums = training.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = sums.column("place").to_numpy(), sums.column("n").to_numpy()
    out = np.zeros(DIMENSIONS, np.int64)
    out[place[place >= 0]] = n[place >= 0]
    return int(n[place == -1].sum()), out


def train(training: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """The model of rows ``doc_id, text, lang`` without NULL texts or languages.

    Rows are drawn by a hash of id and text, so many copies of one text are drawn as often as others.
    """
    spark = training.sparkSession
    lettered = training.where(F.col("text").rlike(r"\p{L}"))
    rows, df = _document_frequencies(lettered)
    idf = np.log((1 + rows) / (1 + df)) + 1
    sizes = lettered.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    shares = lookup_side(sizes.select(F.col("lang").alias("of"), (F.lit(float(sample)) / F.col("size")).alias("share")))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = lettered.join(shares, F.col("lang") == F.col("of")).where(drawn < F.col("share"))
    shared_idf = sent(spark, idf)

    def vectors(batches):
        table, idf = letter_table(), shared_idf()
        for whole in batches:
            for batch in slices(whole, 1):
                places, values = [], []
                for text in batch.column(1).cast(pa.binary()).to_pylist():
                    at, value = frequencies(text, table)
                    places.append(at.astype(np.int32).tobytes())
                    values.append(unit(at, value, idf).astype(np.float32).tobytes())
                columns = [batch.column(0), pa.array(places, pa.binary()), pa.array(values, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "places", "vals"])

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["places", "vals"])
        dense = np.zeros((len(part), DIMENSIONS), np.float32)
        for line, places, values in zip(dense, part["places"], part["vals"], strict=True):
            line[np.frombuffer(places, np.int32)] = np.frombuffer(values, np.float32)
        found, radius = cluster(dense, centroids)
        return pd.DataFrame(
            {"lang": part["lang"].iloc[0], "place": range(len(found)), "radius": radius, "vector": [x.tobytes() for x in found]}
        )

    made = (
        chosen.select("lang", "text").mapInArrow(vectors, "lang string, places binary, vals binary")
        .groupBy("lang").applyInPandas(fitted, "lang string, place int, radius double, vector binary")
    )
    found = store(made, "centroids").orderBy("lang", "place").toArrow()
    table = [np.frombuffer(x, np.float32) for x in found.column("vector").to_pylist()]
    stacked = np.stack(table) if table else np.empty((0, DIMENSIONS), np.float32)
    return Model(idf, found.column("lang").to_pylist(), stacked, found.column("radius").to_numpy())


def languages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    centroids: int = CENTROIDS, sample: int = SAMPLE,
) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, rejected``.

    ``score`` is the cosine with the nearest centroid, ``rejected`` tells that this is farther than
    training texts of that centroid lie. NULL texts and texts without a letter are ``und`` with score 0;
    so is every text where nothing could be learned (no language given, or an empty table, which gives
    no rows). Only text and language of documents that are not held out are learned from, and only the
    text is looked at to predict. Equal rows stay as many rows; of equally near centroids the first
    language by code point wins. Other columns of ``docs`` do not matter.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    training = rows.where("text is not null and lang is not null").where(~is_held_out("doc_id"))
    model = sent(docs.sparkSession, train(training, centroids, sample))
    kind = rows.schema["doc_id"].dataType.simpleString()
    asked = rows.select(
        "doc_id", is_held_out("doc_id").alias("held_out"), text_or_empty("text").alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )

    def run(batches):
        table, own = letter_table(), model()
        for whole in batches:
            for batch in slices(whole, 2):
                texts, lettered = batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()
                found = [own.nearest(t, table) if has else (UNKNOWN, 0.0, True) for t, has in zip(texts, lettered, strict=True)]
                names, scores, rejected = zip(*found, strict=True)
                columns = [batch.column(0), batch.column(1), pa.array(names), pa.array(scores), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return asked.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
