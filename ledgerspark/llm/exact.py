"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of a text is a polynomial of its bytes for two primes, and its length. A text is
hashed in chunks; two neighbours combine as ``left * base ** len(right) + right``, so chunks of a
huge text can be hashed apart and in any grouping. Equal fingerprints only nominate: the texts of
every nominated group are then compared chunk by chunk, and groups that turn out mixed are told
apart by their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import only_staying, over_texts, slices, text_or_empty
from ledgerspark.session import lookup_side, store

WHITE = b" \t\n\x0b\x0c\r"
# A byte pair is below 2**23 and a power below 2**31: sums of 256 products stay below 2**63.
PRIMES = (2147483647, 2147483629)
BASES = (32749, 32719)
SUMMED = 256
CHUNK = 65_536
KEYS = ("fp_a", "fp_b", "n_bytes")


class Fingerprint:
    """Hashes of chunks and their composition, for one pair of primes."""

    def __init__(self, primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES, chunk: int = CHUNK):
        self.primes, self.bases, self.chunk = primes, bases, chunk
        # Powers for byte pairs, highest first: a chunk of an even number of bytes is base ** 2 apart.
        self.powers = []
        for prime, base in zip(primes, bases, strict=True):
            step, powers = base * base % prime, [1]
            for _ in range((chunk + 1) // 2 - 1):
                powers.append(powers[-1] * step % prime)
            self.powers.append(np.array(powers[::-1], np.int64))

    def of_chunk(self, part: bytes) -> tuple[int, int]:
        """The polynomials of at most ``chunk`` bytes."""
        n = len(part)
        pairs = np.frombuffer(part, np.uint8, n - n % 2).reshape(-1, 2)
        found = []
        for prime, base, powers in zip(self.primes, self.bases, self.powers, strict=True):
            words = pairs[:, 0].astype(np.int64) * base + pairs[:, 1]
            words *= powers[len(powers) - len(words) :]
            sums = np.add.reduceat(words, np.arange(0, len(words), SUMMED)) if n > 1 else words
            value = int((sums % prime).sum()) % prime
            found.append((value * base + part[-1]) % prime if n % 2 else value)
        return found[0], found[1]

    def join(self, left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
        """The polynomials of two texts one after the other."""
        a, b = (
            (x * pow(base, right_bytes, prime) + y) % prime
            for x, y, base, prime in zip(left, right, self.bases, self.primes, strict=True)
        )
        return a, b

    def of(self, text: bytes) -> tuple[int, int]:
        whole = (0, 0)
        for at in range(0, len(text), self.chunk):
            part = text[at : at + self.chunk]
            whole = self.join(whole, self.of_chunk(part), len(part))
        return whole


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def fingerprints(docs: DataFrame, doc_id: str, text: str, scheme: tuple = (PRIMES, BASES, CHUNK)) -> DataFrame:
    """One row per document: id, key, fingerprint, bytes and SHA-256 of the text without white space."""

    def make():
        of = Fingerprint(*scheme).of

        def added(texts: list[bytes]) -> list[pa.Array]:
            bare = [t.translate(None, WHITE) for t in texts]
            prints = [of(t) for t in bare]
            return [
                pa.array([p[0] for p in prints], pa.int64()),
                pa.array([p[1] for p in prints], pa.int64()),
                pa.array([len(t) for t in bare], pa.int64()),
                pa.array([code_points(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in bare], pa.string()),
            ]

        return added

    return over_texts(docs, doc_id, text, make, "fp_a long, fp_b long, n_bytes long, n_chars long, sha string")


def mixed_groups(docs: DataFrame, nominated: DataFrame, text: str, scheme: tuple) -> DataFrame:
    """Fingerprints of ``nominated`` under which texts differ: ``fp_a, fp_b, n_bytes``.

    Every text of a nominated group is cut into chunks, and equal chunks at one place collapse
    before the shuffle, so a group of any number of copies sends each chunk once per task.
    """
    chunk = scheme[2]
    rows = docs.select(text_or_empty(text).alias("text"))

    def cut(batches):
        of = Fingerprint(*scheme).of
        for batch in (part for whole in batches for part in slices(whole, 0)):
            bare = [t.translate(None, WHITE) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            prints = [of(t) for t in bare]
            columns = [[p[0] for p in prints], [p[1] for p in prints], [len(t) for t in bare]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array(bare, pa.binary())], names=[*KEYS, "bare"]
            )

    named = nominated.select(*[F.col(k).alias(f"{k}_n") for k in KEYS])
    bare = rows.mapInArrow(cut, "fp_a long, fp_b long, n_bytes long, bare binary")
    chosen = bare.join(named, [F.col(k) == F.col(f"{k}_n") for k in KEYS])
    at = F.explode(F.expr(f"sequence(0L, greatest(n_bytes - 1, 0L), {chunk}L)"))
    chunks = chosen.select(*KEYS, "bare", at.alias("at")).select(
        *KEYS, "at", F.expr(f"substring(bare, cast(at as int) + 1, {chunk})").alias("part")
    )
    return (
        chunks.distinct()
        .groupBy(*KEYS, "at")
        .agg(F.count(F.lit(1)).alias("texts"))
        .where(F.col("texts") > 1)
        .select(*KEYS)
        .distinct()
    )


def told_apart(docs: DataFrame, mixed: DataFrame, doc_id: str, text: str, scheme: tuple) -> DataFrame:
    """Rows of mixed fingerprints with the text itself as a further key."""
    spark = docs.sparkSession
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))

    def bare(batches):
        of = Fingerprint(*scheme).of
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            bare = [t.translate(None, WHITE) for t in texts]
            prints = [of(t) for t in bare]
            columns = [[p[0] for p in prints], [p[1] for p in prints], [len(t) for t in bare]]
            columns.append([code_points(t) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(bare, pa.binary())],
                names=["doc_id", *KEYS, "n_chars", "bare"],
            )

    named = mixed.select(*[F.col(k).alias(f"{k}_n") for k in KEYS])
    return rows.mapInArrow(
        bare, f"doc_id {kind}, fp_a long, fp_b long, n_bytes long, n_chars long, bare binary"
    ).join(named, [F.col(k) == F.col(f"{k}_n") for k in KEYS])


def _best(order_id: str = "doc_id"):
    """The row that stays: most code points, then the smallest id; a row without id comes last."""
    return F.min(
        F.struct((-F.col("n_chars")).alias("chars"), F.col(order_id).isNull().alias("no_id"), F.col(order_id).alias("id"))
    )


def copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scheme: tuple = (PRIMES, BASES, CHUNK)
) -> DataFrame:
    """One row per document with its group of equal texts.

    Columns ``doc_id, text_key, keep_id, group_size, kept, text_sha256``. Texts are equal when they agree
    after white space is deleted; NULL counts as empty. The row with the most code points stays,
    then the smallest id (NULL last). Rows that agree in id, length and group are one document
    more than once: exactly one of them is kept. An empty table gives no rows.
    """
    rows = store(
        fingerprints(docs, doc_id, text, scheme).select("*", F.monotonically_increasing_id().alias("row")), "prints"
    )
    sizes = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("group_size"), _best().alias("best"))
    groups = lookup_side(sizes.where(F.col("group_size") > 1))
    mixed = lookup_side(mixed_groups(docs, groups, text, scheme))
    plain = _marked(rows, groups, [*KEYS])
    if mixed.isEmpty():
        return plain
    # A fingerprint shared by different texts: the text's digest separates the rows, and the
    # digests of a group are as many as its texts, which is checked.
    named = mixed.select(*[F.col(k).alias(f"{k}_m") for k in KEYS])
    same = [F.col(k) == F.col(f"{k}_m") for k in KEYS]
    apart = told_apart(docs, mixed, doc_id, text, scheme)
    texts = apart.groupBy(*KEYS, "bare").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("best"))
    by_text = lookup_side(
        texts.select(*KEYS, "group_size", "best", F.sha2("bare", 256).alias("sha"))
    )
    if by_text.count() != by_text.select(*KEYS, "sha").distinct().count():
        raise ValueError("different texts share a SHA-256 digest")
    own = rows.join(named, same, "left_semi")
    return _marked(rows.join(named, same, "left_anti"), groups, [*KEYS]).unionByName(
        _marked(own, by_text.where(F.col("group_size") > 1), [*KEYS, "sha"])
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``copies`` keeps, all columns unchanged, whatever their names."""
    decided = copies(docs, doc_id, text).select("doc_id", "text_key", F.col("kept").alias("stays"))
    return only_staying(docs, decided, doc_id, text)


def _marked(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what their group says; a row in no group stands alone."""
    named = groups.select(*[F.col(k).alias(f"{k}_g") for k in keys], "group_size", "best")
    joined = rows.join(named, [F.col(k) == F.col(f"{k}_g") for k in keys], "left")
    alone = F.col("best").isNull()
    first = ~alone & (F.col("best.chars") == -F.col("n_chars")) & F.col("best.id").eqNullSafe(F.col("doc_id"))
    # Of rows that tie for the place, the first written one; ties are few or equal rows.
    tied = lookup_side(
        joined.where(first).groupBy(*[F.col(k).alias(f"{k}_t") for k in keys]).agg(F.min("row").alias("stays"))
    )
    return (
        joined.join(tied, [F.col(k) == F.col(f"{k}_t") for k in keys], "left")
        .select(
            "doc_id",
            "text_key",
            F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (alone | F.coalesce(F.col("row") == F.col("stays"), F.lit(False))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
