"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

The new words of a batch are merged together in flat arrays (see ``bpe``). Words are independent
only if no piece holds a space mark after another character; that is checked on the vocabulary, and
where it does not hold a whole text is one word.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerspark.llm.bpe import Merger
from ledgerspark.llm.common import over_texts, sent

SPACE = "▁"
# Words whose pieces a task remembers at once, and the longest that it remembers.
REMEMBERED = 300_000
LONG = 64
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """Field numbers and values of a serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = varint() if wire == 2 else 8 if wire == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """Tables of one model; made on the driver and sent to the executors by value."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                score = np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]
                pieces.append((piece[1].decode(), float(score), piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        kinds = {kind for _, _, kind in pieces}
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only BPE models with byte fallback and leading space marks are encoded here")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("normalization tables, white-space removal, user-defined and unused pieces are not supported")
        self.dummy = bool(normalizer.get(3, 1))
        self.end = next(i for i, (p, _, kind) in enumerate(pieces) if kind == CONTROL and p == (trainer.get(47, b"</s>").decode()))
        self.count = len(pieces)
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        # What decoding writes for an id; byte pieces write their byte, control pieces nothing.
        unknown = trainer.get(44, " ⁇ ".encode())
        self.bytes = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else unknown if kind == UNKNOWN
            else p.replace(SPACE, " ").encode()
            for p, _, kind in pieces
        ]
        self.is_byte = [kind == BYTE for _, _, kind in pieces]
        self.is_normal = [kind == NORMAL for _, _, kind in pieces]
        # Characters inside pieces that are no pieces themselves are symbols beyond the ids.
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, self.count + len(symbols))
        self.characters = {c: i for c, i in symbols.items() if len(c) == 1}
        self.words_split = not any(SPACE in p.lstrip(SPACE) for p in normal)
        scores = sorted({pieces[i][1] for i in normal.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        shared = Counter(pieces[i][1] for i in normal.values())
        # Pieces that share a score compete by place alone, so they must not merge in bulk.
        unsafe = {rank_of[score] for score, n in shared.items() if n > 1}
        pairs = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if a in symbols and b in symbols:
                    pairs[symbols[a], symbols[b]] = (rank_of[pieces[i][1]], i)
        self.merger = Merger(pairs, unsafe)
        self.table = None

    def _symbols(self) -> np.ndarray:
        """Symbol by code point; a character without one keeps its code point, as a negative number."""
        if self.table is None:
            self.table = -1 - np.arange(0x110000, dtype=np.int32)
            for c, i in self.characters.items():
                self.table[ord(c)] = i
        return self.table

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of each word as 32-bit integers, all words merged together."""
        if not words:
            return []
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols, counts = self.merger.merged(self._symbols()[codes], lengths)
        rest = np.flatnonzero((symbols < 0) | (symbols >= self.count))
        if len(rest):
            # Characters that are no piece become the pieces of their bytes.
            names = {i: c for c, i in self.characters.items() if i >= self.count}
            word = np.repeat(np.arange(len(words)), counts)
            spelled = [[self.byte_ids[b] for b in (names[i] if i >= 0 else chr(-1 - i)).encode()] for i in symbols[rest].tolist()]
            sizes = np.ones(len(symbols), np.int64)
            sizes[rest] = list(map(len, spelled))
            at = np.cumsum(sizes) - sizes
            ids = np.repeat(symbols, sizes)
            for begin, own in zip(at[rest].tolist(), spelled, strict=True):
                ids[begin : begin + len(own)] = own
            symbols, counts = ids, np.bincount(np.repeat(word, sizes), minlength=len(words))
        data = symbols.astype(np.int32).tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        return [data[begin:end] for begin, end in zip([0, *ends], ends, strict=False)]

    def encoder(self):
        """A function from a batch of texts to their ids as arrays, with the word cache of one task."""
        cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if self.words_split else lambda text: [text]
        known: dict[str, bytes] = {}

        def encode(texts: list[str]) -> list[np.ndarray]:
            if len(known) > REMEMBERED:
                known.clear()
            batch = [
                cut((SPACE if self.dummy else "") + text.replace(" ", SPACE)) if text else [] for text in texts
            ]
            new = [w for w in set(chain.from_iterable(batch)) if w not in known]
            own = dict(zip(new, self.merged(new), strict=True))
            known.update((w, ids) for w, ids in own.items() if len(w) <= LONG)
            long = {w: ids for w, ids in own.items() if len(w) > LONG}
            get = (lambda w: long[w] if len(w) > LONG else known[w]) if long else known.__getitem__
            return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in batch]

        return encode

    def decode(self, ids: list[int]) -> str:
        """The text of ids. A byte that is no part of a character becomes U+FFFD."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self._decode_bytewise(ids)
        # The space mark that encoding put first is taken off again.
        first = next((i for i in ids if self.bytes[i]), None)
        strip = self.dummy and first is not None and self.is_normal[first] and text.startswith(" ")
        return text[1:] if strip else text

    def _decode_bytewise(self, ids: list[int]) -> str:
        parts, run = [], bytearray()

        def flush() -> None:
            while run:
                for size in range(min(4, len(run)), 0, -1):
                    try:
                        c = bytes(run[:size]).decode()
                    except UnicodeDecodeError:
                        continue
                    if len(c) == 1:
                        parts.append(c)
                        del run[:size]
                        break
                else:
                    parts.append("�")
                    del run[:1]

        for i in ids:
            if self.is_byte[i]:
                run += self.bytes[i]
            else:
                flush()
                parts.append(self.bytes[i].decode())
        flush()
        return "".join(parts)


def encoded(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` and ``decoded``, the text that the ids give back.

    Ids are those of the sentencepiece library for the BPE model at ``model``, without sampling,
    followed by the end id if ``end``. NULL counts as empty; an empty text has the end id only.
    Equal rows stay as many rows; an empty table gives none. Other columns are not looked at.
    """
    shared = sent(docs.sparkSession, Pieces(model))

    def make():
        pieces = shared()
        encode = pieces.encoder()
        tail = [pieces.end] if end else []

        def added(texts: list[bytes]) -> list[pa.Array]:
            ids = [x.tolist() + tail for x in encode([t.decode("utf-8", "replace") for t in texts])]
            return [pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(pieces.decode, ids)), pa.string())]

        return added

    return over_texts(docs, doc_id, text, make, "ids array<int>, decoded string").drop("text_key")


def encoding_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: what ``encoded`` gives, digested in place.

    Same cases as ``encoded``; ids and texts never leave the task that made them.
    """
    shared = sent(docs.sparkSession, Pieces(model))

    def make():
        pieces = shared()
        encode = pieces.encoder()
        names = list(map(str, range(pieces.count)))
        digest = lambda data: hashlib.sha256(data).hexdigest()

        def added(texts: list[bytes]) -> list[pa.Array]:
            ids = [[*x.tolist(), pieces.end] for x in encode([t.decode("utf-8", "replace") for t in texts])]
            return [
                pa.array(list(map(len, ids)), pa.int64()),
                pa.array([digest(" ".join(map(names.__getitem__, x)).encode()) for x in ids], pa.string()),
                pa.array([digest(pieces.decode(x).encode()) for x in ids], pa.string()),
            ]

        return added

    return over_texts(docs, doc_id, text, make, "n_tokens long, ids_sha256 string, decoded_sha256 string").drop("text_key")
