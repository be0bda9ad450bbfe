"""Token counts of byte-level BPE with a shortcut for whole tokens.

Most pieces of a text between merges (pre-tokens) are a token by themselves. Which strings of the
vocabulary are is proved once on the driver: a string qualifies if the pre-tokenizer leaves it whole
and its merges end in that one token. Counting then looks a pre-token up and merges only the rest.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.bpe import Merger
from ledgerspark.llm.common import over_texts, sent

LIMIT = 1024
# Pre-tokens whose counts a task remembers at once.
REMEMBERED = 400_000
# Longer pre-tokens are counted and forgotten.
LONG = 100

# The pattern that cuts a text before byte-level merges. {L}, {N} and {S} stand for
# letters, numbers and white space.
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
# White space is cut the same way, and what stands between is cut further on its own.
CHUNKS = r" ?[^{S}]+|[{S}]+(?![^{S}])|[{S}]+"
CLASSES = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, other bytes follow from U+0100 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes(pre_tokenizer) -> dict[str, str]:
    """Letters, numbers and white space as the tokenizer has them, as ranges for a pattern.

    Unicode grows, and libraries follow different versions of it. Where ``regex`` and Python's own
    tables agree on a known character they are believed; about every other one the tokenizer's own
    pre-tokenizer is asked: letters join ``a``, numbers join ``1``, white space joins nothing.
    """
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    sets = {k: set(regex.findall(pattern, everything)) for k, pattern in CLASSES.items()}
    for c in everything:
        own = next((k for k in CLASSES if c in sets[k]), "")
        kind = unicodedata.category(c)
        known = kind[0] if kind[0] in "LN" else "S" if c in sets["S"] else ""
        if own != known or (kind == "Cn" and own):
            joins = [k for k, x in (("L", "a"), ("N", "1"), ("", "!")) if len(pre_tokenizer.pre_tokenize_str(x + c)) == 1]
            true = joins[0] if joins else "S"
            for k in CLASSES:
                (sets[k].add if k == true else sets[k].discard)(c)
    return {k: "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in _ranges(found)) for k, found in sets.items()}


def _ranges(characters: set[str]) -> list[tuple[int, int]]:
    codes = np.array(sorted(map(ord, characters)))
    cuts = np.flatnonzero(np.diff(codes) > 1)
    return list(zip(codes[np.concatenate(([0], cuts + 1))].tolist(), codes[np.append(cuts, len(codes) - 1)].tolist(), strict=True))


class Counter:
    """Counts tokens of whole texts; everything it needs travels to the executors by value."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = {"unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout"}
        if (
            model.get("type") != "BPE"
            or pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space")
            or not pre.get("use_regex", True)
            or spec.get("normalizer")
            or model.get("ignore_merges")
            or any(model.get(k) for k in plain)
        ):
            raise ValueError("only plain byte-level BPE without a normalizer is counted here")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with stripping or word bounds are not counted here")
        vocabulary, alphabet = model["vocab"], byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.bytes = {b: vocabulary[c] for c, b in alphabet.items()}
        self.merger = Merger({(vocabulary[a], vocabulary[b]): (i, vocabulary[a + b]) for i, (a, b) in enumerate(merges)})
        self.special = [t["content"] for t in spec["added_tokens"]]
        classes = character_classes(Tokenizer.from_file(path).pre_tokenizer)
        self.pattern, self.chunks = PATTERN.format(**classes), CHUNKS.format(**classes)
        self.whole = self._proved(vocabulary, alphabet)

    def _proved(self, vocabulary: dict[str, int], alphabet: dict[str, int]) -> dict[str, int]:
        cut = re.compile(self.pattern).findall
        texts = {}
        for token, number in vocabulary.items():
            try:
                text = bytes(alphabet[c] for c in token).decode()
            except UnicodeDecodeError:
                continue  # a part of a character is never a pre-token
            if cut(text) == [text]:
                texts[text] = number
        symbols, counts = self.merged(list(texts))
        last = symbols[np.cumsum(counts) - 1]
        return {t: 1 for t, n, own, number in zip(texts, counts, last, texts.values(), strict=True) if n == 1 and own == number}

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pre-tokens, one after the other, and how many each has."""
        table = np.zeros(256, np.int32)
        table[list(self.bytes)] = list(self.bytes.values())
        data = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        return self.merger.merged(table[np.frombuffer(b"".join(data), np.uint8)], lengths)

    def counting(self):
        """A function from a batch of texts to their numbers of tokens, with the cache of one task."""
        cut, chunks = re.compile(self.pattern).findall, re.compile(self.chunks).findall
        special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        known = dict(self.whole)

        def fresh(chunk_list: list[str]) -> dict[str, int]:
            """Counts of chunks not known: whole pre-tokens count one, the rest is merged."""
            cuts = list(map(cut, chunk_list))
            whole = self.whole
            rest = list({p for pieces in cuts for p in pieces if p not in whole})
            merged = dict(zip(rest, self.merged(rest)[1].tolist(), strict=True))
            merged.update(whole)
            return {c: sum(map(merged.__getitem__, pieces)) for c, pieces in zip(chunk_list, cuts, strict=True)}

        def count(texts: list[str]) -> list[int]:
            if len(known) > REMEMBERED:
                known.clear()
                known.update(self.whole)
            cuts, extra = [], []
            for text in texts:
                parts = special.split(text) if special else [text]
                extra.append(len(parts) - 1)
                cuts.append(chunks(text) if len(parts) == 1 else list(chain.from_iterable(map(chunks, parts))))
            own = fresh([c for c in set(chain.from_iterable(cuts)) if c not in known])
            known.update((c, n) for c, n in own.items() if len(c) <= LONG)
            long = {c: n for c, n in own.items() if len(c) > LONG}
            get = (lambda c: long[c] if len(c) > LONG else known[c]) if long else known.__getitem__
            return [n + sum(map(get, pieces)) for n, pieces in zip(extra, cuts, strict=True)]

        return count


def token_counts(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Tokens are those of the ``tokenizers`` library for the file at ``tokenizer``, without added
    begin or end tokens; a special string inside a text is its one token, as the library has it.
    NULL counts as empty, empty texts have no tokens, equal rows stay as many rows, and an empty
    table gives none. The vocabulary is read on the driver only and has a fixed size.
    """
    shared = sent(docs.sparkSession, Counter(tokenizer))

    def make():
        count = shared().counting()

        def added(texts: list[bytes]) -> list[pa.Array]:
            counts = count([t.decode("utf-8", "replace") for t in texts])
            return [pa.array(list(map(len, texts)), pa.int64()), pa.array(counts, pa.int64())]

        return added

    counted = over_texts(docs, doc_id, text, make, "n_bytes long, n_tokens long")
    return counted.drop("text_key").withColumn("over_limit", F.col("n_tokens") > limit)
