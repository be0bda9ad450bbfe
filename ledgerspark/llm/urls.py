"""URL filters: longest fitting rule, else exact membership by a cascade of Bloom filters.

The cascade is built over all keys that the corpus has. Its first level holds the listed keys; its
second the other keys that pass the first; its third the listed keys that pass the second, and so
on until nothing passes wrongly. Over those keys the answer is exact: a key is listed if the first
level that refuses it is an even one (counting from one). Rows are judged by looking at bits, so
the pages are neither joined nor shuffled.

A level is an array of bit words that Spark computes and hands to the scan as a scalar subquery.
The words of all levels are bounded by ``MAX_WORDS``; beyond that the listed keys are matched by a
join, which Spark may shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.session import settle

BITS_PER_KEY = 10
HASHES = 4
# 16 MB of bits.
MAX_WORDS = 2_000_000


@dataclass(frozen=True)
class UrlRule:
    """A rule fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
# A host is listed if one of these words is a part of its name.
LISTED_PARTS = ("spam", "casino", "porn", "xxx", "adult", "warez", "viagra")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str = "url") -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: str = "url") -> Column:
    """What follows the host up to ``? #``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The fitting rule with the longest host, then the longest path, as a struct or NULL."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        best = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(best)
    return best


def _places(key: Column, level: int, size: int) -> list[Column]:
    """Bits of a key in a level of ``size`` words."""
    return [F.pmod(F.xxhash64(key, F.lit(HASHES * level + i)), F.lit(size * 64)) for i in range(HASHES)]


@dataclass
class Cascade:
    """Levels of bit words; ``holds`` says whether a key of the universe is listed."""

    levels: list[tuple[DataFrame, int]]

    def words(self) -> int:
        return sum(size for _, size in self.levels)

    def holds(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            answer = F.when(_passes(key, level, *self.levels[level]), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def _level(keys: DataFrame, level: int, size: int) -> DataFrame:
    """One row, one array: the bit words of a level."""
    places = F.explode(F.array(*_places(F.col("key"), level, size)))
    words = (
        keys.select(places.alias("bit"))
        .groupBy(F.shiftright("bit", 6).cast("int").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    )
    # Words without a bit are filled in by a join, so that building takes time in proportion to the words.
    every = keys.sparkSession.range(size).select(F.col("id").cast("int").alias("place"))
    filled = every.join(words, F.col("place") == F.col("at"), "left").select(
        F.struct("place", F.coalesce("word", F.lit(0).cast("long")).alias("word")).alias("w")
    )
    return settle(filled.agg(F.sort_array(F.collect_list("w")).alias("ws")).select(F.col("ws.word").alias("bits")))


def _passes(key: Column, level: int, words: DataFrame, size: int) -> Column:
    bits = words.scalar()
    found = None
    for bit in _places(key, level, size):
        word = F.get(bits, F.shiftright(bit, 6).cast("int"))
        hit = F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1
        found = hit if found is None else found & hit
    return found


def build_cascade(universe: DataFrame, max_words: int = MAX_WORDS) -> Cascade | None:
    """The cascade for ``universe(key, listed)``, one row per key; None if it would be too large.

    Each level sees only keys that passed all levels before, so levels shrink quickly. Keys are
    never NULL.
    """
    keys = settle(universe)
    levels: list[tuple[DataFrame, int]] = []
    while True:
        inside = F.col("listed") == F.lit(len(levels) % 2 == 0)
        counts = keys.agg(F.count_if(inside).alias("held"), F.count_if(~inside).alias("others")).first()
        if not counts.held:
            # Nothing to encode: what passed so far is right.
            break
        size = max(1, -(-counts.held * BITS_PER_KEY // 64))
        if size + sum(n for _, n in levels) > max_words:
            return None
        words = _level(keys.where(inside), len(levels), size)
        levels.append((words, size))
        if not counts.others:
            break
        keys = settle(keys.where(inside | _passes(F.col("key"), len(levels) - 1, words, size)))
        if not keys.where(~inside).limit(1).count():
            break
    return Cascade(levels)


def judge(
    pages: DataFrame,
    rules: tuple[UrlRule, ...] = RULES,
    parts: tuple[str, ...] = LISTED_PARTS,
    page_id: str = "page_id",
    url: str = "url",
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, listed``.

    The verdict is that of the longest fitting rule. Where none fits, ``block`` if the host is a
    listed one, else ``allow``. Listed are the hosts of the corpus with one of ``parts`` in their
    name. NULL and urls without ``://`` have an empty host and path, fit no rule and are allowed.
    Equal rows stay as many rows; an empty table gives none. Only the id and the url are read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    universe = rows.select(F.col("host").alias("key")).distinct().select(
        "key", F.coalesce(F.col("key").rlike("|".join(parts)), F.lit(False)).alias("listed")
    )
    cascade = build_cascade(universe, max_words)
    if cascade is None:
        listed = universe.where("listed").select(F.col("key").alias("listed_key"))
        marked = rows.join(listed, F.col("host") == F.col("listed_key"), "left").select(
            *rows.columns, F.col("listed_key").isNotNull().alias("listed")
        )
    else:
        marked = rows.withColumn("listed", cascade.holds(F.col("host")))
    best = longest_rule(F.col("host"), F.col("path"), rules)
    return marked.withColumn("best", best).select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed",
    )
