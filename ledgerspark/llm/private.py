"""Personal data by seeds and by the contexts that seeds teach.

Seeds are what four strict patterns find: emails, IPv4 addresses, card numbers that pass Luhn's test
and international phone numbers. What stands around a find are its lexical patterns: the word before it,
the two words before it, and the word behind it. Looser strings that could be personal data are
candidates; together with the seeds they form a graph of patterns and instances, whose scores Spark refines
in turn: a pattern is as good as the instances in its slot, an instance as good as the best pattern around
it. Instances that are believed by then teach further patterns, so the graph is followed beyond the
patterns of the seeds. Candidates in the slot of a good pattern become spans.

Everything is DataFrame work. One scan of the texts leaves a thin table of finds; positions, scores
and spans come from that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import text_or_empty
from ledgerspark.session import lookup_side, settle, store

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+\-]"
# The contract's patterns. Possessive repeats and the look behind change no match: they keep long
# runs of one class from being tried at every place. \G lets a match begin where the last one ended.
STRICT = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20\-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
# Candidates: what looks like an address or a number but need not be one.
LOOSE = {
    "mail": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++(?:@|[\[(]at[\])])[A-Za-z0-9\-]++(?:(?:\.|[\[(]dot[\])])[A-Za-z0-9\-]++)*+",
    "number": r"(?:(?<![0-9A-Za-z])|\G)[0-9]++(?:[\x20().\-]{1,2}+[0-9]++)++",
}
NEEDS = {"email": "@", "mail": "[@(\\[]", "phone": "\\+[0-9]", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20\\-]?[0-9]", "number": "[0-9]"}
_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
# What stands before a find, read backwards: what is attached to it and two words. The same once more with
# one word; and forwards what is attached behind it and the next word.
TWO_BACK = rf"^{_WORD}*+(?:{_SPACE}++{_WORD}++){{2}}"
ONE_BACK = rf"^{_WORD}*+{_SPACE}++{_WORD}++"
ONE_AHEAD = ONE_BACK
# Longer contexts are known by their hash.
LONG_CONTEXT = 64
ROUNDS = 5
# A pattern is good from this share of believed slots on, after the last round.
CONFIDENCE = 0.9
# Different instances that a pattern needs, and the score from which an instance counts as one.
SUPPORT, BELIEVED = 3, 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled; the digits of all sum to a multiple of ten."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def _sound(kind: Column, text: Column) -> Column:
    """Whether a match of a strict pattern is a find."""
    digits = _digits(text)
    n = F.length(digits)
    parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    in_range = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (
        F.when(kind == "ip", in_range)
        .when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def _could_be(kind: str, form: Column, text: Column) -> Column:
    """Whether a loose find has the shape of a kind."""
    n = F.length(_digits(text))
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return {
        "email": form == "mail",
        "ip": (form == "number") & (dots == 3) & n.between(4, 12),
        "card": (form == "number") & n.between(13, 19),
        "phone": (form == "number") & n.between(7, 15),
    }[kind]


def _context(text: Column, mark: str) -> Column:
    """A context as a pattern: its words in lower case; NULL where there is none."""
    words = F.lower(F.trim(F.regexp_replace(text, rf"{_SPACE}+", " ")))
    short = F.when(F.length(words) <= LONG_CONTEXT, words).otherwise(F.concat(F.lit("#"), F.sha2(words, 256)))
    return F.when(text != "", F.concat(F.lit(mark), short))


def _before(gap: Column) -> Column:
    """Patterns of the words before a find. Read backwards, so that only the end of a gap is looked at."""
    back = F.reverse(gap)
    one, two = (F.reverse(F.regexp_extract(back, p, 0)) for p in (ONE_BACK, TWO_BACK))
    return F.struct(_context(one, "1 ").alias("one"), _context(two, "2 ").alias("two"))


def _behind(gap: Column) -> Column:
    return _context(F.regexp_extract(gap, ONE_AHEAD, 0), "> ")


def _finds(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: its id, a row number and, per pattern with matches, what it matched.

    A text is the matches of a pattern with gaps between; the lengths of both give the positions.
    """
    patterns = STRICT | LOOSE
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")
    )
    matched = rows.select(
        "*",
        *[
            F.when(F.col("text").rlike(NEEDS[k]), F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"m_{k}")
            for k, p in patterns.items()
        ],
    )
    gaps = matched.select(
        "row",
        "doc_id",
        *[f"m_{k}" for k in patterns],
        *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"g_{k}") for k, p in patterns.items()],
    )
    found = [
        F.when(
            F.col(f"g_{k}").isNotNull(),
            F.struct(
                F.lit(k).alias("form"),
                F.zip_with(
                    F.slice(F.col(f"g_{k}"), 1, F.size(f"m_{k}")),
                    f"m_{k}",
                    lambda g, m: F.struct(F.length(g).alias("gap"), _before(g).alias("before"), m.alias("text")),
                ).alias("matches"),
                # What stands behind a match is the next gap.
                F.transform(F.slice(F.col(f"g_{k}"), 2, F.size(f"m_{k}")), _behind).alias("behind"),
            ),
        )
        for k in patterns
    ]
    return store(gaps.select("row", "doc_id", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("found")), "finds")


def _placed(finds: DataFrame) -> DataFrame:
    """Matches with their places: ``row, form, start, end, text, one, two, behind``."""
    each = finds.select("row", F.explode("found").alias("f")).select(
        "row", "f.form", "f.behind", F.posexplode("f.matches").alias("at", "m")
    )
    size = F.length("m.text")
    so_far = F.sum(F.col("m.gap") + size).over(Window.partitionBy("row", "form").orderBy("at"))
    return each.select(
        "row",
        "form",
        (so_far - size).cast("long").alias("start"),
        so_far.cast("long").alias("end"),
        F.col("m.text").alias("text"),
        F.col("m.before.one").alias("one"),
        F.col("m.before.two").alias("two"),
        F.get("behind", F.col("at")).alias("behind"),
    )


def _in_slots(finds: DataFrame) -> DataFrame:
    """Finds once for each pattern around them: ``pattern``, and ``wider``, the context that must vary."""
    # One word alone tells something only where the words before it differ.
    slots = F.array(
        F.struct(F.col("one").alias("pattern"), F.coalesce("two", F.lit("")).alias("wider")),
        F.struct(F.col("two").alias("pattern"), F.col("text").alias("wider")),
        F.struct(F.col("behind").alias("pattern"), F.coalesce("two", F.lit("")).alias("wider")),
    )
    each = finds.withColumn("slot", F.explode(F.filter(slots, lambda s: s["pattern"].isNotNull())))
    return each.select("*", "slot.pattern", "slot.wider").drop("slot", "one", "two", "behind")


def _edges(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """``pattern, kind, instance, wider, seed, n``: how often an instance stands in a pattern's slot."""
    names = ["pattern", "kind", "instance", "wider", "seed"]
    known = seeds.withColumn("seed", F.lit(True)).withColumnRenamed("text", "instance").select(*names)
    open_ = candidates.withColumn("seed", F.lit(False)).withColumnRenamed("text", "instance").select(*names)
    return settle(known.unionByName(open_).groupBy(*names).agg(F.count(F.lit(1)).alias("n")))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """``pattern, kind, confidence`` after ``rounds`` rounds over the graph.

    A seed scores 1 throughout, another instance first 0, then the confidence of the best pattern around
    it. A pattern's confidence is the mean score of what stands in its slot, if at least ``support``
    different instances there are believed, in as many different wider contexts; else it is 0. Sums are
    combined before the shuffle, so frequent patterns and instances gather nowhere.
    """
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for step in range(rounds):
        believed = F.col("score") >= BELIEVED
        total = scored.groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("score")).alias("good"),
            F.sum("n").alias("all"),
            F.countDistinct(F.when(believed, F.col("instance"))).alias("instances"),
            F.countDistinct(F.when(believed, F.col("wider"))).alias("contexts"),
        )
        patterns = lookup_side(
            total.where((F.col("instances") >= support) & (F.col("contexts") >= support)).select(
                F.col("pattern").alias("p"), F.col("kind").alias("k"), (F.col("good") / F.col("all")).alias("confidence")
            )
        )
        if step + 1 == rounds:
            break
        around = scored.where(~F.col("seed")).join(
            patterns, (F.col("pattern") == F.col("p")) & (F.col("kind") == F.col("k"))
        )
        instances = lookup_side(
            around.groupBy(F.col("instance").alias("i"), F.col("kind").alias("ik")).agg(F.max("confidence").alias("belief"))
        )
        scored = settle(
            edges.join(instances, (F.col("instance") == F.col("i")) & (F.col("kind") == F.col("ik")), "left").select(
                *edges.columns, F.when(F.col("seed"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0))).alias("score")
            )
        )
    return patterns.select(F.col("p").alias("pattern"), F.col("k").alias("kind"), "confidence")


def _joined(spans: Column) -> Column:
    """Spans as text, by kind in the order of ``KINDS``, then by start."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["place"].alias("place"), s["start"].alias("start"), s["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_private(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT
) -> DataFrame:
    """One row per document: ``doc_id, base, added``, arrays of ``(place, start, end)``.

    ``place`` is the index of the kind in ``KINDS``; positions count code points, the end is
    exclusive. ``base`` holds the finds of the strict patterns, ``added`` candidates that stand in
    the slot of a pattern of enough ``confidence`` and overlap no base find. NULL texts count as
    empty and have no finds; NULL ids stay NULL; equal rows stay as many rows; an empty table gives none;
    other columns of ``docs`` do not matter.
    """
    finds = _finds(docs, doc_id, text)
    placed = store(_placed(finds), "placed")
    names = F.array(*map(F.lit, KINDS))
    seeds = placed.where(F.col("form").isin(*KINDS) & _sound(F.col("form"), F.col("text"))).withColumn("kind", F.col("form"))
    place = (F.array_position(names, F.col("kind")) - 1).cast("int")
    base = seeds.groupBy("row").agg(F.collect_list(F.struct(place.alias("place"), "start", "end")).alias("base"))
    base = store(base, "base")
    loose = placed.where(F.col("form").isin(*LOOSE))
    kinds = F.array_compact(F.array(*[F.when(_could_be(k, F.col("form"), F.col("text")), F.lit(k)) for k in KINDS]))
    own = base.select(F.col("row").alias("base_row"), "base")
    apart = ~F.exists(
        F.coalesce("base", F.array().cast("array<struct<place:int,start:bigint,end:bigint>>")),
        lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"]),
    )
    candidates = store(
        loose.withColumn("kind", F.explode(kinds))
        .join(own, F.col("row") == F.col("base_row"), "left")
        .where(apart)
        .select("row", "kind", "start", "end", "text", "one", "two", "behind"),
        "candidates",
    )
    slots = store(_in_slots(candidates), "slots")
    patterns = lookup_side(
        score_patterns(_edges(_in_slots(seeds), slots), support=support)
        .where(F.col("confidence") >= confidence)
        .select(F.col("pattern").alias("p"), F.col("kind").alias("k"), "confidence")
    )
    # A candidate that fits several kinds is of the most confident one.
    sure = Window.partitionBy("row", "start", "end").orderBy(F.col("confidence").desc(), "kind")
    added = (
        slots.join(patterns, (F.col("pattern") == F.col("p")) & (F.col("kind") == F.col("k")))
        .withColumn("first", F.row_number().over(sure))
        .where(F.col("first") == 1)
        .groupBy(F.col("row").alias("added_row"))
        .agg(F.collect_list(F.struct(place.alias("place"), "start", "end")).alias("added"))
    )
    none = F.array().cast("array<struct<place:int,start:bigint,end:bigint>>")
    return (
        finds.select("row", "doc_id")
        .join(own, F.col("row") == F.col("base_row"), "left")
        .join(lookup_side(added), F.col("row") == F.col("added_row"), "left")
        .select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))
    )


def private_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``find_private`` as counts of base finds, digest of base spans and text of all spans."""
    found = find_private(docs, doc_id, text, **options)
    count = lambda i: F.size(F.filter("base", lambda s: s["place"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
