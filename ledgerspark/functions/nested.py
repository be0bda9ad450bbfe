"""Values that arrive wrapped in JSON: lists, ``{text}``, ``{type, value}``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions.values import blank_to_null, strip

# Texts that switch a flag on.
TRUE_WORDS = ["true", "1", "yes", "y"]

# Keys that may hold the text of a configuration value, best first.
TEXT_KEYS = ["text", "name", "value"]

# Alias names of the token counters in usage objects, best first.
TOKEN_ALIASES = {
    "input": ["inputTokens", "prompt_tokens", "input_tokens"],
    "output": ["outputTokens", "completion_tokens", "output_tokens"],
    "total": ["totalTokens", "total_tokens"],
}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unwrap(raw: Column) -> Column:
    """What a wrapped JSON value holds; text that is no JSON stays as it is.

    A list of one element stands for the element, an object with ``text`` for that text, one with
    ``value`` for what is in there; an empty list is NULL. In longer lists and other objects every part is
    unwrapped at its place. A scalar comes out as plain text, all else as JSON text: its own where nothing
    in it was wrapped, else with the keys of objects in order. Works to any depth; a value is parsed once.
    """
    text = F.when(raw.isNotNull(), raw.cast("string"))
    wrapped = text.rlike(r'(?s)^[\[{"]') | (text == "null")
    parsed = F.try_parse_json(F.when(wrapped, text))
    return F.when(parsed.isNull(), text).otherwise(once(F.struct(text.alias("text"), parsed.alias("v")), _unwrapped))


def _unwrapped(given: Column) -> Column:
    # The state is the JSON text so far, in pieces: fixed ones, and values that are still closed.
    start = F.array(_closed(given["v"]))

    def opened(pieces: Column, _: Column) -> Column:
        final = F.forall(pieces, lambda piece: piece["open"].isNull())
        return F.when(final, pieces).otherwise(F.flatten(F.transform(pieces, _opened)))

    # One round for each bracket and one for scalars.
    rounds = F.sequence(F.lit(0), F.regexp_count(given["text"], F.lit(r"[\[{]")))
    pieces = F.aggregate(rounds, start, opened)
    made = F.array_join(F.transform(pieces, lambda piece: piece["text"]), "")

    def plain(made: Column) -> Column:
        return (
            F.when(made == "null", F.lit(None).cast("string"))
            .when(made.startswith('"'), F.variant_get(F.parse_json(made), "$", "string"))
            .when(made == F.to_json(given["v"]), given["text"])
            .otherwise(made)
        )

    return once(made, plain)


def _fixed(text: Column | str) -> Column:
    column = F.lit(text) if isinstance(text, str) else text
    return F.struct(column.alias("text"), F.lit(None).cast("variant").alias("open"))


def _closed(value: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("text"), value.alias("open"))


def _opened(piece: Column) -> Column:
    """A piece with its outermost list or object taken off."""
    value = piece["open"]

    def parted(parts: Column) -> Column:
        """Parts behind each other, with commas between them."""
        return F.flatten(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.array(_fixed(",")), part))))

    def from_list(items: Column) -> Column:
        each = parted(F.transform(items, lambda item: F.array(_closed(item))))
        return (
            F.when(F.size(items) == 0, F.array(_fixed("null")))
            .when(F.size(items) == 1, F.array(_closed(F.try_element_at(items, F.lit(1)))))
            .otherwise(F.concat(F.array(_fixed("[")), each, F.array(_fixed("]"))))
        )

    def from_object(parts: Column) -> Column:
        def entry(pair: Column) -> Column:
            name = F.regexp_replace(F.to_json(F.array(pair["key"])), r"^\[|\]$", "")
            return F.array(_fixed(F.concat(name, F.lit(":"))), _closed(pair["value"]))

        each = parted(F.transform(F.map_entries(parts), entry))
        return (
            F.when(F.map_contains_key(parts, "text"), F.array(_fixed(F.to_json(F.try_element_at(parts, F.lit("text"))))))
            .when(F.map_contains_key(parts, "value"), F.array(_closed(F.try_element_at(parts, F.lit("value")))))
            .otherwise(F.concat(F.array(_fixed("{")), each, F.array(_fixed("}"))))
        )

    items = F.try_variant_get(value, "$", "array<variant>")
    parts = F.try_variant_get(value, "$", "map<string,variant>")
    kinds = F.struct(items.alias("items"), parts.alias("parts"))
    return F.when(value.isNull(), F.array(piece)).otherwise(
        once(
            kinds,
            lambda k: F.when(k["items"].isNotNull(), from_list(k["items"]))
            .when(k["parts"].isNotNull(), from_object(k["parts"]))
            .otherwise(F.array(_fixed(F.to_json(value)))),
        )
    )


def _layers(raw: Column) -> Column:
    """One item per opening bracket, one at least: no value is nested deeper than that."""
    return F.sequence(F.lit(1), F.greatest(F.regexp_count(raw, F.lit(r"[\[{]")), F.lit(1)))


def first_text(raw: Column) -> Column:
    """First non-empty text of a configuration value: plain, in a list, or under a text key.

    Wrappers are opened layer by layer into a list of candidates that stay in order; an object
    without any text is a candidate itself, behind its own parts.
    """
    text = F.when(raw.isNotNull(), raw.cast("string"))
    start = F.array(F.struct(text.alias("text"), F.lit(False).alias("done")))

    def opened(found: Column, _: Column) -> Column:
        final = F.forall(found, lambda item: item["done"])
        return F.when(final, found).otherwise(F.flatten(F.transform(found, _open_up)))

    found = F.aggregate(_layers(raw), start, opened)
    texts = F.transform(found, lambda item: blank_to_null(item["text"]))
    return F.try_element_at(F.array_compact(texts), F.lit(1))


def _open_up(item: Column) -> Column:
    text = item["text"]

    def candidate(value: Column, done: bool = False) -> Column:
        return F.struct(value.alias("text"), F.lit(done).alias("done"))

    as_list = F.from_json(text, "array<string>")
    as_object = F.from_json(text, ", ".join(f"{key} string" for key in TEXT_KEYS))
    parts = once(
        as_object, lambda o: F.array(*[candidate(o[key]) for key in TEXT_KEYS], candidate(text, True))
    )
    items = F.coalesce(F.transform(as_list, lambda t: candidate(t)), F.array(candidate(text, True)))
    return (
        F.when(item["done"], F.array(item))
        .when(text.startswith("["), items)
        .when(text.startswith("{"), parts)
        .otherwise(F.array(candidate(text, True)))
    )


def flag(raw: Column) -> Column:
    """Boolean of a flag cell; anything but the fixed words, ``true`` or a number but 0 is false."""
    word = F.lower(strip(raw))
    number = word.try_cast("double")
    return F.coalesce(word.isin(TRUE_WORDS) | (number != 0), F.lit(False))


def whole_number(raw: Column) -> Column:
    """Integer text to bigint, NULL otherwise."""
    return strip(raw).try_cast("bigint")


def first_counter(payload: Column, aliases: list[str]) -> Column:
    """First alias that holds a number. Booleans and texts are passed over, decimals are cut.

    The value must be a bare JSON number, so each alias is read as a variant first.
    """
    parsed = F.try_parse_json(payload)
    picks = []
    for alias in aliases:
        kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{alias}", "variant"))
        number = F.try_variant_get(parsed, f"$.{alias}", "double").cast("bigint")
        exact = F.try_variant_get(parsed, f"$.{alias}", "bigint")
        picks.append(
            F.when(kind == "BIGINT", exact).when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), number)
        )
    return F.coalesce(*picks)


def token_counters(usage: Column) -> dict[str, Column]:
    return {name: first_counter(usage, aliases) for name, aliases in TOKEN_ALIASES.items()}
