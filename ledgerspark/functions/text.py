"""Names, ids and text-quality measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions.values import WHITESPACE, strip

# Characters that point to text decoded with the wrong code page.
ENCODING_MARKERS = ["�", "Ã", "Â", "é", "æ"]

# Fixed value: range of the CJK characters that are counted.
CJK_RANGE = "一-鿿"

# Fixed value: shape of an id that is safe as a folder name.
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"

# Words around an action that forbid it, in both languages.
NEGATORS = ["do not", "don't", "not", "no", "without"]
VERBS = ["run", "execute", "perform", "call", "trigger", "do"]
PARTICIPLES = ["run", "executed", "performed", "called", "triggered", "done"]
AUXILIARIES = ["was", "is", "should be"]
CJK_NEGATORS = ["不要", "不", "禁止", "未"]
CJK_VERBS = ["执行", "运行", "调用", "触发", "跑", "做"]


def _any_of(words: list[str]) -> str:
    return "(?:" + "|".join(word.replace(" ", r"\s+") for word in words) + ")"


def forbidding(word: str, cjk_word: str) -> list[str]:
    """Patterns of an action that is forbidden: negator before it, or a denied participle after it."""
    action = rf"(?:\b{word}\b|{cjk_word})"
    verb = rf"(?:{_any_of(VERBS)}\s+)?(?:the\s+)?"
    return [
        rf"\b{_any_of(NEGATORS)}\s+{verb}\b{word}\b",
        rf"\b{word}\s+(?:{_any_of(AUXILIARIES)}\s+)?not\s+{_any_of(PARTICIPLES)}\b",
        rf"{_any_of(CJK_NEGATORS)}{_any_of(CJK_VERBS)}?\s*{action}",
        rf"{action}\s*不{_any_of(CJK_VERBS)}?",
    ]


def slug(value: Column) -> Column:
    dashed = F.regexp_replace(strip(value), "[^a-zA-Z0-9_-]+", "-")
    bare = F.lower(F.btrim(dashed, F.lit("-")))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("unnamed"))


def safe_stem(value: Column) -> Column:
    """File-name form of an id: anything but letters, digits, dash and underscore becomes ``_``."""
    return F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "_")


def artifact_name(period: Column, project: Column, generated_at: Column) -> Column:
    return F.concat_ws("_", period, safe_stem(project), F.date_format(generated_at, "yyyyMMdd-HHmmss"))


def is_safe_id(value: Column) -> Column:
    bare = strip(value)
    return F.coalesce(bare.rlike(SAFE_ID) & ~bare.contains(".."), F.lit(False))


def has_encoding_marker(value: Column) -> Column:
    """Plain substring tests; a character class would walk the text through the regex engine."""
    found = value.contains(ENCODING_MARKERS[0])
    for marker in ENCODING_MARKERS[1:]:
        found = found | value.contains(marker)
    return found


def visible_length(value: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.translate(value, WHITESPACE, ""))


def cjk_length(value: Column) -> Column:
    return F.regexp_count(value, F.lit(f"[{CJK_RANGE}]"))


def cjk_ratio(value: Column) -> Column:
    """Share of CJK characters among the characters that are not white space."""
    total = visible_length(value)
    return F.when(total > 0, cjk_length(value) / total).otherwise(F.lit(0.0))


def asks_for(value: Column, word: str = "upload", cjk_word: str = "上传") -> Column:
    """True where text asks for an action once all wordings that forbid it are taken out."""
    lowered = F.lower(value)
    text = lowered
    for pattern in forbidding(word, cjk_word):
        text = F.regexp_replace(text, pattern, " ")
    asked = text.rlike(rf"\b{word}\b") | text.contains(cjk_word)
    # Most texts hold neither word and are settled by a substring test.
    mentioned = lowered.contains(word) | lowered.contains(cjk_word)
    return F.when(mentioned, asked).otherwise(mentioned)
