"""Rule conditions as columns.

Two ways to write a condition:

* a function of a ``Fields`` object, in Python:  ``lambda f: f("kind") == "claim"``
* text, as rule tables hold it:  ``F("kind") == "claim"``, or in SQL spelling  "`kind` = 'claim'"

All give the same terms (``expressions`` reads text). A term keeps its value, its type and its failure
side by side, so a row whose condition cannot be decided is reported and never counted as false.

Values compare as in Python: NULL equals NULL and nothing else, a text and a number are never equal, and
ordering them, or calculating with a text, is a failure of the row. Any value can stand for a truth value:
NULL, zero and the empty text do not hold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.errors import ConditionError
from ledgerspark.functions import expressions, values
from ledgerspark.functions.expressions import (  # noqa: F401
    CODE_FIELD_CALL,
    CODE_FUNCTION,
    CODE_PARSE,
    CODE_PLACEHOLDER,
    CODE_RUNTIME,
    CODE_SYNTAX,
    CODE_UNRESOLVED,
)

# Fixed value: placeholder text of an unfinished rule.
PLACEHOLDERS = {"CONDITION"}
PERIOD_NAME = expressions.PERIOD_NAME

# Classes of values that compare with each other.
TEXT, NUMBER, TIME, NOTHING = "text", "number", "time", "nothing"


@dataclass(frozen=True, eq=False)
class Term:
    """A value together with the predicate that tells where it could not be computed."""

    value: Column
    bad: Column | None = None
    kind: T.DataType | None = None

    @property
    def type_class(self) -> str | None:
        """What the value compares with; None where its type is not known."""
        if isinstance(self.kind, (T.StringType, T.CharType, T.VarcharType)):
            return TEXT
        if isinstance(self.kind, (T.NumericType, T.BooleanType)):
            return NUMBER
        if isinstance(self.kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return TIME
        return NOTHING if isinstance(self.kind, T.NullType) else None

    @property
    def number(self) -> Column:
        """A truth value counts as 1 or 0 where numbers are wanted."""
        return self.value.cast("int") if isinstance(self.kind, T.BooleanType) else self.value

    def truth(self) -> Column:
        """Whether the value stands for true; never NULL."""
        if isinstance(self.kind, T.BooleanType):
            return F.coalesce(self.value, F.lit(False))
        if self.type_class == NUMBER:
            return F.coalesce(self.value != 0, F.lit(False))
        if self.type_class == TEXT:
            return F.coalesce(self.value != "", F.lit(False))
        return self.value.isNotNull()

    def _alike(self, that: Term) -> bool:
        """Whether values of both types can be compared; those of unknown type are taken to be."""
        mine, other = self.type_class, that.type_class
        return mine is None or other is None or mine == other or NOTHING in (mine, other)

    def __eq__(self, other: object) -> Term:  # type: ignore[override]
        that = as_term(other)
        if NOTHING in (self.type_class, that.type_class) or not self._alike(that):
            same = self.value.isNull() & that.value.isNull()
        else:
            same = self.number.eqNullSafe(that.number)
        return Term(same, either(self.bad, that.bad), BOOLEAN)

    def __ne__(self, other: object) -> Term:  # type: ignore[override]
        same = self == other
        return Term(~same.value, same.bad, BOOLEAN)

    def _ordered(self, other: object, make: Callable[[Column, Column], Column]) -> Term:
        that = as_term(other)
        if NOTHING in (self.type_class, that.type_class) or not self._alike(that):
            return failed()
        bad = either(either(self.bad, that.bad), self.value.isNull() | that.value.isNull())
        return Term(make(self.number, that.number), bad, BOOLEAN)

    def __lt__(self, other: object) -> Term:
        return self._ordered(other, lambda a, b: a < b)

    def __le__(self, other: object) -> Term:
        return self._ordered(other, lambda a, b: a <= b)

    def __gt__(self, other: object) -> Term:
        return self._ordered(other, lambda a, b: a > b)

    def __ge__(self, other: object) -> Term:
        return self._ordered(other, lambda a, b: a >= b)

    def _calculated(self, other: object, make: Callable[[Column, Column], Column]) -> Term:
        that = as_term(other)
        if not {self.type_class, that.type_class} <= {NUMBER, None}:
            return failed()
        bad = either(either(self.bad, that.bad), self.value.isNull() | that.value.isNull())
        made = make(self.number, that.number)
        # What overflows the type of the result is a failure, not a NULL that compares as one.
        return Term(made, either(bad, made.isNull()), T.DoubleType())

    def __add__(self, other: object) -> Term:
        that = as_term(other)
        if self.type_class == that.type_class == TEXT:
            bad = either(either(self.bad, that.bad), self.value.isNull() | that.value.isNull())
            return Term(F.concat(self.value, that.value), bad, T.StringType())
        return self._calculated(that, F.try_add)

    def __sub__(self, other: object) -> Term:
        return self._calculated(other, F.try_subtract)

    def __mul__(self, other: object) -> Term:
        return self._calculated(other, F.try_multiply)

    def __truediv__(self, other: object) -> Term:
        return self._divided(other, F.try_divide)

    def __mod__(self, other: object) -> Term:
        # The remainder takes the sign of the divisor.
        return self._divided(
            other, lambda a, b: F.try_mod(F.try_add(F.try_mod(a, b), b), b)
        )

    def _divided(self, other: object, make: Callable[[Column, Column], Column]) -> Term:
        that = as_term(other)
        made = self._calculated(that, make)
        if not {self.type_class, that.type_class} <= {NUMBER, None}:
            return made
        return Term(made.value, either(made.bad, that.number == 0), made.kind)

    def __neg__(self) -> Term:
        return as_term(0) - self

    def __pos__(self) -> Term:
        return self._calculated(0, lambda a, b: a)

    def isin(self, *options: object) -> Term:
        listed = options[0] if len(options) == 1 and isinstance(options[0], (list, tuple, set)) else options
        found = Term(F.lit(False), self.bad, BOOLEAN)
        for item in listed:
            found = found | (self == item)
        return found

    def within(self, text: Term) -> Term:
        """Whether the value is a part of a text."""
        if text.type_class not in (TEXT, None) or self.type_class not in (TEXT, None):
            return failed()
        bad = either(either(self.bad, text.bad), self.value.isNull() | text.value.isNull())
        return Term(F.contains(text.value, self.value), bad, BOOLEAN)

    def __and__(self, other: object) -> Term:
        # The right side can only fail where the left side holds.
        that = as_term(other)
        mine = self.truth()
        bad = either(self.bad, None if that.bad is None else mine & that.bad)
        return Term(mine & that.truth(), bad, BOOLEAN)

    def __or__(self, other: object) -> Term:
        that = as_term(other)
        mine = self.truth()
        bad = either(self.bad, None if that.bad is None else ~mine & that.bad)
        return Term(mine | that.truth(), bad, BOOLEAN)

    def __invert__(self) -> Term:
        return Term(~self.truth(), self.bad, BOOLEAN)

    def __bool__(self) -> bool:
        raise ConditionError(CODE_PARSE, "use & | ~ and isin() instead of and, or, not and in")

    __hash__ = None  # type: ignore[assignment]


BOOLEAN = T.BooleanType()


def failed() -> Term:
    """What has no outcome in any row."""
    return Term(F.lit(None).cast("boolean"), F.lit(True), BOOLEAN)


def as_term(item: object) -> Term:
    if isinstance(item, Term):
        return item
    if isinstance(item, Column):
        return Term(item)
    if item is None:
        return Term(F.lit(None), kind=T.NullType())
    if isinstance(item, str):
        return Term(F.lit(item), kind=T.StringType())
    if isinstance(item, bool):
        return Term(F.lit(item), kind=BOOLEAN)
    return Term(F.lit(item), kind=T.DoubleType() if isinstance(item, (int, float, Decimal)) else None)


def either(left: Column | None, right: Column | None) -> Column | None:
    if left is None or right is None:
        return left if right is None else right
    return left | right


class Fields:
    """What a Python condition is called with: field access, the period and the helpers."""

    def __init__(self, lookup: Callable[[str], Term], period: str) -> None:
        self._lookup = lookup
        self.current_period = Term(F.lit(period), kind=T.StringType())

    def __call__(self, name: str) -> Term:
        if not isinstance(name, str) or not name.strip():
            raise ConditionError(CODE_FIELD_CALL, "a field is named by one non-empty text")
        return self._lookup(name.strip())

    def is_blank(self, term: object) -> Term:
        item = as_term(term)
        return Term(values.is_blank(item.value), item.bad, BOOLEAN)

    def has_value(self, term: object) -> Term:
        item = as_term(term)
        return Term(values.has_value(item.value), item.bad, BOOLEAN)

    def as_number(self, term: object) -> Term:
        item = as_term(term)
        kind = T.DecimalType(28, 6)
        if isinstance(item.kind, T.NumericType):
            number = item.value.try_cast(values.NUMBER)
            return Term(number, either(item.bad, item.value.isNotNull() & number.isNull()), kind)
        text = item.value.cast("string")
        return Term(values.as_number(text), either(item.bad, values.as_number_invalid(text)), kind)

    def period_of(self, term: object) -> Term:
        item = as_term(term)
        found = values.period_of_date(item.value) if item.type_class == TIME else values.period_of(item.value)
        return Term(found, item.bad, T.StringType())

    def add_months(self, period: object, months: object) -> Term:
        item, count = as_term(period), as_term(months)
        if item.type_class not in (TEXT, None) or count.type_class not in (NUMBER, None):
            return failed()
        moved = values.shift_period(item.value, count.number.cast("int"))
        return Term(moved, either(either(item.bad, count.bad), moved.isNull()), T.StringType())


class _Names(Fields):
    """Records the names a condition asks for; nothing is evaluated."""

    def __init__(self) -> None:
        self.seen: list[str] = []
        super().__init__(self._note, values.VALIDATION_PERIOD)

    def _note(self, name: str) -> Term:
        if name not in self.seen:
            self.seen.append(name)
        # The type is not known, so no term is refused for it.
        return Term(F.lit(None).cast("string"))


Condition = str | Callable[[Fields], Term]


def referenced_names(condition: Condition | None) -> list[str]:
    """Field names a condition reads; raises if the condition can be read in no way."""
    probe = _Names()
    _made(condition, probe)
    return probe.seen


def build(condition: Condition | None, lookup: Callable[[str], Term], period: str) -> Term | None:
    """The condition as a truth value, or None for an empty one, which always holds."""
    made = _made(condition, Fields(lookup, period))
    if made is None:
        return None
    # Where a condition has no outcome it does not hold.
    value = made.truth() if made.bad is None else F.coalesce(made.truth() & ~made.bad, F.lit(False))
    return Term(value, made.bad if made.bad is None else F.coalesce(made.bad, F.lit(True)), BOOLEAN)


def _made(condition: Condition | None, fields: Fields) -> Term | None:
    if condition is None or (isinstance(condition, str) and not condition):
        return None
    if isinstance(condition, str):
        if condition.strip().upper() in PLACEHOLDERS:
            raise ConditionError(CODE_PLACEHOLDER, "the condition is still a placeholder")
        return expressions.read(condition, fields)
    made = condition(fields)
    if not isinstance(made, Term):
        raise ConditionError(CODE_PARSE, "a condition must give a truth value")
    return made


# Helper calls inside condition text, as SQL functions. Spark inlines them, so they cost nothing
# at run time and stay inside generated code. {ws} is the white space set.
_BARE = "btrim(translate(v, ',`', ''), '{ws}')"
_SEP = r"r'^\D*(\d{{4}})\D{{1,3}}(\d{{1,2}})(\D|$)'"
_SOLID = r"r'^\D*(\d{{4}})(\d{{2}})'"
_HELPERS = {
    "is_blank(v STRING) RETURNS BOOLEAN": "v IS NULL OR btrim(v, '{ws}') = ''",
    "has_value(v STRING) RETURNS BOOLEAN": "v IS NOT NULL AND btrim(v, '{ws}') <> ''",
    "as_number(v STRING) RETURNS DECIMAL(28,6)": (
        f"try_cast(CASE WHEN {_BARE} RLIKE '{values.DASHES_ONLY}' THEN '0' ELSE {_BARE} END"
        " AS DECIMAL(28,6))"
    ),
    "period_of(v STRING) RETURNS STRING": (
        f"CASE WHEN regexp_extract(v, {_SEP}, 1) <> ''"
        f" THEN CASE WHEN lpad(regexp_extract(v, {_SEP}, 2), 2, '0') BETWEEN '01' AND '12'"
        f" THEN regexp_extract(v, {_SEP}, 1) || lpad(regexp_extract(v, {_SEP}, 2), 2, '0') END"
        f" WHEN regexp_extract(v, {_SOLID}, 2) BETWEEN '01' AND '12'"
        f" THEN regexp_extract(v, {_SOLID}, 1) || regexp_extract(v, {_SOLID}, 2) END"
    ),
    "shift_period(v STRING, months INT) RETURNS STRING": (
        "date_format(add_months(try_to_date(v, 'yyyyMM'), months), 'yyyyMM')"
    ),
}


HELPER_NAMES = {head.partition("(")[0] for head in _HELPERS}


def install_sql_helpers(spark: SparkSession) -> list[str]:
    """Make the helpers callable from condition text in this session; returns their names."""
    for head, body in _HELPERS.items():
        filled = body.format(ws=values.WHITESPACE)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {filled}")
    return [head.partition("(")[0] for head in _HELPERS]
