"""Condition text as terms.

A rule table may hold conditions in two spellings of one small language:

* ``F("kind") == "claim" and is_blank(F("note"))``
* ```kind` = 'claim' and is_blank(`note`)``

The second is respelled as the first, token by token. Python's own grammar then gives the tree, and the tree
is turned into terms; nothing of it is ever run. Rule tables are data from outside, so all that is not listed
here is refused.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable
from typing import Any

from ledgerspark.errors import ConditionError

# The codes of the condition report.
CODE_PLACEHOLDER = "condition_placeholder_detected"
CODE_PARSE = "condition_parse_failed"
CODE_SYNTAX = "condition_ast_not_allowed"
CODE_FUNCTION = "condition_function_not_allowed"
CODE_FIELD_CALL = "condition_invalid_f_call"
CODE_UNRESOLVED = "condition_identifier_unresolved"
CODE_RUNTIME = "condition_runtime_error"

PERIOD_NAME = "current_period"
# Helpers by the name they have in text, and the method of the fields they stand for.
HELPERS = {
    "is_blank": ("is_blank", 1),
    "has_value": ("has_value", 1),
    "as_number": ("as_number", 1),
    "period_of": ("period_of", 1),
    "add_months": ("add_months", 2),
    "shift_period": ("add_months", 2),
}

# Words of the SQL spelling, and how the other one writes them.
WORDS = {
    "and": "and", "or": "or", "not": "not", "in": "in", "is": "is", "null": "None", "none": "None", "true": "True", "false": "False",
    PERIOD_NAME: PERIOD_NAME,
}
SIGNS = {"=": "==", "<=>": "==", "<>": "!="}
# Pieces of a text in SQL spelling. Comments come before signs, so none can hide a quote.
_PIECE = re.compile(
    r"""(?P<literal>'(?:\\.|''|[^'\\])*'|"(?:\\.|""|[^"\\])*")|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |`(?P<field>[^`]*)`|(?P<comment>--|/\*)|(?P<word>[^\W\d]\w*)(?P<call>\s*\()?
    |(?P<sign><=>|<>|==|!=|<=|>=|[=<>+\-*/%(),])|(?P<space>\s+)|(?P<other>.)""",
    re.DOTALL | re.VERBOSE,
)
_ESCAPE = re.compile(r"\\(.)|''|\"\"", re.DOTALL)
_CONTROL = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "0": "\0", "Z": "\x1a"}

COMPARISONS: dict[type, Callable] = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt,
    ast.GtE: operator.ge,
}
CALCULATIONS: dict[type, Callable] = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod,
}
UNARY: dict[type, Callable] = {ast.Not: operator.invert, ast.USub: operator.neg, ast.UAdd: operator.pos}


def read(text: str, fields: Any) -> Any:
    """The term of a condition text. ``fields`` is what Python conditions are called with."""
    spelled = respelled(text.strip()) if _in_sql_spelling(text) else text.strip()
    try:
        tree = ast.parse(spelled, mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        raise ConditionError(CODE_PARSE, "the condition is not a valid expression") from error
    try:
        return _Reader(fields).term(tree.body)
    except RecursionError as error:
        raise ConditionError(CODE_PARSE, "the condition is nested too deeply") from error


def _in_sql_spelling(text: str) -> bool:
    return "`" in text or not re.search(r"(?<!\w)F\s*\(", text)


def respelled(text: str) -> str:
    """SQL spelling as the other spelling; refuses what conditions may not hold."""
    out: list[str] = []
    # For every open parenthesis what closes it.
    open_: list[str] = []
    after_in = False
    for piece in _PIECE.finditer(text):
        if piece["space"]:
            out.append(" ")
            continue
        if piece["comment"] or piece["other"]:
            raise ConditionError(CODE_SYNTAX, f"the condition may not hold {piece[0]!r}")
        is_list, after_in = after_in, False
        if piece["literal"] is not None:
            quote = piece["literal"][0]
            inside = piece["literal"][1:-1]
            out.append(repr(_ESCAPE.sub(lambda m: _plain(m, quote), inside)))
        elif piece["number"] is not None:
            # Zeros in front, which the other spelling does not know.
            out.append(re.sub(r"^0+(?=\d)", "", piece["number"]))
        elif piece["field"] is not None:
            if not piece["field"].strip():
                raise ConditionError(CODE_FIELD_CALL, "a field is named by one non-empty text")
            out.append(f"F({piece['field']!r})")
        elif piece["word"]:
            word = piece["word"].lower()
            after_in = word == "in"
            if word in WORDS:
                out.append(f" {WORDS[word]} ")
                if piece["call"]:
                    out.append("[" if after_in else "(")
                    open_.append("]" if after_in else ")")
                    after_in = False
            elif piece["call"]:
                if word not in HELPERS:
                    raise ConditionError(CODE_FUNCTION, "the condition calls an unknown function")
                out.append(f"{word}(")
                open_.append(")")
            else:
                raise ConditionError(CODE_SYNTAX, f"the condition may not hold {word}; fields stand in back-ticks")
        elif piece["sign"] == "(":
            out.append("[" if is_list else "(")
            open_.append("]" if is_list else ")")
        elif piece["sign"] == ")":
            if not open_:
                raise ConditionError(CODE_PARSE, "the condition is not a valid expression")
            out.append(open_.pop())
        else:
            out.append(f" {SIGNS.get(piece['sign'], piece['sign'])} ")
    return "".join(out).strip()


def _plain(escape: re.Match, quote: str) -> str:
    """What an escape stands for; two quotes of the kind that encloses the literal are one."""
    if escape[1] is not None:
        return _CONTROL.get(escape[1], escape[1])
    return quote if escape[0] == 2 * quote else escape[0]


class _Reader:
    """Terms of the nodes that conditions may have."""

    def __init__(self, fields: Any) -> None:
        self.fields = fields

    def term(self, node: ast.expr) -> Any:
        from ledgerspark.functions.conditions import as_term

        if isinstance(node, ast.Constant):
            if node.value is not None and not isinstance(node.value, (str, int, float)):
                raise self._refused(node)
            return as_term(node.value)
        if isinstance(node, ast.Name):
            if node.id == PERIOD_NAME:
                return self.fields.current_period
            raise ConditionError(CODE_UNRESOLVED, f"the condition names an unknown field: {node.id}", node.id)
        if isinstance(node, ast.BoolOp):
            parts = [self.term(part) for part in node.values]
            made = parts[0]
            for part in parts[1:]:
                made = made & part if isinstance(node.op, ast.And) else made | part
            return made
        if isinstance(node, ast.UnaryOp) and type(node.op) in UNARY:
            return UNARY[type(node.op)](self.term(node.operand))
        if isinstance(node, ast.BinOp) and type(node.op) in CALCULATIONS:
            return CALCULATIONS[type(node.op)](self.term(node.left), self.term(node.right))
        if isinstance(node, ast.Compare):
            return self._compared(node)
        if isinstance(node, ast.Call):
            return self._called(node)
        raise self._refused(node)

    def _compared(self, node: ast.Compare) -> Any:
        left, made = node.left, None
        for kind, right in zip(node.ops, node.comparators, strict=True):
            part = self._one(left, kind, right)
            made = part if made is None else made & part
            left = right
        return made

    def _one(self, left: ast.expr, kind: ast.cmpop, right: ast.expr) -> Any:
        mine = self.term(left)
        if isinstance(kind, (ast.In, ast.NotIn)):
            if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                found = mine.isin([self.term(item) for item in right.elts])
            else:
                found = mine.within(self.term(right))
            return found if isinstance(kind, ast.In) else ~found
        if isinstance(kind, (ast.Is, ast.IsNot)):
            # Only NULL, true and false are one and the same object.
            if not (isinstance(right, ast.Constant) and (right.value is None or isinstance(right.value, bool))):
                raise self._refused(kind)
            same = mine == self.term(right)
            return same if isinstance(kind, ast.Is) else ~same
        return COMPARISONS[type(kind)](mine, self.term(right))

    def _called(self, node: ast.Call) -> Any:
        name = node.func.id if isinstance(node.func, ast.Name) else None
        if name == "F":
            plain = len(node.args) == 1 and not node.keywords and isinstance(node.args[0], ast.Constant)
            if not plain or not isinstance(node.args[0].value, str) or not node.args[0].value.strip():
                raise ConditionError(CODE_FIELD_CALL, "a field is named by one non-empty text")
            return self.fields(node.args[0].value)
        if name not in HELPERS:
            raise ConditionError(CODE_FUNCTION, "the condition calls an unknown function")
        method, count = HELPERS[name]
        if node.keywords or len(node.args) != count:
            raise ConditionError(CODE_RUNTIME, f"{name} takes {count} value{'s' if count > 1 else ''}")
        return getattr(self.fields, method)(*[self.term(arg) for arg in node.args])

    @staticmethod
    def _refused(node: ast.AST) -> ConditionError:
        return ConditionError(CODE_SYNTAX, f"the condition may not hold {type(node).__name__}")
