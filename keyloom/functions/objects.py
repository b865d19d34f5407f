"""Object expressions `{...}` as columns: evaluated for each row, without Python at run time.

A bare word is a property of the row if the row has one of that name, else the word itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.relation import Relation
from ..plans.lexer import QuerySyntaxError, Token
from .expr import COMPARISONS, atof, compare_columns, number


def words_of(body: tuple[Token, ...]) -> list[str]:
    """Names that can be properties."""
    return [t.text for t in body if t.kind == "word"]


class _Operand:
    def __init__(self, column: Column, numeric: bool, name: str | None = None):
        self.column, self.numeric, self.name = column, numeric, name

    def number(self) -> Column:
        return self.column.cast("double") if self.numeric else atof(self.column.cast("string"))


def compile_object(rel: Relation, body: tuple[Token, ...]) -> tuple[str | None, Column, bool]:
    """(target field or None, column, whether it is a truth value)."""
    stack: list = []
    target: str | None = None

    def operand(token: Token) -> _Operand:
        if token.kind == "number":
            return _Operand(F.lit(number(token.text)), True)
        if token.kind == "literal":
            return _Operand(F.lit(token.text), False)
        if token.text.lower() == "@key":
            return _Operand(F.col("key"), False)
        if rel.is_numeric(token.text):
            return _Operand(F.coalesce(rel.field(token.text), F.lit(0)), True, token.text)
        if rel.loaded(token.text):
            return _Operand(F.coalesce(rel.field(token.text).cast("string"), F.lit(token.text)), False, token.text)
        return _Operand(F.lit(token.text), False, token.text)

    def pop() -> _Operand:
        if not stack:
            raise QuerySyntaxError("an operator in {} lacks an operand")
        return stack.pop()

    for token in body:
        if token.kind != "operator":
            stack.append(operand(token))
            continue
        op = token.text
        if op == ",":
            b, a = pop(), pop()
            stack.append([*(a if isinstance(a, list) else [a]), *(b if isinstance(b, list) else [b])])
            continue
        if op == "=":
            value, name = pop(), pop()
            target = name.name
            stack.append(value)
            continue
        if op in ("sqrt", "atan"):
            stack.append(_Operand(getattr(F, op)(pop().number()), True))
            continue
        args = pop()
        if not isinstance(args, list):
            args = [pop(), args] if op != "between" else args
        if op in ("pow", "atan2"):
            stack.append(_Operand(getattr(F, op)(args[0].number(), args[1].number()), True))
        elif op in "+-*/%":
            a, b = args[0].number(), args[1].number()
            made = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(a, b)}[op]()
            stack.append(_Operand(made, True))
        elif op == "contains":
            stack.append(_Operand(F.contains(args[0].column.cast("string"), args[1].column.cast("string")), False))
        elif op == "between":
            stack.append(_Operand(args[0].number().between(args[1].number(), args[2].number()), False))
        elif op in COMPARISONS:
            a, b = args
            made = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y}[COMPARISONS[op]](a.number(), b.number()) if a.numeric or b.numeric else compare_columns(op, a.column, b.column)
            stack.append(_Operand(made, False))
        elif op in ("and", "&", "or", "|"):
            a, b = (x.column.cast("boolean") for x in args)
            stack.append(_Operand(a & b if op in ("and", "&") else a | b, False))
        else:
            raise QuerySyntaxError(f"{op} can't stand in an expression")
    if len(stack) != 1:
        raise QuerySyntaxError("an expression gives one value")
    last = stack[0]
    if isinstance(last, list):
        raise QuerySyntaxError("an expression gives one value")
    truth = bool(body) and body[-1].kind == "operator" and (body[-1].text in COMPARISONS or body[-1].text in ("and", "or", "&", "|", "contains", "between")) and target is None
    return target, last.column, truth


def fields_of(body: tuple[Token, ...]) -> tuple[str | None, list[str]]:
    """For {target = (f1, f2, ..)} or {(f1, f2, ..)}: the target and the ordered names."""
    names = words_of(body)
    if any(t.kind == "operator" and t.text == "=" for t in body):
        return names[0], names[1:]
    return None, names


_BOUNDS = (-1.0, -0.5, -0.25, -0.1, 0.1, 0.25, 0.5)
TREND_LABELS = ("steep fall", "fall", "slow fall", "slight fall", "level", "slow rise", "rise", "steep rise")


def trend(values: list[Column]) -> Column:
    """Ordinary least squares over equally spaced values of one row: struct(slope, intercept, label)."""
    n = len(values)
    xs = range(n)
    mean_x = sum(xs) / n
    mean_y = sum(values[1:], values[0]) / F.lit(float(n))
    sxx = sum((x - mean_x) ** 2 for x in xs) or 1.0
    slope = sum(((v * F.lit(x - mean_x)) for x, v in list(zip(xs, values))[1:]), values[0] * F.lit(0 - mean_x)) / F.lit(sxx)
    label = F.lit(TREND_LABELS[-1])
    for bound, text in reversed(list(zip(_BOUNDS, TREND_LABELS))):
        label = F.when(slope < bound, F.lit(text)).otherwise(label)
    return F.struct(slope.alias("slope"), (mean_y - slope * F.lit(mean_x)).alias("intercept"), label.alias("label"))
