"""Expressions over a list of nodes, compiled to aggregates.

The language is the part of CEL that checks of query results use: `nodes.all(n, e)`, `nodes.exists(n, e)`,
`nodes.exists_one(n, e)`, `nodes.filter(n, e)` (which the others and `size` take as a list), `size(x)`
and `x.size()`; on strings `contains`, `startsWith`, `endsWith`, `matches` and `+`; `in [..]`, arithmetic,
comparisons, `!`, `&&`, `||`, `c ? a : b`, parentheses and literals. A list of nodes is never built: `all` is
the conjunction over the rows, `exists` the disjunction and `size` the count, each with partial sums
before the shuffle. Over no rows `all` holds and `exists` doesn't; a comparison with a null is false.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""\s*(?:(\d+\.\d+|\d+)|("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|([A-Za-z_]\w*)|(&&|\|\||==|!=|<=|>=|[-+*/%<>!?:.,()\[\]]))""")
COMPARE = {"==": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
MACROS = ("all", "exists", "exists_one", "filter")


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Nodes:
    """A list of nodes: the rows for which the predicate holds."""

    where: Column


@dataclass(frozen=True)
class Value:
    column: Column
    kind: str  # str, num, bool or null


class Parser:
    """Recursive descent over the tokens. fields: kinds of the columns by name."""

    def __init__(self, text: str, fields: dict[str, str]) -> None:
        self.fields, self.tokens, at = fields, [], 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected {text[at:]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()
        self.at, self.node = 0, ""

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        token = self.peek()
        if not token or wanted and token != wanted:
            raise ExpressionError(f"expected {wanted or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def whole(self) -> Value:
        found = self.choice()
        if self.peek():
            raise ExpressionError(f"unexpected {self.peek()!r}")
        return self.value(found)

    @staticmethod
    def value(x: Any) -> Value:
        if not isinstance(x, Value):
            raise ExpressionError("a list of nodes is no value")
        return x

    def truth(self, x: Any) -> Column:
        if self.value(x).kind not in ("bool", "null"):
            raise ExpressionError("expected a condition")
        return F.coalesce(x.column, F.lit(False))

    def choice(self) -> Any:
        test = self.either()
        if self.peek() != "?":
            return test
        self.take("?")
        yes = self.value(self.choice())
        self.take(":")
        no = self.value(self.choice())
        return Value(F.when(self.truth(test), yes.column).otherwise(no.column), yes.kind)

    def either(self) -> Any:
        left = self.both()
        while self.peek() == "||":
            self.take()
            left = Value(self.truth(left) | self.truth(self.both()), "bool")
        return left

    def both(self) -> Any:
        left = self.compared()
        while self.peek() == "&&":
            self.take()
            left = Value(self.truth(left) & self.truth(self.compared()), "bool")
        return left

    def compared(self) -> Any:
        left = self.sum()
        while self.peek() in COMPARE or self.peek() == "in":
            op = self.take()
            if op == "in":
                self.take("[")
                items = self.arguments("]")
                left = Value(self.value(left).column.isin(*[i.column for i in items]), "bool")
            else:
                right = self.value(self.sum())
                both = self.value(left).column, right.column
                if "null" in (left.kind, right.kind) and op in ("==", "!="):
                    same = both[0].eqNullSafe(both[1])
                    left = Value(same if op == "==" else ~same, "bool")
                else:
                    left = Value(COMPARE[op](*both), "bool")
        return left

    def sum(self) -> Any:
        left = self.product()
        while self.peek() in ("+", "-"):
            op, right = self.take(), self.value(self.product())
            left = self.value(left)
            if op == "+" and "str" in (left.kind, right.kind):
                left = Value(F.concat(left.column, right.column), "str")
            else:
                left = Value(left.column + right.column if op == "+" else left.column - right.column, "num")
        return left

    def product(self) -> Any:
        left = self.unary()
        while self.peek() in ("*", "/", "%"):
            op, right = self.take(), self.value(self.unary()).column
            one = self.value(left).column
            left = Value(one * right if op == "*" else one / right if op == "/" else one % right, "num")
        return left

    def unary(self) -> Any:
        if self.peek() == "!":
            self.take()
            return Value(~self.truth(self.unary()), "bool")
        if self.peek() == "-":
            self.take()
            return Value(-self.value(self.unary()).column, "num")
        found = self.primary()
        while self.peek() == ".":
            self.take()
            found = self.member(found, self.take())
        return found

    def arguments(self, close: str) -> list[Value]:
        found = []
        while self.peek() != close:
            found.append(self.value(self.choice()))
            if self.peek() != close:
                self.take(",")
        self.take(close)
        return found

    def primary(self) -> Any:
        token = self.take()
        if token == "(":
            found = self.choice()
            self.take(")")
            return found
        if token[0] in "\"'":
            return Value(F.lit(ast.literal_eval(token)), "str")
        if token[0].isdigit():
            return Value(F.lit(ast.literal_eval(token)), "num")
        if token in ("true", "false"):
            return Value(F.lit(token == "true"), "bool")
        if token == "null":
            return Value(F.lit(None), "null")
        if token == "size" and self.peek() == "(":
            self.take("(")
            found = self.choice()
            self.take(")")
            return self.size(found)
        if token == "nodes" and not self.node:
            return Nodes(F.lit(True))
        if token == self.node and self.node:
            self.take(".")
            name = self.take()
            if name not in self.fields:
                raise ExpressionError(f"unknown field {name!r}")
            return Value(F.col(name), self.fields[name])
        raise ExpressionError(f"unknown name {token!r}")

    @staticmethod
    def size(x: Any) -> Value:
        if isinstance(x, Nodes):
            return Value(F.count_if(x.where), "num")
        if x.kind != "str":
            raise ExpressionError("only lists and strings have a size")
        return Value(F.length(x.column), "num")

    def member(self, of: Any, name: str) -> Any:
        self.take("(")
        if isinstance(of, Nodes) and name in MACROS:
            self.node = self.take()
            self.take(",")
            test = self.truth(self.choice())
            self.take(")")
            self.node = ""
            if name == "filter":
                return Nodes(of.where & test)
            if name == "all":
                return Value(F.coalesce(F.bool_and(~of.where | test), F.lit(True)), "bool")
            if name == "exists":
                return Value(F.coalesce(F.bool_or(of.where & test), F.lit(False)), "bool")
            return Value(F.count_if(of.where & test) == 1, "bool")
        arguments = self.arguments(")")
        if name == "size" and not arguments:
            return self.size(of)
        text = {"contains": Column.contains, "startsWith": Column.startswith, "endsWith": Column.endswith}
        if isinstance(of, Value) and of.kind == "str" and len(arguments) == 1 and name in (*text, "matches"):
            return Value(F.regexp_like(of.column, arguments[0].column) if name == "matches" else text[name](of.column, arguments[0].column), "bool")
        raise ExpressionError(f"unknown function {name!r}")


def compiled(text: str, nodes: DataFrame) -> Column:
    """The expression as an aggregate over rows of nodes."""
    kinds = {n: "str" if t == "string" else "bool" if t == "boolean" else "num" for n, t in nodes.dtypes}
    return Parser(text, kinds).whole().column


def evaluate(nodes: DataFrame, texts: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """One row, or one for each group, with a column for each named expression."""
    columns = [compiled(text, nodes).alias(name) for name, text in texts.items()]
    return nodes.groupBy(*(by or [])).agg(*columns)
