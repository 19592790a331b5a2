"""Score formulas: arithmetic over the child's score, compiled to a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantor.errors import BudgetExceeded, InvalidParameter
from vantor.functions.vectors import error

MAX_BYTES, MAX_OPERATIONS, MAX_WORK = 512, 128, 16_384
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(\$?[A-Za-z_]\w*)|([-+*/()]))")


class Formula:
    """A parsed formula: numbers, $score or score, + - * /, signs and parentheses."""

    def __init__(self, text: str) -> None:
        if len(text.encode()) > MAX_BYTES:
            raise InvalidParameter("formula is too long")
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise InvalidParameter(f"malformed formula at {text[at:]!r}")
            self.tokens.append(m.groups())
            at = m.end()
        self.at, self.operations = 0, 0
        self.root = self._sum()
        if self.at != len(self.tokens):
            raise InvalidParameter("malformed formula")
        if self.operations > MAX_OPERATIONS:
            raise InvalidParameter("formula has too many operations")

    def _peek(self) -> str | None:
        return self.tokens[self.at][2] if self.at < len(self.tokens) else None

    def _binary(self, signs: str, part) -> tuple:
        left = part()
        while (sign := self._peek()) and sign in signs:
            self.at += 1
            self.operations += 1
            left = (sign, left, part())
        return left

    def _sum(self) -> tuple:
        return self._binary("+-", self._product)

    def _product(self) -> tuple:
        return self._binary("*/", self._unary)

    def _unary(self) -> tuple:
        sign = self._peek()
        if sign and sign in "+-":
            self.at += 1
            self.operations += 1
            inner = self._unary()
            return ("neg", inner) if sign == "-" else inner
        return self._atom()

    def _atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise InvalidParameter("malformed formula")
        number, name, sign = self.tokens[self.at]
        self.at += 1
        if number:
            return ("number", float(number))
        if name:
            if name not in ("score", "$score"):
                raise InvalidParameter(f"unknown name {name}")
            return ("score",)
        if sign == "(":
            inner = self._sum()
            if self._peek() != ")":
                raise InvalidParameter("malformed formula")
            self.at += 1
            return inner
        raise InvalidParameter("malformed formula")

    def check(self, rows: int) -> None:
        if self.operations * rows > MAX_WORK:
            raise BudgetExceeded("formula needs too many operations")

    def column(self, score: Column) -> Column:
        """The value; dividing by zero and results that aren't finite are errors."""

        def build(n: tuple) -> Column:
            if n[0] == "number":
                return F.lit(n[1])
            if n[0] == "score":
                return score.cast("double")
            if n[0] == "neg":
                return -build(n[1])
            a, b = build(n[1]), build(n[2])
            if n[0] == "/":
                return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).otherwise(error("22023: division by zero in a formula"))
            return a + b if n[0] == "+" else a - b if n[0] == "-" else a * b

        value = build(self.root)
        return F.when(score.isNull(), F.lit(None).cast("double")).when(F.abs(value) < float("inf"), value).otherwise(error("22023: formula isn't finite"))
