"""Errors, each with the SQLSTATE that tells callers its kind."""

from __future__ import annotations


class VantorError(Exception):
    sqlstate = "XX000"


class InvalidVector(VantorError, ValueError):
    sqlstate = "22P02"


class InvalidParameter(VantorError, ValueError):
    sqlstate = "22023"


class DimensionMismatch(InvalidParameter):
    pass


class InvalidFilter(InvalidParameter):
    pass


class OutOfRange(VantorError, ValueError):
    sqlstate = "22003"


class UnknownCollection(VantorError, LookupError):
    sqlstate = "42704"


class UnknownVector(UnknownCollection):
    pass


class UnknownPoint(UnknownCollection):
    pass


class UnknownPayloadField(VantorError, LookupError):
    sqlstate = "42703"


class UnknownTable(VantorError, LookupError):
    sqlstate = "42P01"


class WrongColumnType(VantorError, TypeError):
    sqlstate = "42804"


class Duplicate(VantorError, ValueError):
    sqlstate = "42710"


class NotReady(VantorError, RuntimeError):
    sqlstate = "55000"


class Corrupt(VantorError, RuntimeError):
    sqlstate = "XX001"


class BudgetExceeded(VantorError, RuntimeError):
    sqlstate = "54000"


class UnsupportedMetric(VantorError, ValueError):
    sqlstate = "0A000"


class Conflict(VantorError, RuntimeError):
    sqlstate = "40001"
