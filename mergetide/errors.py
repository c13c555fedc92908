"""Errors that every operator raises on the driver, before a plan is built, and the checks that raise them."""

import math


class SummaryError(Exception):
    """Base of all errors here."""


class InvalidParameterError(SummaryError, ValueError):
    """A parameter outside its domain."""


class IncompatibleStateError(SummaryError, ValueError):
    """States that don't belong together."""


class ObservationCountOverflowError(SummaryError, OverflowError):
    """More observations than 64 bits count."""


class CounterOverflowError(SummaryError, OverflowError):
    """A counter that a long does not hold."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise InvalidParameterError(f"bad parameter: {message}")


def same(condition: bool, message: str) -> None:
    if not condition:
        raise IncompatibleStateError(f"states do not fit together: {message}")


def positive(**named: int) -> None:
    for name, x in named.items():
        require(x > 0, f"{name}={x!r}, wanted: 1 or more")


def within(low: float, high: float, **named: float) -> None:
    """Finite and from ``low`` to ``high``, both included."""
    for name, x in named.items():
        require(math.isfinite(x) and low <= x <= high, f"{name}={x!r}, wanted: from {low} to {high}")


def open_fraction(**named: float) -> None:
    for name, x in named.items():
        require(math.isfinite(x) and 0 < x < 1, f"{name}={x!r}, wanted: above 0 and below 1")


def power_of_two(**named: int) -> None:
    for name, x in named.items():
        require(x > 0 and x & (x - 1) == 0, f"{name}={x!r}, wanted: a power of two")
