"""Errors of arguments, raised before any job runs. Data that a group can't be computed from gives nulls and a status instead."""

from __future__ import annotations


class StatError(ValueError):
    """Base of all argument errors."""


class EmptyInput(StatError):
    """No rows."""


class AllNaN(StatError):
    """No row that isn't missing."""


class TooFewObservations(StatError):
    """Fewer rows than needed."""

    def __init__(self, needed: int, got: int) -> None:
        super().__init__(f"needs {needed} observations, got {got}")
        self.needed, self.got = needed, got


class MismatchedLengths(StatError):
    """Two inputs of unequal length."""


class DomainError(StatError):
    """A value outside the domain of a function."""


class ProbabilityOutOfRange(StatError):
    """A probability outside [0, 1]."""


def check_level(level: float) -> float:
    """A confidence level in the open interval (0, 1)."""
    if not 0 < level < 1:
        raise ProbabilityOutOfRange(f"level {level} isn't in (0, 1)")
    return level
