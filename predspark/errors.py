"""Errors of the expression language."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Problem:
    """One mistake in an expression: what is wrong, where (start and end offset in the authored text), and the names
    that could have been meant."""

    message: str
    start: int = 0
    end: int = 0
    available: tuple[str, ...] = ()

    def render(self, source: str) -> str:
        line_start = source.rfind("\n", 0, self.start) + 1
        line_end = source.find("\n", self.start)
        line = source[line_start : line_end if line_end >= 0 else len(source)]
        width = max(1, min(self.end, line_start + len(line)) - self.start)
        hint = f"; available: {', '.join(self.available)}" if self.available else ""
        return f"{line}\n{' ' * (self.start - line_start)}{'^' * width}\n{self.message}{hint}"


class ExpressionError(Exception):
    """A text that is no valid expression of its environment.  str() shows the first problem; all has every one."""

    def __init__(self, source: str, problems: list[Problem]) -> None:
        self.source, self.all = source, tuple(problems)
        super().__init__(problems[0].render(source))

    @property
    def first(self) -> Problem:
        return self.all[0]


class SyntaxProblem(ExpressionError):
    """The text cannot be parsed."""


class CheckProblem(ExpressionError):
    """The text parses but does not fit the declared types, presence rules or bounds."""


class SpecializeProblem(Exception):
    """Known values do not fit, or a read of one would be left over."""


class EvaluationError(Exception):
    """The value of an expression is an error."""


class Pending(Exception):
    """Evaluation needs an input that has not arrived."""
