"""Durations as text."""

from __future__ import annotations

import re
from fractions import Fraction

from predspark.plans.ast import Span

#: Nanoseconds of a unit.  Fixed values.
UNITS = {"h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "µs": 1_000, "ns": 1}
#: The longest duration, ten thousand years.  Fixed value.
MOST_SECONDS = 315_576_000_000
_part = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|h|m|s)")


def in_range(ns: int) -> bool:
    return abs(ns) <= MOST_SECONDS * 1_000_000_000


def parse(text: str) -> Span | None:
    """The duration at the start of a text, as 1h30m, -1.5s or 0; what follows it is ignored.  None if there is none,
    or it is out of range."""
    sign = -1 if text[:1] == "-" else 1
    at = 1 if text[:1] in ("-", "+") else 0
    total, found = Fraction(0), False
    while m := _part.match(text, at):
        total += Fraction(m[1]) * UNITS[m[2]]
        at, found = m.end(), True
    if not found:
        return Span(0) if text[at : at + 1] == "0" else None
    ns = sign * int(total)
    return Span(ns) if in_range(ns) else None


def spell(span: Span) -> str:
    """A text that parse() reads back."""
    ns, out = abs(span.ns), ""
    for unit, size in (("h", UNITS["h"]), ("m", UNITS["m"]), ("s", UNITS["s"]), ("ms", UNITS["ms"]), ("us", 1000), ("ns", 1)):
        n, ns = divmod(ns, size)
        if n:
            out += f"{n}{unit}"
    return ("-" if span.ns < 0 else "") + (out or "0s")
