"""The one number type: integers that are exact from -2**63 to 2**64 - 1, and doubles.  Python values, and Columns.

As a Column a number has up to two parts: an integer Column (bigint or decimal) and a double Column.  A part is None
where the expression can never give it; where both are there, each row has one and NULL in the other.  NULL in all
parts is an evaluation error."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predspark.errors import EvaluationError
from predspark.types import EITHER, EXACT, LEAST_INT, MOST_INT

# Python values


def compare(a, b) -> int | None:
    """-1, 0 or 1 by exact value (Python compares int and float exactly); None with a NaN."""
    if a != a or b != b:
        return None
    return (a > b) - (a < b)


def key(x) -> int | None:
    """The integer that a number is as an index or map key."""
    if isinstance(x, float):
        if not math.isfinite(x) or x != int(x):
            return None
        x = int(x)
    return x if LEAST_INT <= x <= -LEAST_INT - 1 else None


def arithmetic(op: str, a, b):
    if op == "/":
        if isinstance(a, int) and isinstance(b, int) and b and a % b == 0 and LEAST_INT <= a // b <= MOST_INT:
            return a // b
        a, b = float(a), float(b)
        if b == 0:
            return math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1, b)
        return a / b
    if isinstance(a, int) and isinstance(b, int):
        r = a + b if op == "+" else a - b if op == "-" else a * b
        if not LEAST_INT <= r <= MOST_INT:
            raise EvaluationError("overflow")
        return r
    a, b = float(a), float(b)
    try:
        return a + b if op == "+" else a - b if op == "-" else a * b
    except OverflowError:
        return math.inf


# Columns

WIDE = T.DecimalType(38, 0)
HALF = 1 << 63


@dataclass(frozen=True)
class Number:
    i: Column | None
    d: Column | None
    bits: int = 64  # of the integer part: 32 (no operation on two overflows a bigint), 63 (bigint) or 64 (decimal)
    value: int | float | None = None  # of a literal

    @classmethod
    def literal(cls, v: int | float) -> Number:
        if isinstance(v, float):
            return cls(None, F.lit(v), value=v)
        if -(1 << 31) <= v < 1 << 31:
            return cls(F.lit(v).cast("bigint"), None, 32, v)
        if -HALF <= v < HALF:
            return cls(F.lit(v).cast("bigint"), None, 63, v)
        return cls(F.lit(str(v)).cast(EXACT), None, 64, v)

    @classmethod
    def of(cls, c: Column, t: T.DataType) -> Number:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return cls(None, c if isinstance(t, T.DoubleType) else c.cast("double"))
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            return cls(c.cast("bigint"), None, 32)
        if isinstance(t, T.LongType):
            return cls(c, None, 63)
        if t == EITHER:
            return cls(c["i"], c["d"], 64)
        return cls(c.cast(EXACT), None, 64)

    @property
    def type(self) -> T.DataType:
        return EITHER if self.i is not None and self.d is not None else T.DoubleType() if self.i is None else T.LongType() if self.bits < 64 else EXACT

    def column(self, t: T.DataType | None = None) -> Column:
        """One Column of a wider or equal type."""
        t = t or self.type
        if t == EITHER:
            none = lambda kind: F.lit(None).cast(kind)
            packed = F.struct((none(EXACT) if self.i is None else self.i.cast(EXACT)).alias("i"), (none("double") if self.d is None else self.d).alias("d"))
            return F.when(self.known(), packed)
        return self.d if self.i is None else self.i.cast(t)

    def known(self) -> Column:
        """Whether there is a value."""
        parts = [p.isNotNull() for p in (self.i, self.d) if p is not None]
        return parts[0] if len(parts) == 1 else parts[0] | parts[1]

    def double(self) -> Column:
        """The nearest double."""
        parts = [p.cast("double") for p in (self.i, self.d) if p is not None]
        return parts[0] if len(parts) == 1 else F.coalesce(*parts)

    def index(self) -> Column:
        """The integer that the number is as an index or key, as a bigint; NULL if it is none."""
        out = []
        if self.i is not None:
            out.append(self.i if self.bits < 64 else F.when((self.i < F.lit(str(HALF)).cast(EXACT)) & (self.i >= F.lit(str(-HALF)).cast(EXACT)), self.i).cast("bigint"))
        if self.d is not None:
            safe = F.abs(self.d) < float(HALF)
            whole = F.when(safe, self.d.cast("bigint"))
            out.append(F.when(whole.cast("double") == self.d, whole))
        return out[0] if len(out) == 1 else F.coalesce(*out)


def exactly(c: Column) -> Column:
    """A numeric Column of any type in the form EITHER; its type is known when a plan is made, and only then matters."""
    kind = F.typeof(c)
    whole = kind.isin("tinyint", "smallint", "int", "bigint") | kind.rlike(r"^decimal\(\d+,0\)$")
    wide = c.try_cast(WIDE)
    i = F.when(whole & (wide >= F.lit(str(LEAST_INT)).cast(WIDE)) & (wide <= F.lit(str(MOST_INT)).cast(WIDE)), wide.try_cast(EXACT))
    d = F.when(~whole, c.try_cast("double"))
    return F.when(i.isNotNull() | d.isNotNull(), F.struct(i.alias("i"), d.alias("d")))


def common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds both kinds of number."""
    if a == b:
        return a
    if EITHER in (a, b) or T.DoubleType() in (a, b):
        return EITHER
    return EXACT


def exact_order(i: Column, d: Column) -> Column:
    """-1, 0 or 1 as an integer and a double compare by exact value; NULL with a NaN."""
    high = F.when(d >= float(HALF), (d - F.lit(float(HALF))).cast("bigint").cast(WIDE) + F.lit(str(HALF)).cast(WIDE)).otherwise(F.when((d < float(HALF)) & (d >= -float(HALF)), d.cast("bigint")).cast(WIDE))
    i = i.cast(WIDE)
    fraction = F.when((F.abs(d) < 2.0**52) & (d != F.floor(F.when(F.abs(d) < 2.0**52, d)).cast("double")), F.when(d > 0, -1).otherwise(1)).otherwise(0)
    inside = F.when(i < high, -1).when(i > high, 1).otherwise(fraction)
    return F.when(i.isNull() | d.isNull() | F.isnan(d), F.lit(None)).when(d >= 2.0**64, -1).when(d < -float(HALF), 1).otherwise(inside)


def _plain(v: int | float | None) -> bool:
    """A literal that is exact as a double."""
    return v is not None and v == v and abs(v) <= 1 << 53


def relation(op: str, a: Number, b: Number, accept: bool = False) -> Column:
    """a op b for == != < <= > >=; NULL is an error.  accept: only TRUE matters, so FALSE may stand for an error."""
    fn = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    cases: list[tuple[Column, Column]] = []
    for x, x_int in ((a.i, True), (a.d, False)):
        for y, y_int in ((b.i, True), (b.d, False)):
            if x is None or y is None:
                continue
            if x_int and y_int:
                r = fn(x, y)
            elif x_int or y_int:
                literal = a.value if x_int and a.value is not None else b.value if y_int else None
                small = (a.bits if x_int else b.bits) == 32
                if _plain(literal) or small:
                    r = doubles(op, fn, x.cast("double") if x_int and a.value is None else F.lit(float(a.value)) if x_int else x, y.cast("double") if y_int and b.value is None else F.lit(float(b.value)) if y_int else y, a, b, accept)
                else:
                    order = exact_order(x, y) if x_int else -exact_order(y, x)
                    r = fn(order, F.lit(0))
                    if op in ("==", "!="):
                        r = F.when(x.isNotNull() & y.isNotNull(), F.coalesce(r, F.lit(op == "!=")))
            else:
                r = doubles(op, fn, x, y, a, b, accept)
            cases.append((x.isNotNull() & y.isNotNull(), r))
    if len(cases) == 1:
        return cases[0][1]
    out = F.when(*cases[0])
    for c, r in cases[1:]:
        out = out.when(c, r)
    return out


def doubles(op: str, fn, x: Column, y: Column, a: Number, b: Number, accept: bool) -> Column:
    """Spark takes NaN for equal to itself and greater than all else; here it is unequal, and an error to order."""
    sure_a, sure_b = a.d is None or a.value is not None and a.value == a.value, b.d is None or b.value is not None and b.value == b.value
    nan = [F.isnan(v) for v, sure in ((x, sure_a), (y, sure_b)) if not sure]
    if not nan or op in ("==", "!=") and len(nan) == 1:
        return fn(x, y)
    nan = nan[0] if len(nan) == 1 else nan[0] | nan[1]
    if op in ("==", "!="):
        return F.when(nan, F.when(x.isNotNull() & y.isNotNull(), F.lit(op == "!="))).otherwise(fn(x, y))
    if accept:
        high = (not sure_a and op in (">", ">=")) or (not sure_b and op in ("<", "<="))
        return fn(x, y) & ~nan if high or len([s for s in (sure_a, sure_b) if not s]) == 2 else fn(x, y)
    return F.when(~nan, fn(x, y))


def compute(op: str, a: Number, b: Number) -> Number:
    """+ - * /"""
    i = d = None
    bits = 64
    x, y = a.i, b.i
    if x is not None and y is not None:
        if op == "/":
            small = a.bits == 32 and b.bits == 32
            quotient = real_quotient(x.cast("double"), y.cast("double"))
            if small:
                d = quotient  # below 2**32: the double is exact wherever the quotient is whole
            elif a.bits < 64 and isinstance(b.value, int) and 0 < abs(b.value) < 1 << 31:
                # the remainder of two bigints; the quotient fits but for -2**63 / -1
                i = F.when(F.pmod(x, F.lit(abs(b.value))) == 0, in_range(F.negative(x.cast(WIDE))) if b.value == -1 else F.call_function("div", x, F.lit(b.value).cast("bigint")))
                bits = 64 if b.value == -1 else 63
                d = F.when(i.isNull(), quotient)
            else:
                whole = F.when((y != 0) & (F.try_mod(x.cast(WIDE), y.cast(WIDE)) == 0), F.try_divide(x.cast(WIDE), y.cast(WIDE)).cast(WIDE))
                i = in_range(whole)
                d = F.when(i.isNull(), quotient)
        elif a.bits == 32 and b.bits == 32:
            i, bits = (x + y if op == "+" else x - y if op == "-" else x * y), 63
        else:
            x, y = x.cast(WIDE), y.cast(WIDE)
            made = F.try_add(x, y) if op == "+" else F.try_subtract(x, y) if op == "-" else F.try_multiply(x, y)
            i = in_range(made.cast(WIDE))
    if a.d is not None or b.d is not None:
        x, y = a.double(), b.double()
        r = real_quotient(x, y) if op == "/" else x + y if op == "+" else x - y if op == "-" else x * y
        if a.i is not None and b.i is not None:
            some = [n.d.isNotNull() for n in (a, b) if n.d is not None]
            r = F.when(some[0] if len(some) == 1 else some[0] | some[1], r)
        d = r if d is None else F.coalesce(r, d)
    return Number(i, d, bits)


def in_range(c: Column) -> Column:
    return F.when((c >= F.lit(str(LEAST_INT)).cast(WIDE)) & (c <= F.lit(str(MOST_INT)).cast(WIDE)), c.cast(EXACT))


def real_quotient(x: Column, y: Column) -> Column:
    """IEEE division; Spark's raises an error for a divisor of zero."""
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(F.try_divide(x, y))


def negate(a: Number) -> Number:
    if a.value is not None and not (isinstance(a.value, int) and -a.value < LEAST_INT):
        return Number.literal(-a.value)
    i = None if a.i is None else -a.i if a.bits == 32 else in_range(-a.i.cast(WIDE))
    return Number(i, None if a.d is None else -a.d, 63 if a.bits == 32 else 64)
