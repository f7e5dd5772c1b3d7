"""Static types of the expression language, and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Type:
    def __str__(self) -> str:
        return type(self).__name__.lower()


@dataclass(frozen=True)
class Scalar(Type):
    name: str

    def __str__(self) -> str:
        return self.name


BOOL, NUM, STR, BYTES, NULL, DURATION, DYN = (Scalar(n) for n in ("bool", "double", "string", "bytes", "null", "duration", "dyn"))


@dataclass(frozen=True)
class ListOf(Type):
    of: Type

    def __str__(self) -> str:
        return f"list({self.of})"


@dataclass(frozen=True)
class MapOf(Type):
    """A map.  total: the declarer promises that every key which can be named reads as a value."""

    key: Type
    value: Type
    total: bool = False

    def __str__(self) -> str:
        return f"{'unsafe_map' if self.total else 'map'}({self.key}, {self.value})"


@dataclass(frozen=True)
class Field:
    type: Type
    optional: bool = False


@dataclass(frozen=True)
class Record(Type):
    """Named fields in order; rest is the type of keys that are not declared, if they may be read."""

    fields: tuple[tuple[str, Field], ...]
    rest: Type | None = None
    name: str = "record"

    @classmethod
    def of(cls, name: str = "record", rest: Type | None = None, **fields: Type | Field) -> Record:
        return cls(tuple((k, v if isinstance(v, Field) else Field(v)) for k, v in fields.items()), rest, name)

    def get(self, key: str) -> Field | None:
        for k, f in self.fields:
            if k == key:
                return f
        return Field(self.rest, True) if self.rest is not None else None

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Unusable(Type):
    """A position whose values the language has no type for."""

    why: str = field(default="")

    def __str__(self) -> str:
        return f"unusable ({self.why})"


@dataclass(frozen=True)
class EmptyElement(Type):
    """The element of an empty literal until its use gives it a type."""

    def __str__(self) -> str:
        return "nothing"


NOTHING = EmptyElement()


def optional(t: Type) -> Field:
    return Field(t, True)


def same(a: Type, b: Type) -> bool:
    """Whether two types have one shape; what is optional and which record it is do not matter."""
    if NOTHING in (a, b):
        return True
    if isinstance(a, ListOf) and isinstance(b, ListOf):
        return same(a.of, b.of)
    if isinstance(a, MapOf) and isinstance(b, MapOf):
        return same(a.key, b.key) and same(a.value, b.value)
    if isinstance(a, Record) and isinstance(b, Record):
        return [k for k, _ in a.fields] == [k for k, _ in b.fields] and all(same(x.type, y.type) for (_, x), (_, y) in zip(a.fields, b.fields, strict=True))
    return a == b


def join(a: Type, b: Type) -> Type:
    """The more telling of two types of one shape."""
    if a == NOTHING:
        return b
    if isinstance(a, ListOf) and isinstance(b, ListOf):
        return ListOf(join(a.of, b.of))
    if isinstance(a, MapOf) and isinstance(b, MapOf):
        return MapOf(join(a.key, b.key), join(a.value, b.value), a.total and b.total)
    return a


def holds(t: Type, kind: type | Type) -> bool:
    """Whether a type is, or is made of, the other."""
    if t == kind or isinstance(kind, type) and isinstance(t, kind):
        return True
    if isinstance(t, ListOf):
        return holds(t.of, kind)
    if isinstance(t, MapOf):
        return holds(t.value, kind)
    return False


#: Integers that are held exactly.
LEAST_INT, MOST_INT = -(1 << 63), (1 << 64) - 1
#: The physical form of a number that is an integer in some rows and a double in others.
EITHER = T.StructType([T.StructField("i", T.DecimalType(20, 0)), T.StructField("d", T.DoubleType())])
EXACT = T.DecimalType(20, 0)
NANOS = T.DecimalType(21, 0)
INTERVAL = T.DayTimeIntervalType()


def from_spark(t: T.DataType, name: str = "record", required: frozenset[str] = frozenset(), path: str = "") -> Type:
    """The type of a column.  A nullable struct field is optional unless its dotted path is in required."""
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)) or isinstance(t, T.DecimalType) and t.scale == 0 and t.precision <= 20 or t == EITHER:
        return NUM
    if isinstance(t, T.StringType):
        return STR
    if isinstance(t, T.BinaryType):
        return BYTES
    if isinstance(t, T.DayTimeIntervalType):
        return DURATION
    if isinstance(t, T.ArrayType):
        return ListOf(from_spark(t.elementType, name, required, path))
    if isinstance(t, T.MapType):
        return MapOf(from_spark(t.keyType), from_spark(t.valueType, name, required, path))
    if isinstance(t, T.VariantType):
        return DYN
    if isinstance(t, T.StructType):
        return Record(tuple((f.name, Field(from_spark(f.dataType, f.name, required, f"{path}{f.name}."), f.nullable and f"{path}{f.name}" not in required)) for f in t.fields), None, name)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Unusable("there are no instants, only durations")
    return Unusable(f"no type for {t.simpleString()}")


def to_spark(t: Type) -> T.DataType:
    """The form in which values of a type are declared; numbers are doubles."""
    plain = {BOOL: T.BooleanType(), NUM: T.DoubleType(), STR: T.StringType(), BYTES: T.BinaryType(), NULL: T.BooleanType(), DURATION: INTERVAL, DYN: T.VariantType(), NOTHING: T.BooleanType()}
    if t in plain:
        return plain[t]
    if isinstance(t, ListOf):
        return T.ArrayType(to_spark(t.of))
    if isinstance(t, MapOf):
        return T.MapType(to_spark(t.key), to_spark(t.value))
    if isinstance(t, Record):
        return T.StructType([T.StructField(k, to_spark(f.type), True) for k, f in t.fields])
    raise TypeError(f"{t} has no Spark type")
