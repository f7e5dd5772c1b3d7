"""JSON text columns under a declared type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predspark.types import BOOL, DURATION, DYN, EITHER, EXACT, LEAST_INT, MOST_INT, NANOS, NULL, NUM, STR, ListOf, MapOf, Record, Type

REST = "_rest"
_WIDE = "decimal(38,0)"


def bound_type(t: Type) -> T.DataType:
    """The form that parse() gives a type."""
    if t == NUM:
        return EITHER
    if t == DURATION:
        return NANOS
    if isinstance(t, ListOf):
        return T.ArrayType(bound_type(t.of))
    if isinstance(t, MapOf):
        return T.MapType(bound_type(t.key) if t.key != STR else T.StringType(), bound_type(t.value))
    if isinstance(t, Record):
        fields = [T.StructField(k, bound_type(f.type)) for k, f in t.fields]
        return T.StructType([*fields, T.StructField(REST, T.MapType(T.StringType(), bound_type(t.rest)))] if t.rest is not None else fields)
    return {BOOL: T.BooleanType(), STR: T.StringType(), NULL: T.BooleanType(), DYN: T.VariantType()}[t]


def parse(text: Column, t: Type, demanded: set[str] | None = None) -> Column:
    """A JSON text as a value of t, in the form bound_type(t).  What is of another kind, or missing, is NULL: an error
    for a required field, absence for an optional one.  Bad JSON, or an object with a key twice, is NULL as a whole.
    demanded: only these fields of a record at the top are parsed (the others are NULL)."""
    return _let(F.try_parse_json(text), lambda v: _value(v, t, demanded))


def bind(df: DataFrame, name: str, text: Column, t: Type, demanded: set[str] | None = None) -> DataFrame:
    """df with a column of parsed values.  The explode of one value keeps the optimizer from copying the parsing into
    every place that reads the column, so each text is parsed once."""
    return df.withColumn(name, F.explode(F.array(parse(text, t, demanded))))


def _let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c computed once."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _under(t: Type) -> Callable[[Column], Column]:
    return lambda v: _value(v, t)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _value(v: Column, t: Type, demanded: set[str] | None = None) -> Column:
    kind = _kind(v)
    get = lambda as_type: F.try_variant_get(v, "$", as_type)
    if t == DYN:
        return v
    if t == BOOL:
        return F.when(kind == "BOOLEAN", get("boolean"))
    if t == STR:
        return F.when(kind == "STRING", get("string"))
    if t == NULL:
        return F.when(F.is_variant_null(v), F.lit(True))
    if t == NUM:
        # an integer out of range is an error; one of more than 38 digits has become a double before it gets here
        none = lambda as_type: F.lit(None).cast(as_type)
        exact = lambda i: F.struct(i.cast(EXACT).alias("i"), none("double").alias("d"))
        ranged = lambda i: F.when((i >= F.lit(str(LEAST_INT)).cast(_WIDE)) & (i <= F.lit(str(MOST_INT)).cast(_WIDE)), exact(i))
        double = F.struct(none(EXACT).alias("i"), get("double").alias("d"))
        wide = F.startswith(kind, F.lit("DECIMAL(")) & F.endswith(kind, F.lit(",0)"))
        return F.when(kind == "BIGINT", exact(get("bigint"))).when(wide, _let(get(_WIDE), ranged)).when((kind == "DOUBLE") | (kind == "FLOAT") | F.startswith(kind, F.lit("DECIMAL(")), double)
    if t == DURATION:
        from predspark.operators.lower import parsed_duration

        return parsed_duration(F.when(kind == "STRING", get("string")))
    if isinstance(t, ListOf):
        return F.when(kind.startswith("ARRAY"), F.transform(get("array<variant>"), lambda x: _value(x, t.of)))
    if isinstance(t, MapOf):
        return F.when(kind.startswith("OBJECT"), F.transform_values(get("map<string,variant>"), lambda k, x: _value(x, t.value)))
    if isinstance(t, Record):
        fields = []
        for k, f in t.fields:
            dt = bound_type(f.type)
            own = _let(F.try_variant_get(v, f"$['{k}']", "variant"), _under(f.type)) if demanded is None or k in demanded else F.lit(None).cast(dt)
            fields.append(own.alias(k))
        if t.rest is not None:
            declared = [k for k, _ in t.fields]
            rest = F.map_filter(get("map<string,variant>"), lambda k, x: ~k.isin(*declared) if declared else F.lit(True))
            fields.append(F.transform_values(rest, lambda k, x: _value(x, t.rest)).alias(REST))
        return F.when(kind.startswith("OBJECT"), F.struct(*fields))
    raise TypeError(f"{t} cannot come from JSON")


__all__ = ["bind", "bound_type", "parse"]
