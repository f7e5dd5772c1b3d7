"""Functions of the caller."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from predspark.types import EITHER, LEAST_INT, MOST_INT, NUM, Type, to_spark


@dataclass(frozen=True)
class Host:
    """A typed function.  columns: Columns -> Column, which stays inside Spark's engine; python: values -> value, run
    in Arrow batches, an exception making the row's value an error.  With neither, it is bound for each program.

    Numbers keep their kind: a bigint or decimal Column where the expression has one, int or float in Python, and
    whatever of these comes back."""

    params: tuple[Type, ...]
    result: Type
    member: bool = False
    columns: Callable[..., Column] | None = None
    python: Callable[..., Any] | None = None

    def result_type(self) -> T.DataType:
        return EITHER if self.result == NUM else to_spark(self.result)

    def in_python(self, args: list[Column]) -> Column:
        """The call in Arrow batches; numbers come as structs of an integer and a double."""
        kind = self.result_type()
        if self.python is None:
            return F.lit(None).cast(kind)
        fn, numbers, number = self.python, [p == NUM for p in self.params], self.result == NUM

        def given(v: Any, is_number: bool) -> Any:
            if not is_number or v is None:
                return v
            return int(v["i"]) if v["i"] is not None and v["i"] == v["i"] else v["d"]

        def back(v: Any) -> Any:
            if not number or v is None:
                return v
            if isinstance(v, int) and not isinstance(v, bool):
                return {"i": Decimal(v), "d": None} if LEAST_INT <= v <= MOST_INT else None
            return {"i": None, "d": float(v)}

        def one(*values: Any) -> Any:
            own = [given(v, n) for v, n in zip(values, numbers, strict=True)]
            if any(v is None for v in own):
                return None
            try:
                return back(fn(*own))
            except Exception:
                return None

        arrow = pa.struct([("i", pa.decimal128(20, 0)), ("d", pa.float64())]) if number else None

        def run(*columns: pa.Array) -> pa.Array:
            return pa.array([one(*v) for v in zip(*[c.to_pylist() for c in columns], strict=True)], arrow or to_arrow_type(kind))

        return F.arrow_udf(run, kind)(*args)
