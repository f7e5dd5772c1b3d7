"""Policies that are tables: rows whose path lies at or below one of many roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column, separator: str = "/", proper: bool = False) -> Column:
    """What a path lies at or below: the path itself (unless proper) and each of its prefixes that a separator follows."""
    parts = F.split(path, f"[{separator}]", -1)
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws(separator, F.slice(parts, F.lit(1), n)))
    return F.slice(upto, F.lit(1), F.size(upto) - 1) if proper else upto


def below_roots(df: DataFrame, path: Column, roots: DataFrame, root: Column, separator: str = "/") -> DataFrame:
    """The rows of df for which some row of roots has path == root or path.startsWith(root + separator).

    An equi-join at any number of roots: a root below another root is dropped first, so at most one ancestor of a path
    is a root, and each row of df comes once, however often it is there.  Null paths and null roots match nothing."""
    named = roots.select(root.alias("_root")).where("_root is not null").distinct()
    lower = named.select("_root", F.explode(ancestors(F.col("_root"), separator, proper=True)).alias("_above"))
    lower = lower.join(named.select(F.col("_root").alias("_above")), "_above", "left_semi").select("_root").distinct()
    top = named.join(lower, "_root", "left_anti")
    packed = df.select(F.struct("*").alias("_row"), F.explode(ancestors(path, separator)).alias("_root"))
    return packed.join(top, "_root", "left_semi").select("_row.*")
