"""Declarative column contracts, compiled to Catalyst expressions.

A contract lists the canonical columns of a fact with their kind and bounds. It gives the projection that canonicalises any
source with those columns, one predicate per rule (so that a rejected row can name its reasons), and the output schema. Range
rules are written against the plain cast columns, before signed zeros are evened out, so that they reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"int": T.LongType(), "float": T.DoubleType(), "timestamp": T.TimestampNTZType(), "string": T.StringType()}
#: A double in this range has a 64-bit integer.
LOWEST, BEYOND = -(2.0**63), 2.0**63


@dataclass(frozen=True)
class Field:
    """A canonical column. low and high bound it, inclusively unless above or below says otherwise; allowed lists its values."""

    name: str
    kind: str
    low: object = None
    high: object = None
    above: object = None
    below: object = None
    allowed: tuple = ()

    def cast(self, column: Column) -> Column:
        """The column as its kind; numbers pass through double. What can't be read is null."""
        if self.kind in ("int", "float"):
            return column.try_cast("double")
        if self.kind == "timestamp":
            return column.try_cast("timestamp_ntz")
        text = column.cast("string")
        return F.upper(F.trim(text)) if self.allowed else text

    def rules(self) -> dict[str, Column]:
        """Predicates on the cast column by name. Null satisfies none of them."""
        c, found = F.col(f"`{self.name}`"), {}
        found["present"] = c.isNotNull()
        if self.kind in ("int", "float"):
            found["finite"] = ~F.isnan(c) & (F.abs(c) < float("inf"))
        if self.kind == "int":
            found["integral"] = (F.rint(c) == c) & (c >= LOWEST) & (c < BEYOND)
        for name, bound, test in (("low", self.low, "__ge__"), ("high", self.high, "__le__"), ("above", self.above, "__gt__"), ("below", self.below, "__lt__")):
            if bound is not None:
                found[name] = getattr(c, test)(F.lit(bound))
        if self.allowed:
            found["allowed"] = c.isin(*self.allowed)
        return found

    def final(self) -> Column:
        """The canonical value of a cast column that satisfies the rules: integers as such, zeros without a sign."""
        c = F.col(f"`{self.name}`")
        if self.kind == "int":
            return c.try_cast("bigint").alias(self.name)
        return (c + F.lit(0.0) if self.kind == "float" else c).alias(self.name)


def resolve(names: list[str], wanted: list[str]) -> dict[str, str]:
    """The source's name of each wanted column, whatever its case (the last, if several fit). All missing ones are named at once."""
    found = {name.lower(): name for name in names}
    if missing := [name for name in wanted if name.lower() not in found]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return {name: found[name.lower()] for name in wanted}


@dataclass(frozen=True)
class Contract:
    """fields in output order; pairs: further rules by name, as functions that give a predicate on several cast columns."""

    fields: tuple[Field, ...]
    pairs: tuple[tuple[str, Callable[[], Column]], ...] = ()

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, KINDS[f.kind]) for f in self.fields])

    def project(self, df: DataFrame) -> DataFrame:
        """The canonical columns of df, cast and in order; columns that the contract doesn't name are left out."""
        actual = resolve(df.columns, self.names)
        return df.select(*(f.cast(F.col(f"`{actual[f.name]}`")).alias(f.name) for f in self.fields))

    def rules(self) -> dict[str, Column]:
        own = {f"{f.name}.{name}": rule for f in self.fields for name, rule in f.rules().items()}
        return own | {name: rule() for name, rule in self.pairs}

    def valid(self) -> Column:
        """All rules at once; null counts as false."""
        return reduce(lambda a, b: a & b, self.rules().values())

    def finish(self, df: DataFrame) -> DataFrame:
        return df.select(*(f.final() for f in self.fields))

    def clean(self, df: DataFrame) -> DataFrame:
        """Canonical rows of df that satisfy every rule."""
        return self.project(df).where(self.valid()).transform(self.finish)

    def reasons(self, df: DataFrame) -> DataFrame:
        """The cast columns, and ``reasons``: the names of the rules that a row breaks (empty: it is valid)."""
        broken = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in self.rules().items())), lambda x: x.isNotNull())
        return self.project(df).withColumn("reasons", broken)


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from one naive timestamp to another."""
    return F.timestamp_diff("MICROSECOND", start, end)


def floor_nanos(nanos: Column) -> Column:
    """Nanoseconds since 1970 as a naive timestamp, floored to microseconds, also before 1970."""
    micros = F.expr("bigint(0)") + ((nanos - F.pmod(nanos, F.lit(1000))) / 1000).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
