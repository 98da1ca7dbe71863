"""Feature keys, dates and small scalar helpers."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x01"
INTERCEPT = "(INTERCEPT)"
EPSILON = 1e-12
#: A sparse vector as Spark holds it here.
VECTOR = "array<struct<idx:int,val:double>>"
#: A named feature as it is read and written.
NAMED = "array<struct<name:string,term:string,value:double>>"


def key(name: Column, term: Column) -> Column:
    return F.concat(name, F.lit(SEPARATOR), F.coalesce(term, F.lit("")))


def name_of(k: Column) -> Column:
    return F.substring_index(k, SEPARATOR, 1)


def term_of(k: Column) -> Column:
    return F.regexp_replace(k, "^[^\\x01]*\\x01?", "")


def dot(vector: Column, coefficients: list[float]) -> Column:
    """x . b for a sparse vector column and literal coefficients (a model of bounded width)."""
    table = F.array(*(F.lit(float(c)) for c in coefficients))
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x["val"] * F.coalesce(F.get(table, x["idx"]), F.lit(0.0)))


def dense(*columns: str) -> Column:
    """Sparse vector column of numeric columns, in order."""
    return F.array(*(F.struct(F.lit(i).alias("idx"), F.col(c).cast("double").alias("val")) for i, c in enumerate(columns)))


def almost_zero(c: Column) -> Column:
    return F.abs(c) < EPSILON


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1: which is larger, with what differs by less than EPSILON taken as equal."""
    return F.when(almost_zero(a - b), 0).when(a < b, -1).otherwise(1)


def symmetric_difference(a: Column, b: Column) -> Column:
    """Elements of one array but not of both, each once."""
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


@dataclass(frozen=True)
class DateRange:
    """Inclusive range of days; ``yyyyMMdd-yyyyMMdd``, or ``start-end`` in days ago."""

    start: dt.date
    end: dt.date

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError(f"range starts after its end: {self.start} > {self.end}")

    @classmethod
    def parse(cls, text: str) -> DateRange:
        a, b = text.split("-")
        return cls(*(dt.datetime.strptime(x, "%Y%m%d").date() for x in (a, b)))

    @classmethod
    def days_ago(cls, text: str, today: dt.date | None = None) -> DateRange:
        a, b = map(int, text.split("-"))
        if min(a, b) < 0:
            raise ValueError("days ago must not be negative")
        today = today or dt.datetime.now(dt.timezone.utc).date()
        return cls(today - dt.timedelta(days=a), today - dt.timedelta(days=b))

    def days(self) -> list[dt.date]:
        return [self.start + dt.timedelta(days=i) for i in range((self.end - self.start).days + 1)]

    def paths(self, base: str) -> list[str]:
        return [f"{base}/{d:%Y/%m/%d}" for d in self.days()]
