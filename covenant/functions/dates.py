"""Dates in many forms. Built-in formats parse what they can on the JVM; only the values they miss go through Python."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from dateutil import parser
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats that are tried in order; commas and runs of white space don't matter.
FORMATS = ("MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-MM-dd", "M/d/yyyy")
#: Parts that a value doesn't name: the same on every day that a job runs.
MISSING = datetime.datetime(2000, 1, 1)


def plain(value: Column) -> Column:
    """A date by the built-in formats, else null."""
    words = F.initcap(F.trim(F.regexp_replace(F.replace(value, F.lit(","), F.lit(" ")), r"\s+", " ")))
    return F.coalesce(*[F.try_to_date(words, f) for f in FORMATS])


def lax(value: str | None) -> datetime.date | None:
    """A date in a form that people write ("Sept. 3rd, 2001", "3 of May 2001"): month first where both fit; null if it is none."""
    try:
        return parser.parse(value, default=MISSING).date()
    except (ValueError, OverflowError, TypeError):
        return None


def with_date(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows with a date column for the strings in value: built-in formats first, a lax reading of each distinct value they miss."""
    known = rows.withColumn(name, plain(F.col(value)))
    done = known.where(F.col(name).isNotNull() | F.col(value).isNull())
    left = known.where(F.col(name).isNull() & F.col(value).isNotNull()).drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            yield pa.RecordBatch.from_arrays([values, pa.array([lax(v) for v in values.to_pylist()], pa.date32())], names=["__value", name])

    read = left.select(F.col(value).alias("__value")).distinct().mapInArrow(run, f"__value string, `{name}` date")
    return done.unionByName(left.join(read, left[value] == read["__value"], "left").drop("__value"))
