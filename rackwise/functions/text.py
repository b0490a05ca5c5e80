"""Column helpers for recorded command output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = ("node_id", "captured_at")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def lines(c: Column) -> Column:
    return F.split(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")


def as_int(c: Column) -> Column:
    """The whole number, or null where the text is none."""
    return strip(c).try_cast("int")


def cpu_list(c: Column, separators: str = ",") -> Column:
    """CPUs of a list such as 0-3,8 in the order given; chunks that are no number or rising range add nothing."""

    def chunk(x: Column) -> Column:
        ends = F.split(x, "-", 2)
        low, high = as_int(F.get(ends, F.lit(0))), as_int(F.element_at(ends, -1))
        return F.coalesce(F.when(low <= high, F.sequence(low, high)), F.array().cast("array<int>"))

    return F.flatten(F.transform(F.split(c, separators), chunk))
