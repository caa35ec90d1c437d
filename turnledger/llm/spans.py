"""Positions of pattern matches as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnledger.llm.common import let

RUN = 64


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array of numbers, run by run, so that long arrays stay cheap."""
    def add(a, b):
        return a + b

    zero = F.lit(0).cast("long")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")),
                       lambda b: F.aggregate(F.slice(values, b * RUN + 1, RUN), zero, add))
    heads = let(runs, lambda r: F.transform(r, lambda _, i: F.aggregate(F.slice(r, 1, i), zero, add)))
    sums = let(heads, lambda h: F.transform(values, lambda _, i: F.get(h, F.floor(i / RUN).cast("int")) + F.aggregate(
        F.slice(values, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN + 1), zero, add)))
    return F.when(F.size(values) > 0, sums).otherwise(F.array().cast("array<bigint>"))


def place_spans(text: Column, regex: Column, found: Column) -> Column:
    """``array<struct<start, end, found>>`` of the matches ``found`` (at least one) of ``regex``, in code points.

    The text between the matches gives their places: the match after k gaps starts where those gaps and the k
    matches among them end.
    """
    steps = F.zip_with(F.slice(F.split(text, regex, -1), 1, F.size(found)), found, lambda gap, m: (F.length(gap) + F.length(m)).cast("long"))
    ends = let(steps, running_sums)
    return F.zip_with(found, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("found")))


def find_spans(text: Column, pattern: Column | str) -> Column:
    """``array<struct<start, end, found>>`` of the leftmost non-overlapping matches, in code points, end exclusive.

    A pattern must not match the empty text.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    return let(F.regexp_extract_all(text, regex, F.lit(0)), lambda found: F.when(F.size(found) > 0, place_spans(text, regex, found)).otherwise(
        F.array().cast("array<struct<start: bigint, end: bigint, found: string>>")))
