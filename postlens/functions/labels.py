"""Label extraction (C8) and the agreement flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Agreement flag texts.
AGREE = "Agree"
DISAGREE = "Disagree"


def first_label(annotation: Column | str = "sentiment") -> Column:
    """The first annotation's ``result``; null for an empty or null array.

    ``get`` rather than ``[0]``: under ANSI mode ``[0]`` raises on empty arrays.
    """
    c = F.col(annotation) if isinstance(annotation, str) else annotation
    return F.get(c.getField("result"), 0)


def agreement(s1: Column | str = "sentiment1", s2: Column | str = "sentiment2") -> Column:
    """``Agree`` when both labels are equal; a missing label disagrees."""
    a = F.col(s1) if isinstance(s1, str) else s1
    b = F.col(s2) if isinstance(s2, str) else s2
    return F.when(a == b, F.lit(AGREE)).otherwise(F.lit(DISAGREE))
