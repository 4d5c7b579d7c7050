"""Binary labels: 0 is benign, 1 is attack."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: text that a missing label turns into before it is looked up in the benign list.
MISSING_TEXT = "nan"

# Fixed value: white space stripped from both ends of a label.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def binary_label(label: Column, benign: Iterable[object]) -> Column:
    """0 when the trimmed, lower-cased text of the label is in the benign list, otherwise 1.

    A missing label counts as attack, since it is not in the list.
    """
    wanted = sorted({str(v).strip().lower() for v in benign})
    text = F.lower(F.regexp_replace(F.coalesce(label.cast("string"), F.lit(MISSING_TEXT)), _EDGE_SPACE, ""))
    return (~text.isin(wanted)).cast("int")


def literal_label(label: Column, benign: str) -> Column:
    """0 when the label equals one literal, otherwise 1."""
    return F.when(label == F.lit(benign), 0).otherwise(1)


def integer_label(label: Column) -> Column:
    """A 0/1 label stored as text or number; unreadable text becomes missing."""
    return label.try_cast("int")
