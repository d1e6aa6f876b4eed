"""Rounding that does not depend on the order in which doubles were added."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """Round half up after taking binary noise off the ninth decimal."""
    return F.round(F.round(value, 9), digits)
