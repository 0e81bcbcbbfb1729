"""Average hash of gray pixel arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def average_hash(pixels: Column) -> Column:
    """64 gray values -> a string of 0 and 1: which exceed their mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / 64
    return F.array_join(F.transform(pixels, lambda x: F.when(x > mean, F.lit("1")).otherwise(F.lit("0"))), "")


def hamming(a: Column, b: Column) -> Column:
    """Places at which two equally long strings differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def mismatched(main_w: Column, main_h: Column, thumb_w: Column, thumb_h: Column, main: Column, thumb: Column) -> Column:
    """Whether a thumbnail differs from its picture: aspect by more than 0.15 or hash by more than 12 of 64."""
    return (F.abs(main_w / main_h - thumb_w / thumb_h) > 0.15) | (hamming(average_hash(main), average_hash(thumb)) > 12)
