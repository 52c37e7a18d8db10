"""Scalar functions beside Spark's own: rounding, nested arrays, names of files and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_away(v: Column, digits: int = 0) -> Column:
    """Half away from zero, for either sign."""
    return F.signum(v) * F.round(F.abs(v), digits)


def squeezed(a: Column) -> Column:
    """An array of one array -> that array."""
    return F.when(F.size(a) == 1, a[0]).otherwise(F.raise_error(F.lit("more than one to drop")))


def transposed(a: Column) -> Column:
    """Rows become columns."""
    return F.transform(F.sequence(F.lit(1), F.size(a[0])), lambda i: F.transform(a, lambda row: F.element_at(row, i)))


def reshaped(flat: Column, width: int) -> Column:
    """A flat array in rows of ``width``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(flat) - 1) / width).cast("int")), lambda i: F.slice(flat, i * width + 1, width))


def stacked(*arrays: Column) -> Column:
    """Elements side by side: one array for each place."""
    return F.transform(F.sequence(F.lit(1), F.size(arrays[0])), lambda i: F.array(*(F.element_at(a, i) for a in arrays)))


def reader_of(path: Column) -> Column:
    """Which reader a file name asks for."""
    low = F.lower(path)
    return F.when(low.endswith(".npz"), "npz").when(low.endswith(".tif") | low.endswith(".tiff"), "tiff").when(low.endswith(".mat"), "mat").otherwise("npy")


def token_of(name: str, ident: Column, digits: int = 6) -> Column:
    """name_000123"""
    return F.format_string(f"{name}_%0{digits}d", ident)
