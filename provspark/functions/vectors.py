"""Functions on feature vectors: dense (``array<double>``) or sparse (a struct of ``positions`` and ``values``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zero_ranges(vector: Column, ranges) -> Column:
    """Set every half-open ``[start, stop)`` range of the vector to 0.0."""
    ranges = sorted((int(a), int(b)) for a, b in ranges)
    if not ranges:
        return vector

    def patched(x, i):
        inside = F.lit(False)
        for start, stop in ranges:
            inside = inside | ((i >= start) & (i < stop))
        return F.when(inside, F.lit(0.0)).otherwise(x)

    return F.transform(vector, patched)


def is_sparse(df: DataFrame, column: str = "features") -> bool:
    return isinstance(df.schema[column].dataType, T.StructType)


def zero_sparse_ranges(vector: Column, ranges) -> Column:
    """Take the positions of every range out of a sparse vector."""
    ranges = sorted((int(a), int(b)) for a, b in ranges)
    if not ranges:
        return vector

    def inside(pair):
        hit = F.lit(False)
        for start, stop in ranges:
            hit = hit | ((pair.positions >= start) & (pair.positions < stop))
        return hit

    left = F.filter(F.arrays_zip(vector.positions.alias("positions"), vector["values"].alias("values")), lambda x: ~inside(x))
    return F.struct(F.transform(left, lambda x: x.positions).alias("positions"), F.transform(left, lambda x: x["values"]).alias("values"))


def zeroed(df: DataFrame, ranges, column: str = "features") -> Column:
    """The vector of a table with the ranges at 0, whichever form it has."""
    return (zero_sparse_ranges if is_sparse(df, column) else zero_ranges)(F.col(column), ranges)


def micro_text(vector: Column) -> Column:
    """Vector as comma-separated integers in units of 1e-6, for comparing and exporting."""
    return F.concat_ws(
        ",", F.transform(vector, lambda x: F.round(x * 1e6).cast("long").cast("string"))
    )
