"""Files laid out so that a scan skips what a query does not ask for, whichever of several columns it filters by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(df: DataFrame, columns: list[str], bits: int) -> dict[str, list]:
    """For each column at most 2 ** bits - 1 values that part its rows about evenly; one pass, one row."""
    shares = [k / 2**bits for k in range(1, 2**bits)]
    found = df.agg(*[F.percentile_approx(c, shares).alias(c) for c in columns]).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def rank(column: Column, cuts: list) -> Column:
    """How many of the cuts are not above a value, by halving; 0 for null."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    above = rank(column, cuts[middle + 1 :]) + F.lit(middle + 1)
    return F.when(column >= F.lit(cuts[middle]), above).otherwise(rank(column, cuts[:middle]))


def curve(ranks: list[Column], bits: int) -> Column:
    """Place on a Z-order curve: the ranks' bits in turn, highest first. Near places have near ranks in every column."""
    n = len(ranks)
    bit = lambda r, i: F.shiftright(r, i).bitwiseAND(F.lit(1)).cast("long")
    return reduce(Column.bitwiseOR, [F.shiftleft(bit(r, i), i * n + n - 1 - k) for k, r in enumerate(ranks) for i in range(bits)])


def write_clustered(df: DataFrame, path: str, columns: list[str], bits: int = 6, bloom: list[str] = [], row_group_bytes: int = 32 << 20, **options: str) -> None:
    """df as Parquet along a Z-order curve of columns, so that files and row groups have narrow ranges of all of them, with Bloom
    filters on the columns of bloom, for values that lie within a range but not in the group.

    Cut points come from df's own distribution, so skewed columns are parted evenly as well; rows are dealt to files by range
    of the curve, and Spark's sampled bounds split hot places by size. Nulls come first. df is read twice.
    """
    if bits * len(columns) > 62:
        raise ValueError("too many bits for a place on the curve")
    cuts = cut_points(df, columns, bits)
    place = curve([rank(F.col(c), cuts[c]) for c in columns], bits)
    rows = df.withColumn("_place", place).repartitionByRange("_place", *columns).sortWithinPartitions("_place", *columns).drop("_place")
    for c in bloom:
        options |= {f"parquet.bloom.filter.enabled#{c}": "true"}
    rows.write.options(**{"parquet.block.size": str(row_group_bytes)}, **options).parquet(path)

