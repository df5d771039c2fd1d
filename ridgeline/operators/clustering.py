"""Tables whose files hold neighbouring rows by several columns, and reads that pick files before the scan.

Rows are ordered by the interleaved bits of their places among the quantiles of up to four columns, and dealt to files by ranges
of that order; so a file spans a small part of each column, whatever the others' values. Least and greatest values of each file
are kept in a small table, and a read with ranges opens only files that can hold a match.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.operators.store import Store

#: Bits of a column's place, so 2**BITS - 1 quantiles a column.
BITS = 5


def _ordered(column: str, kind: T.DataType) -> Column:
    """A value whose quantiles can be asked for, in the order of the column: of text its first six bytes as a number."""
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("long")
    return F.col(column)


def _place(key: Column, bounds: list, kind: T.DataType, code: Callable[[int], int]) -> Column:
    """The code of how many of the sorted bounds the value has reached, by bisection; null has reached none."""
    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(code(low)).cast("long")
        middle = (low + high + 1) // 2
        return F.when(key >= F.lit(bounds[middle - 1]).cast(kind), within(middle, high)).otherwise(within(low, middle - 1))

    return within(0, len(bounds))


def interleaved(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column:
    """The interleaved bits of the columns' places among their quantiles; null is placed first. The quantiles are asked for at once: at most 4 * 2**bits values."""
    if not 1 <= len(columns) <= 4:
        raise ValueError("one to four columns")
    keys = [_ordered(c, df.schema[c].dataType) for c in columns]
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(key, shares, 10_000).alias(f"q{k}") for k, key in enumerate(keys)]).first()
    out = F.lit(0).cast("long")
    for k, key in enumerate(keys):
        kind = df.schema[columns[k]].dataType
        spread = lambda n, k=k: sum((n >> bit & 1) << bit * len(keys) + k for bit in range(bits))
        out = out + _place(key, sorted(set(found[k] or ())), T.LongType() if isinstance(kind, T.StringType) else kind, spread)
    return out


def cluster(store: Store, name: str, rows: DataFrame, columns: Sequence[str], files: int) -> int:
    """Replaces a table by the rows in about as many files; its version. Rows that are alike in all columns are dealt by a hash, so no value makes a large file."""
    placed = rows.withColumns({"__place": interleaved(rows, columns), "__hash": F.xxhash64(*rows.columns)})
    ordered = ["__place", *columns, "__hash"]
    version = store.replace(name, placed.repartitionByRange(files, *ordered).sortWithinPartitions(*ordered).select(*rows.columns))
    by_file = store.read(name).groupBy(F.col("_metadata.file_path").alias("file"))
    bounds = by_file.agg(*[f(c).alias(f"{side}_{c}") for c in columns for side, f in (("least", F.min), ("most", F.max))], F.count(F.lit(1)).alias("rows"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{store.root}/{name}/_bounds/{version:08d}")
    return version


def read_ranges(store: Store, name: str, ranges: dict[str, tuple]) -> DataFrame:
    """The rows whose columns lie in the ranges (low, high), ends included, None being open. Only files whose bounds meet all ranges are opened."""
    now = store.current(name)
    bounds = store.spark.read.parquet(f"{store.root}/{name}/_bounds/{now['version']:08d}")
    fits, inside = F.lit(True), F.lit(True)
    for c, (low, high) in ranges.items():
        if low is not None:
            fits, inside = fits & (F.col(f"most_{c}") >= F.lit(low)), inside & (F.col(c) >= F.lit(low))
        if high is not None:
            fits, inside = fits & (F.col(f"least_{c}") <= F.lit(high)), inside & (F.col(c) <= F.lit(high))
    picked = [r["file"] for r in bounds.filter(fits).select("file").collect()]  # names of the files to open
    schema = store.schema(now)
    return (store.spark.read.schema(schema).parquet(*picked) if picked else store.spark.createDataFrame([], schema)).filter(inside)
