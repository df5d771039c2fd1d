"""Schema evolution: additive sync of tables, and full alignment of incremental targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_fields(target: T.StructType, source: T.StructType) -> list[T.StructField]:
    """Fields of the source that the target lacks; dropped and retyped columns are left alone."""
    return [f for f in source if f.name not in target.names]


def sync_report(target: T.StructType | None, source: T.StructType) -> str:
    if target is None:
        return "final_table_created_or_pending"
    new = missing_fields(target, source)
    return "added:" + ",".join(f.name for f in new) if new else "no_changes"


def with_fields(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields}) if fields else df


def align(target: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the union of their columns, the target's first; absent ones are null."""
    target = with_fields(target, missing_fields(target.schema, source.schema))
    source = with_fields(source, missing_fields(source.schema, target.schema))
    return target, source.select(*target.columns)


def sync_all(target: DataFrame, source: DataFrame) -> DataFrame:
    """The target with exactly the source's columns: new ones are null, others go."""
    return with_fields(target, missing_fields(target.schema, source.schema)).select(*source.columns)
