"""Table contracts: columns, types, identity."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.schemas import IDENTITY, TABLE_SCHEMAS


def require_columns(df: DataFrame, required: Iterable[str], *, label: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks columns: {missing}")


def require_instants(df: DataFrame, column: str = "observed_at") -> None:
    """Reject a column that is not an unambiguous instant."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.TimestampType):
        raise ValueError(f"{column} must be an instant with a zone, got {kind.simpleString()}")


def conform(df: DataFrame, table: str | T.StructType) -> DataFrame:
    """Declared columns, types and order; a value that does not fit is an error."""
    schema = TABLE_SCHEMAS[table] if isinstance(table, str) else table
    require_columns(df, schema.fieldNames(), label="table")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def union_strict(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Concatenate frames that agree in column names and types."""
    kinds = {f.name: f.dataType for f in first.schema}
    for other in others:
        if {f.name: f.dataType for f in other.schema} != kinds:
            raise ValueError("frames to concatenate differ in columns or types")
        first = first.unionByName(other)
    return first


def duplicate_keys(df: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Identities held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def require_unique(df: DataFrame, keys: Sequence[str] = IDENTITY) -> None:
    found = duplicate_keys(df, keys).limit(1).count()
    if found:
        raise ValueError(f"rows repeat the identity {tuple(keys)}")


def system_ids(df: DataFrame) -> DataFrame:
    return df.select("system_id").distinct().orderBy("system_id")


def resolve_system_id(df: DataFrame, configured: str | None = None) -> str:
    """The configured system, or the only one in the table."""
    if configured is not None:
        return configured
    found = [row.system_id for row in df.select("system_id").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"expected exactly one system, found {len(found)} or more: {found}")
    return found[0]
