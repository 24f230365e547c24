"""Reading and writing tables, comments, views, and counts over whole sets of tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cashtide.schemas import FACT_DATES, SCHEMAS, TABLE_COMMENTS, conform
from cashtide.session import shared_dir


class ParquetTables(Mapping):
    """Parquet tables ``<folder>/<name>.parquet`` by name, each opened when first asked for.

    A table with a declared schema is opened without a job that looks into its files.
    """

    def __init__(
        self, spark: SparkSession, folder: str, names: Iterable[str], schemas: Mapping[str, StructType] | None = None
    ):
        self._spark, self._folder, self._names = spark, folder, tuple(names)
        self._schemas = schemas or {}
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._open:
            reader = self._spark.read
            if name in self._schemas:
                reader = reader.schema(self._schemas[name])
            self._open[name] = reader.parquet(f"{self._folder}/{name}.parquet")
        return self._open[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def read_tables(
    spark: SparkSession, folder: str, names: Iterable[str], schemas: Mapping[str, StructType] | None = None
) -> Mapping[str, DataFrame]:
    return ParquetTables(spark, folder, names, schemas)


def read_catalog(spark: SparkSession, names: Iterable[str] = SCHEMAS) -> dict[str, DataFrame]:
    """Tables of the current schema by name."""
    return {name: spark.table(name) for name in names}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_schema(spark: SparkSession, name: str, comment: str, use: bool = True) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name} COMMENT {_quoted(comment)}")
    if use:
        spark.catalog.setCurrentDatabase(name)


def comment_table(spark: SparkSession, name: str, text: str, columns: Mapping[str, str] | None = None) -> None:
    spark.sql(f"COMMENT ON TABLE {name} IS {_quoted(text)}")
    for column, comment in (columns or {}).items():
        spark.sql(f"ALTER TABLE {name} ALTER COLUMN {column} COMMENT {_quoted(comment)}")


def write_table(
    df: DataFrame, name: str, partition_by: str | None = None, bucket_by: tuple[int, str] | None = None
) -> None:
    """Replace table ``name``, contents and schema.

    Partitioned writes are rebalanced first: small days share a file and a hot day is spread over
    several tasks, where a plain repartition would send it to one. Two tables bucketed alike by
    their join key are joined without a shuffle; that suits keys none of which is hot, since a
    bucket is read by one task.
    """
    if partition_by:
        df = df.hint("rebalance", F.col(partition_by))
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if bucket_by:
        writer = writer.bucketBy(*bucket_by).sortBy(bucket_by[1])
    writer.saveAsTable(name)


def save_model(tables: Mapping[str, DataFrame], schema: str | None = None) -> None:
    """Write model tables in their declared types, facts by date, with all comments, into a schema or the current one."""
    for name, df in tables.items():
        full = name if schema is None else f"{schema}.{name}"
        write_table(conform(df, SCHEMAS[name]), full, FACT_DATES.get(name))
        comment_table(df.sparkSession, full, TABLE_COMMENTS[name])


def saved_copy(tables: Mapping[str, DataFrame]) -> tuple[str, dict[str, DataFrame]]:
    """The name of a new schema in the shared folder, and tables written there by ``save_model``, read back by name.

    Each call has a schema of its own, to be dropped with ``DROP SCHEMA ... CASCADE`` when it is no
    longer read. Facts come back partitioned by date, so that a condition on their date reads the
    folders of those days and no others.
    """
    spark = next(iter(tables.values())).sparkSession
    schema = f"model_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {schema} LOCATION {_quoted(f'{shared_dir(spark)}/cashtide/{schema}')}")
    save_model(tables, schema)
    return schema, {name: spark.table(f"{schema}.{name}") for name in tables}


def create_view(spark: SparkSession, name: str, query: str, comment: str) -> None:
    """Create or replace a stored view."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} COMMENT {_quoted(comment)} AS {query}")


def register_views(frames: Mapping[str, DataFrame]) -> None:
    """Make frames available to SQL in this session under their names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def stacked(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of frames that share their column names."""
    return reduce(DataFrame.unionByName, frames)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, rows)``, by name."""
    counts = (
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    )
    return stacked(counts).orderBy("table_name")


def date_ranges(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(fact, from_date, to_date)`` for each name's frame and date column."""
    ranges = (
        df.agg(F.min(column).alias("from_date"), F.max(column).alias("to_date")).select(
            F.lit(name).alias("fact"), "from_date", "to_date"
        )
        for name, (df, column) in tables.items()
    )
    return stacked(ranges).orderBy("fact")
