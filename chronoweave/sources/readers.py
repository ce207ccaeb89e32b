"""Reading tables: Parquet, CSV, in-memory rows, SQL; all lazy."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampType

from ..errors import ValidationError


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A file, a directory of part files, or a glob."""
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, delimiter: str = ",", timestamp_format: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A CSV with header; times without a zone stay without one.

    With a ``schema`` the file is read once; without one its types are inferred first.
    """
    reader = spark.read.option("header", True).option("sep", delimiter).option("prefersDate", False)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format).option("timestampNTZFormat", timestamp_format)
    before = spark.conf.get("spark.sql.timestampType")
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    try:
        return reader.csv(path)
    finally:
        spark.conf.set("spark.sql.timestampType", before)


def rows(spark: SparkSession, data: Any) -> DataFrame:
    """A Spark DataFrame as it is; pandas and Arrow tables, and what offers an Arrow stream, converted."""
    if isinstance(data, DataFrame):
        return data
    import pandas as pd
    import pyarrow as pa

    if isinstance(data, pd.DataFrame):
        before = spark.conf.get("spark.sql.timestampType")
        spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
        try:
            return spark.createDataFrame(pa.Table.from_pandas(data, preserve_index=False))
        finally:
            spark.conf.set("spark.sql.timestampType", before)
    if isinstance(data, pa.Table):
        return spark.createDataFrame(data)
    if hasattr(data, "__arrow_c_stream__"):
        return spark.createDataFrame(pa.table(data))
    raise ValidationError(f"Expected a Spark or pandas DataFrame or an Arrow table, got {type(data).__name__}.")


def sql(spark: SparkSession, query: str, views: Mapping[str, DataFrame] | None = None, timestamp: str | None = None) -> DataFrame:
    """A Spark SQL query; ``views`` are names it may use, and no other query will see.

    ``timestamp``: a column that keeps having no zone through functions that add one.
    """
    before = {}
    for name, df in (views or {}).items():
        if spark._jsparkSession.sessionState().catalog().getTempView(name).isDefined():
            before[name] = spark.table(name)
        df.createOrReplaceTempView(name)
    try:
        out = spark.sql(query)  # the plan is bound to the views here
    finally:
        for name in views or {}:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
    return zoneless(out, timestamp) if timestamp in out.columns else out


def zoneless(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the times of ``column`` without a zone if nothing it reads has times with one.

    Functions such as ``date_trunc`` give times in the session's zone whatever
    they are given; taken back in that zone they are what they were.
    """
    if not isinstance(df.schema[column].dataType, TimestampType):
        return df
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    kinds = {str(a.dataType().simpleString()) for i in range(leaves.size()) for a in _each(leaves.apply(i).output())}
    if "timestamp" in kinds or not kinds & {"timestamp_ntz", "date"}:
        return df
    return df.withColumn(column, F.col("`" + column.replace("`", "``") + "`").cast("timestamp_ntz"))


def _each(items: Any) -> list[Any]:
    return [items.apply(i) for i in range(items.size())]


def resolve(spark: SparkSession, data: Any) -> DataFrame:
    """A path (Parquet, or CSV by its suffix) or rows."""
    if isinstance(data, str) or hasattr(data, "__fspath__"):
        path = str(data)
        return csv(spark, path) if path.lower().endswith(".csv") else parquet(spark, path)
    return rows(spark, data)
