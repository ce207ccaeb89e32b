"""The temporal audit on a stream: leaky rows, and their number a window of label time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import q


def leaky_rows(stream: DataFrame, feature_time: str, label_time: str = "label_time") -> DataFrame:
    """Rows whose feature time is not before the label time; stateless."""
    return stream.where(q(feature_time).isNotNull() & (q(feature_time) >= q(label_time)))


def leaks_by_window(stream: DataFrame, feature_time: str, label_time: str = "label_time", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """window start, n_rows and n_leaky; windows close once ``late`` behind the newest label time."""
    leaky = q(feature_time).isNotNull() & (q(feature_time) >= q(label_time))
    rows = stream.select(q(label_time).cast("timestamp").alias("__t"), leaky.alias("__leaky")).withWatermark("__t", late)
    counts = rows.groupBy(F.window("__t", window)).agg(F.count("*").alias("n_rows"), F.count_if("__leaky").alias("n_leaky"))
    return counts.select(F.col("window.start").alias("window_start"), "n_rows", "n_leaky")
