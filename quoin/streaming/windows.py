"""Arrays that arrive as streams: running reductions over windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reduce import min_agg, var_agg


def read_stream(spark, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A Parquet folder as a stream; max_files bounds a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def window_reductions(stream: DataFrame, time: str, value: str, width: str, late: str, keys: list[str] = []) -> DataFrame:
    """n, sum, mean, var, min and max of a value per window (and keys); rows later than `late` are left out."""
    v = F.col(value).cast("double")
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # a watermark takes no time without a zone
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    out = grouped.agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), var_agg(0)(v).alias("var"), min_agg(v).alias("min"), F.max(v).alias("max"))
    return out.select(F.col("w.start").alias("start"), *keys, "n", "sum", "mean", "var", "min", "max")
