"""Reading and writing arrays: Parquet with a shape, CSV and text, local frames, Zarr where it is installed."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..darray import DArray, names
from ..operators.scan import places
from ..operators.shape import ravel, squeeze, transpose
from ..session import shared_folder, spark

_META = "shape.json"


def _hadoop(path: str):
    jvm = spark()._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark()._jsc.hadoopConfiguration())


def write(path: str, a: DArray, mode: str = "overwrite") -> None:
    """Parquet files of elements and one of the shape; any path Spark can write, with its case kept."""
    a.df.write.mode(mode).parquet(f"{path}/elements")
    meta = [(json.dumps({"shape": list(a.shape), "dtype": a.dtype}),)]
    spark().createDataFrame(meta, "value string").coalesce(1).write.mode(mode).text(f"{path}/{_META}")


def read(path: str) -> DArray:
    meta = json.loads(spark().read.text(f"{path}/{_META}").first()["value"])
    return DArray(spark().read.parquet(f"{path}/elements"), meta["shape"])


def delete(path: str) -> bool:
    """Whether there was something to delete."""
    where, fs = _hadoop(path)
    return bool(fs.delete(where, True))


def from_frame(df: DataFrame, columns: list[str] | None = None, index: str | None = None) -> DArray:
    """Numeric columns of one frame as a matrix; without an index column rows are in the order they are read.

    Columns of other types raise TypeError.
    """
    columns = columns or [c for c in df.columns if c != index]
    kinds = dict(df.dtypes)
    if any(kinds[c] not in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean") for c in columns):
        raise TypeError("columns of one numeric type are asked for")
    if index is None:  # ids rise with partitions and rows; places() makes them dense
        df, n = _numbered(df)
    else:
        df, n = df.withColumn("at", F.col(index).cast("bigint")), df.count()
    cells = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("k", "v")
    return DArray(df.select(F.col("at").alias("i0"), cells).select("i0", F.col("k").cast("bigint").alias("i1"), "v"), (n, len(columns)))


def _numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows with `at`, their place: by file name and place in it where df reads files, else by partition.

    The rows are written once with where they come from, so that places stay what they are.
    """
    try:
        split = df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), *df.columns)
    except AnalysisException:  # no files
        split = df.select(F.lit("").alias("_file"), F.spark_partition_id().cast("bigint").alias("_start"), "*")
    path = shared_folder("numbered")
    split.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark().read.parquet(path)
    parts = kept.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    w = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split of the input
    parts = parts.select("_file", "_start", "first", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    at = (F.col("before") + F.col("_id") - F.col("first")).cast("bigint")
    return kept.join(parts, ["_file", "_start"]).select(*df.columns, at.alias("at")), kept.count()


def from_pandas(pdf: pd.DataFrame) -> DArray:
    if pdf.select_dtypes("number").shape[1] != pdf.shape[1]:
        raise TypeError("columns of one numeric type are asked for")
    plain = pdf.reset_index(drop=True)
    plain.columns = [f"c{k}" for k in range(plain.shape[1])]
    return from_frame(spark().createDataFrame(plain.assign(row=np.arange(len(plain)))), list(plain.columns), "row")


from_modin = from_pandas


def read_csv(path: str, delimiter: str = ",", has_header: bool = False, dtype=float) -> DArray:
    """Numbers of a CSV file, or of the files of a folder in the order of their names, a row a line, as dtype."""
    reader = spark().read.option("sep", delimiter).option("header", has_header).option("inferSchema", True)
    return from_frame(reader.csv(path)).astype(dtype)


def loadtxt(path: str, delimiter: str | None = None, comments: str = "#", skiprows: int = 0, usecols: list[int] | None = None, max_rows: int | None = None, dtype=float, converters: dict | None = None, unpack: bool = False, ndmin: int = 0, encoding: str = "utf-8"):
    """Numbers of a text file; blank lines and what follows a comment sign are left out.

    converters: from a column's number to a function of a string column. unpack transposes. As in NumPy, an axis
    of length 1 goes unless ndmin asks for it.
    """
    if encoding.lower().replace("-", "") == "utf8":
        raw = spark().read.text(path)
    else:  # the text source reads UTF-8 alone
        raw = spark().read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").csv(path, schema="value string")
    lines, _ = _numbered(raw)
    lines = lines.where(F.col("at") >= skiprows).select("at", F.trim(F.split_part("value", F.lit(comments), F.lit(1))).alias("line")).where("line <> ''")
    ranked, n = places(lines.withColumnRenamed("at", "row"), "row")
    if max_rows is not None:
        ranked, n = ranked.where(F.col("at") < max_rows), min(n, max_rows)
    sign = r"\s+" if delimiter in (None, " ") else f"\\Q{delimiter}\\E"
    cells = ranked.select(F.col("at").alias("i0"), F.split("line", sign).alias("c"))
    first = cells.select(F.size("c")).first()
    width = len(usecols) if usecols else first[0] if first else 0
    number = lambda k: (converters or {}).get(k, lambda c: c.cast("double"))(F.trim(F.element_at("c", k % first[0] + 1))).cast("double")
    picked = F.array(*[number(k) for k in (usecols or range(width))])
    out = cells.select("i0", F.posexplode(picked).alias("k", "v")).select("i0", F.col("k").cast("bigint").alias("i1"), "v")
    a = DArray(out, (n, width)).astype(dtype)
    if ndmin < 2 and 1 in a.shape:
        a = squeeze(a)
        a = ravel(a) if ndmin == 1 and not a.ndim else a
    return transpose(a) if unpack and a.ndim == 2 else a


def fromfile(path: str, dtype=float) -> DArray:
    """A vector from binary files of one type, in the order of their names; each file is one task's."""
    files = spark().read.format("binaryFile").load(path).select("path", "length", "content")
    width = np.dtype(dtype).itemsize
    starts, total = {}, 0
    for r in files.select("path", "length").orderBy("path").collect():
        starts[r["path"]] = total
        total += r["length"] // width

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                v = np.frombuffer(content, dtype).astype(float)
                yield pd.DataFrame({"i0": starts[p] + np.arange(len(v)), "v": v})

    return DArray(files.select("path", "content").mapInPandas(run, "i0 bigint, v double"), (total,))


def zarr_array(url: str, name: str) -> DArray:
    """A one- or two-dimensional array of a Zarr group, a task a chunk; needs the zarr package."""
    try:
        import zarr
    except ImportError as e:
        raise ImportError("zarr_array needs the zarr package") from e
    a = zarr.open_group(url, mode="r")[name]
    shape, chunk = a.shape, a.chunks

    def run(batches):
        field = zarr.open_group(url, mode="r")[name]
        for pdf in batches:
            for start in pdf["id"] * chunk[0]:
                part = field[start : start + chunk[0]]
                at = np.indices(part.shape)
                yield pd.DataFrame({**{f"i{k}": x.ravel() + (start if k == 0 else 0) for k, x in enumerate(at)}, "v": part.ravel().astype(float)})

    schema = ", ".join([*(f"{c} bigint" for c in names(len(shape))), "v double"])
    return DArray(spark().range(-(-shape[0] // chunk[0])).mapInPandas(run, schema), shape)


def bimodal_gaussian(n: int, p: int, seed: int = 1) -> tuple[DArray, DArray]:
    """Nine rows in ten of N(10, 2), the others of N(30, 4) in each column, and a label that is 1 for the former."""
    from ..operators.random import RandomState
    from ..operators.shape import expand_dims

    state, cut = RandomState(seed), int(0.9 * n)
    noise = state.draw("standard_normal", (n, p))
    first = noise.with_value(F.when(F.col("i0") < cut, F.col("v") * 2 + 10).otherwise(F.col("v") * 4 + 30))
    label = DArray(spark().range(n).select(F.col("id").alias("i0"), (F.col("id") < cut).cast("double").alias("v")), (n,))
    return first, expand_dims(label, 1)
